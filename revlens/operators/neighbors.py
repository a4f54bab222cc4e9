"""Vector operators: prototype assignment (J3), k-nearest neighbours (J5), nearest unlike
neighbour (J6), SMOTE (ML6) and counterfactuals (X4).

J6, SMOTE and X4 search by locality-sensitive hashing (``lsh.py``) unless ``method="exact"``
asks for the exact search below.

Exact kNN without a row-by-row join:
  1. pivots = the ``n_pivots`` right-side rows with the smallest hash (bounded); every point is
     assigned to its nearest pivot; block radius R_b = max distance of a block member to its pivot.
  2. each query point meets its own block and keeps its k nearest there; r_k = k-th distance.
  3. by the triangle inequality a point y in block b can only beat r_k if
     d(x, pivot_b) - R_b <= r_k, so the query meets exactly those blocks too, and the k nearest
     over both passes are final.
Blocks are cut to a bounded size on both sides and meet in tasks that multiply matrices
(``lsh.nearest_of_block``); a pair of blocks sends on k rows a query.  Pruning keeps the second
pass local for clustered data; without structure all pairs are compared.  Ties are broken by the
neighbour id.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from revlens.functions.text import let
from revlens.operators.lsh import block_rows, lsh_knn, meet
from revlens.session import materialize


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def sqdist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


# --- J3 ---------------------------------------------------------------------
def embedding_assign(vectors: DataFrame, prototypes: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                     threshold: float = 0.55) -> DataFrame:
    """Cosine of normalised vectors against the aspect prototypes, argmax
    (ties -> lower aspect_ord), kept when >= threshold.  The prototype table is one
    row per aspect and enters as a scalar array, so the vector side is never joined."""
    protos = prototypes.agg(F.array_sort(F.collect_list(F.struct("aspect_ord", "aspect", "embedding"))).alias("p")) \
        .select("p").scalar()
    # subqueries may not sit inside lambdas: project the prototype array first
    sims = F.transform("_protos", lambda p: F.struct(dot(F.col(vec_col), p["embedding"]).alias("sim"),
                                                     p["aspect_ord"].alias("aspect_ord"), p["aspect"].alias("aspect")))
    best = let(sims, lambda s: let(F.array_max(F.transform(s, lambda x: x["sim"])),
                                   lambda m: F.filter(s, lambda x: x["sim"] == m)[0]))
    out = vectors.select(id_col, vec_col, protos.alias("_protos")).select(id_col, best.alias("_b"))
    return out.where(F.col("_b.sim") >= threshold).select(id_col, F.col("_b.aspect").alias("aspect"),
                                                          F.col("_b.sim").alias("similarity"))


# --- J5 ---------------------------------------------------------------------
def _placed(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows (id, cls, vec) with their distances to the pivots and the block ``bucket`` of the
    nearest.  Vectors that no pivot can be compared with (of another length, not finite) have no
    distances and stand in a block of their length, numbered below zero."""
    schema = StructType([*df.schema.fields, StructField("bucket", LongType()), StructField("away", ArrayType(DoubleType()))])

    def work(batches):
        for pdf in batches:
            bucket, away = [0] * len(pdf), [None] * len(pdf)
            for at in range(0, len(pdf), 1024):
                x = [np.asarray(v, float) for v in pdf["vec"].iloc[at:at + 1024]]
                same = [i for i, v in enumerate(x) if len(v) == pivots.shape[1] and len(pivots) and np.isfinite(v).all()]
                for i, v in enumerate(x):
                    bucket[at + i] = -1 - len(v)
                if same:
                    block = np.stack([x[i] for i in same])
                    d = np.stack([np.sqrt(((block - p) ** 2).sum(1)) for p in pivots], axis=1)
                    for i, row, b in zip(same, d, d.argmin(axis=1)):
                        bucket[at + i], away[at + i] = int(b), row
            yield pdf.assign(bucket=bucket, away=away)

    return df.mapInPandas(work, schema)


def knn(left: DataFrame, right: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
        n_pivots: int = 64, exclude_self: bool = True, class_col: str | None = None, seed: int = 7) -> DataFrame:
    """Exact k nearest right-side rows for every left row (Euclidean).
    Output (id, nbr_id, dist, rank); rank 1 = nearest.  ``class_col``: only rows of different
    classes pair.  Null ids and classes, and vectors null or with null components, take no part."""
    def usable(df: DataFrame) -> DataFrame:
        cls = F.col(class_col) if class_col else F.lit(None).cast("int")
        d = df.select(F.col(id_col).alias("id"), cls.alias("cls"), F.col(vec_col).cast("array<double>").alias("vec"))
        d = d.where(F.col("id").isNotNull() & F.forall("vec", lambda c: c.isNotNull()))
        return d.where(F.col("cls").isNotNull()) if class_col else d

    lrows, rrows = usable(left), usable(right)
    some = [np.array(r["vec"], float) for r in rrows.where(F.forall("vec", lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))))
            .orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n_pivots).select("vec").collect()]
    lengths = [len(v) for v in some]
    dim = max(sorted(set(lengths)), key=lengths.count) if some else 0
    some = [v for v in some if len(v) == dim]
    pivots = np.array(some, float).reshape(len(some), dim)
    lp = materialize(_placed(lrows, pivots).withColumn("tab", F.lit(0)))
    rp = materialize(_placed(rrows, pivots).withColumn("tab", F.lit(0)))
    reach = {r["bucket"]: r["most"] for r in rp.where(F.col("bucket") >= 0).groupBy("bucket")
             .agg(F.max(F.element_at("away", F.col("bucket").cast("int") + 1)).alias("most")).collect()}
    apart = not rp.where(F.col("bucket") < 0).isEmpty()
    most, unlike = block_rows(rp.count()), class_col is not None

    def pairs(side: DataFrame) -> DataFrame:
        return meet(side.select("tab", "bucket", "id", "cls", "vec"), rp.select("tab", "bucket", "id", "cls", "vec"), k, exclude_self, unlike, most)

    def top(p: DataFrame) -> DataFrame:
        w = Window.partitionBy("lid").orderBy("dist", "rid")
        return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    first = materialize(top(pairs(lp)))
    rk = first.groupBy("lid").agg(F.count(F.lit(1)).alias("_c"), F.max("dist").alias("_m")) \
        .select(F.col("lid").alias("id"), F.when(F.col("_c") >= k, F.col("_m")).alias("_r"))
    # blocks other than the own one whose ball can reach within r_k; without r_k or distances, all of them
    ball = F.array(*[F.struct(F.lit(int(b)).cast("long").alias("b"), F.lit(float(m)).alias("m")) for b, m in sorted(reach.items())]) \
        if reach else F.array().cast("array<struct<b:bigint,m:double>>")
    near = F.filter(ball, lambda s: (s["b"] != F.col("bucket")) & F.coalesce(
        (F.element_at("away", s["b"].cast("int") + 1) - s["m"]) * (1 - 1e-12) - 1e-9 <= F.col("_r"), F.lit(True)))
    others = F.transform(near, lambda s: s["b"])
    if apart:
        own = -1 - F.size("vec").cast("long")
        others = F.when(F.col("bucket") == own, others).otherwise(F.concat(others, F.array(own)))
    # a pivot block holds vectors of the pivots' length alone
    others = F.when(F.size("vec") == dim, others).otherwise(F.array().cast("array<bigint>"))
    second = lp.join(rk, "id", "left").withColumn("bucket", F.explode(others))
    found = top(first.select("lid", "rid", "dist").unionByName(pairs(second)))
    return found.select(F.col("lid").alias(id_col), F.col("rid").alias("nbr_id"), "dist", "rank")


# --- J6 / X4 -----------------------------------------------------------------
def _search(left: DataFrame, right: DataFrame, k: int, id_col: str, vec_col: str, method: str, exclude_self: bool = True,
            class_col: str | None = None) -> DataFrame:
    if method == "lsh":
        return lsh_knn(left, right, k, id_col, vec_col, exclude_self, class_col)
    if method != "exact":
        raise ValueError("method is lsh or exact")
    return knn(left, right, k, id_col, vec_col, exclude_self=exclude_self, class_col=class_col)


def nearest_unlike_neighbor(df: DataFrame, class_col: str, id_col: str = "vec_id", vec_col: str = "embedding",
                            candidates: DataFrame | None = None, method: str = "lsh") -> DataFrame:
    """Nearest row of a different class (``method``: see the module's text)."""
    right = candidates if candidates is not None else df
    return _search(df.select(id_col, vec_col, class_col), right.select(id_col, vec_col, class_col), 1, id_col, vec_col, method, class_col=class_col)


def counterfactual(df: DataFrame, prob_col: str, id_col: str = "vec_id", vec_col: str = "embedding",
                   target_threshold: float = 0.51, method: str = "lsh") -> DataFrame:
    """X4 (nearest unlike neighbour): for each row below the target probability, the
    nearest row that reaches it, with distance and number of changed coordinates."""
    d = df.select(id_col, vec_col, prob_col, (F.col(prob_col) >= target_threshold).cast("int").alias("_reach"))
    q = d.where(F.col("_reach") == 0)
    c = d.where(F.col("_reach") == 1)
    nn = _search(q.select(id_col, vec_col), c.select(id_col, vec_col), 1, id_col, vec_col, method, exclude_self=False)
    v = df.select(F.col(id_col).alias("nbr_id"), F.col(vec_col).alias("_nv"))
    j = nn.join(df.select(id_col, vec_col), id_col).join(v, "nbr_id")
    changed = F.size(F.filter(F.zip_with(vec_col, "_nv", lambda a, b: F.abs(a - b) > 1e-12), lambda x: x))
    return j.select(id_col, F.col("nbr_id").alias("counterfactual_id"), "dist", changed.alias("n_changed"))


# --- ML6 ----------------------------------------------------------------------
def smote(df: DataFrame, label_col: str = "y", id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
          seed: int = 42, minority: int = 1, method: str = "lsh") -> DataFrame:
    """ML6: oversample the minority class up to the majority count.

    Every minority row spawns ceil(deficit / n_min) candidates; exactly ``deficit``
    of them are kept by hash order (``stratified_split`` machinery, no global
    window).  Candidate s of row x takes neighbour j = hash(x, s) mod k of its
    k nearest minority rows and u = hash(x, s) in [0, 1): x + u * (nbr - x).
    Output: original rows (synthetic = false) and synthetic rows with new ids."""
    mino = df.where(F.col(label_col) == minority)
    cnt = df.agg(F.count_if(F.col(label_col) == minority).alias("n_min"),
                 F.count_if(F.col(label_col) != minority).alias("n_maj")).first()
    deficit = F.lit(max(int(cnt["n_maj"]) - int(cnt["n_min"]), 0))
    per = F.lit(-(-max(int(cnt["n_maj"]) - int(cnt["n_min"]), 0) // max(int(cnt["n_min"]), 1)))
    nbrs = materialize(_search(mino.select(id_col, vec_col), mino.select(id_col, vec_col), k, id_col, vec_col, method))   # read twice below
    n_nbrs = nbrs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_kk"))
    cand = mino.select(id_col, vec_col).join(n_nbrs, id_col).select(
        id_col, vec_col, "_kk", F.explode(F.sequence(F.lit(0), F.greatest((per - 1).cast("int"), F.lit(0))))
        .alias("_s"))
    hsh = F.xxhash64(F.col(id_col), F.col("_s"), F.lit(seed))
    cand = cand.select("*", (F.pmod(hsh, F.col("_kk")) + 1).alias("rank"),
                       (F.pmod(F.xxhash64(F.col(id_col), F.col("_s"), F.lit(seed + 1)), F.lit(1_000_000)) / 1e6)
                       .alias("_u"),
                       F.concat_ws(":", F.col(id_col).cast("string"), F.col("_s").cast("string")).alias("_cid"))
    # keep exactly `deficit` candidates, chosen by hash order
    marked = _first_k(cand, "_cid", deficit, seed)
    chosen = marked.where("_keep").join(nbrs, [id_col, "rank"]).join(
        mino.select(F.col(id_col).alias("nbr_id"), F.col(vec_col).alias("_nv")), "nbr_id")
    synth = chosen.select(
        # synthetic rows get negative ids derived from (source row, sample): -(id * 2^20 + s) - 1
        (-(F.col(id_col) * F.lit(1 << 20) + F.col("_s")) - 1).alias(id_col),
        F.zip_with(vec_col, "_nv", lambda a, b: a + F.col("_u") * (b - a)).alias(vec_col),
        F.lit(minority).alias(label_col), F.lit(True).alias("synthetic"))
    base = df.select(id_col, vec_col, label_col, F.lit(False).alias("synthetic"))
    return base.unionByName(synth)


def _first_k(df: DataFrame, id_col: str, k: Column, seed: int) -> DataFrame:
    """Mark the k rows with the smallest md5(id-seed) (exact; bucketed, no global window)."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}")))
    d = df.select("*", h.alias("_h"), F.conv(F.substring(h, 1, 4), 16, 10).cast("int").alias("_b"))
    cnt = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dec = cnt.select("_b", "_n", before.alias("_before"))  # <= 65536 rows
    j = d.join(F.broadcast(dec), "_b")
    rn = F.row_number().over(Window.partitionBy("_b").orderBy("_h", id_col))
    edge = (F.col("_before") < k) & (F.col("_before") + F.col("_n") > k)
    inside = j.where(~edge).select(*df.columns, (F.col("_before") + F.col("_n") <= k).alias("_keep"))
    border = j.where(edge).select(*df.columns, (F.col("_before") + rn <= k).alias("_keep"))
    return inside.unionByName(border)
