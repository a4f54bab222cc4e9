"""Statistical tests.

Each test reduces the data to a handful of numbers in Spark (conditional sums,
confusion cells, per-fold ranks); p-values are closed-form functions of those
numbers, evaluated on the one aggregated row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens.operators.metrics import confusion_cells


# --- M12 --------------------------------------------------------------------
def mcnemar(df: DataFrame, y_true: str = "y_true", pred_a: str = "pred_a", pred_b: str = "pred_b") -> DataFrame:
    """n01 = A right & B wrong, n10 = the reverse, chi2 = (|n01 - n10| - 1)^2 / max(1, n01 + n10)
    (continuity term not clamped, as in the reference)."""
    a_ok = F.col(pred_a) == F.col(y_true)
    b_ok = F.col(pred_b) == F.col(y_true)
    g = df.agg(F.count_if(a_ok & ~b_ok).alias("n01"), F.count_if(~a_ok & b_ok).alias("n10"))
    chi2 = (F.abs(F.col("n01") - F.col("n10")) - 1) ** 2 / F.greatest(F.lit(1), F.col("n01") + F.col("n10"))
    return g.select("n01", "n10", chi2.cast("double").alias("chi2"))


def chi2_sf_df1(x: float) -> float:
    """Survival function of chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2.0))


def mcnemar_test(df: DataFrame, y_true: str = "y_true", pred_a: str = "pred_a", pred_b: str = "pred_b") -> dict:
    r = mcnemar(df, y_true, pred_a, pred_b).first()
    return {"chi2": float(r["chi2"]), "p_value": chi2_sf_df1(float(r["chi2"])), "n01": float(r["n01"]),
            "n10": float(r["n10"])}


def chi2_tail(x: Column, dof: Column, terms: int = 1500) -> Column:
    """Upper tail of chi-square as a column, dof >= 1: 1 minus the power series of the lower
    incomplete gamma function, each term from the one before; 0 beyond 1400, where the
    tail is below any double that matters; null and NaN give null."""
    a, z = dof / F.lit(2.0), x / F.lit(2.0)
    odd = F.when(F.pmod(dof.cast("int"), F.lit(2)) == 1, F.lit(math.sqrt(math.pi))).otherwise(F.lit(1.0))
    gamma = F.aggregate(F.sequence(F.lit(0), F.ceil(a).cast("int") - 1), odd, lambda acc, j: acc * (a - j))   # of a + 1
    first = F.exp(a * F.log(z) - z) / gamma
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(first.alias("term"), first.alias("total")),
                         lambda acc, n: F.struct((acc["term"] * z / (a + n)).alias("term"),
                                                 (acc["total"] + acc["term"] * z / (a + n)).alias("total")))["total"]
    tail = F.when(x <= 0, F.lit(1.0)).when(x > 1400, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - series))
    return F.when(x.isNotNull() & ~F.isnan(x), tail)


def with_p_value(tests: DataFrame, stat_col: str, dof: Column) -> DataFrame:
    """Add ``p_value`` to a frame of test statistics (M12: dof 1, M14: column ``df``)."""
    return tests.withColumn("p_value", chi2_tail(F.col(stat_col).cast("double"), dof))


# --- M13 --------------------------------------------------------------------
def accuracy_from_cells(y_true: np.ndarray, y_pred: np.ndarray, counts: np.ndarray) -> float:
    n = counts.sum()
    return float(counts[y_true == y_pred].sum() / n) if n else 0.0


def bootstrap_ci(df: DataFrame, metric: Callable[[np.ndarray, np.ndarray, np.ndarray], float] = accuracy_from_cells,
                 y_true: str = "y_true", y_pred: str = "y_pred", n: int = 2000, alpha: float = 0.05,
                 seed: int = 42, replicate_partitions: int | None = None) -> DataFrame:
    """Bootstrap interval of a metric of the confusion cells.

    Resampling n rows with replacement is a multinomial draw over the k^2 cells,
    so the rows are reduced to cells once (bounded by k^2) and shipped to the
    replicates; replicates are ``spark.range(n)`` rows spread over partitions and
    drawn by ``mapInPandas`` with a per-replicate seed (repeatable under retries).
    Result: one row (low, high, mean)."""
    spark = df.sparkSession
    cells = confusion_cells(df, y_true, y_pred)
    packed = cells.agg(F.collect_list(F.struct("y_true", "y_pred", "n")).alias("cells"))
    parts = replicate_partitions or max(1, min(n, spark.sparkContext.defaultParallelism))
    reps = spark.range(0, n, 1, parts).withColumn("cells", packed.select("cells").scalar())

    def draw(batches):
        for pdf in batches:
            out = []
            for rid, cl in zip(pdf["id"], pdf["cells"]):
                yt = np.array([c["y_true"] for c in cl])
                yp = np.array([c["y_pred"] for c in cl])
                cnt = np.array([c["n"] for c in cl], dtype=float)
                rng = np.random.default_rng([seed, int(rid)])
                sample = rng.multinomial(int(cnt.sum()), cnt / cnt.sum())
                out.append(metric(yt, yp, sample))
            yield pd.DataFrame({"replicate": pdf["id"], "value": out})

    vals = reps.mapInPandas(draw, "replicate long, value double")
    return vals.agg(F.percentile("value", alpha / 2).alias("low"), F.percentile("value", 1 - alpha / 2).alias("high"),
                    F.avg("value").alias("mean"))


# one replicate's weight of a row is Poisson(1): the limit of how often a row is drawn in a
# sample with replacement, and independent from row to row, so nothing is collected
_POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(18)]


def hash_uniform(key: Column, replicate: Column, seed: int) -> Column:
    """Repeatable uniform number in [0, 1) of a row and a replicate."""
    return F.shiftrightunsigned(F.xxhash64(key, replicate, F.lit(seed)), 11).cast("double") / float(1 << 53)


def poisson_weight(u: Column, steps: Sequence = _POISSON) -> Column:
    """Poisson(1) number of a uniform one, by the inverse of its distribution: small numbers,
    which are the frequent ones, are found first."""
    w = F.when(u < steps[0], 0.0)
    for k, p in enumerate(steps[1:], 1):
        w = w.when(u < p, float(k))
    return w.when(u >= steps[-1], float(len(steps)))


def _reweighted(df: DataFrame, key: Column, replicates: range, seed: int, uniform) -> DataFrame:
    """Every row once for each replicate in which it has a weight, with ``_b`` and ``_w``.

    The filter is on the uniform number, a column of its own: on the weight, it would be worked
    out again for every step of the distribution.  The row number beside it, which is not
    repeatable, keeps the filter above the draw, which is made once.  A ``uniform`` that gives no number in [0, 1)
    but something of the same order has the steps of the distribution as its ``steps``."""
    steps = getattr(uniform, "steps", _POISSON)
    rows = df.select("*", key.alias("_key"), F.explode(F.sequence(F.lit(replicates[0]), F.lit(replicates[-1]))).alias("_b"))
    drawn = rows.select("*", uniform(F.col("_key"), F.col("_b"), seed).alias("_u"), F.monotonically_increasing_id().alias("_at"))
    return drawn.where((F.col("_u") >= steps[0]) & (F.col("_at") >= 0)).withColumn("_w", poisson_weight(F.col("_u"), steps))


def weighted_accuracy(y: str, pred: str) -> Callable[[Column], Column]:
    return lambda w: F.sum(w * (F.col(y) == F.col(pred)).cast("double")) / F.sum(w)


def weighted_brier(y: str, p: str) -> Callable[[Column], Column]:
    return lambda w: F.sum(w * (F.col(p) - F.col(y)) ** 2) / F.sum(w)


def weighted_ece(y: str, p: str, n_bins: int = 10) -> Callable[[Column], Column]:
    """M9: the gap of a bin weighs as much as its rows, so it is the absolute sum of
    (correct - confidence) over its rows."""
    gap = (F.when(F.col(p) >= 0.5, 1).otherwise(0) == F.col(y)).cast("double") - F.col(p)
    bins = F.floor(F.col(p) * n_bins)
    return lambda w: sum((F.abs(F.coalesce(F.sum(F.when(bins == b, w * gap)), F.lit(0.0))) for b in range(n_bins)), F.lit(0.0)) / F.sum(w)


def replicate_values(df: DataFrame, key: Column, metrics: dict[str, Callable[[Column], Column]], n: int = 200, seed: int = 42,
                     uniform: Callable[[Column, Column, int], Column] = hash_uniform) -> DataFrame:
    """(replicate, metric, value): every metric, a function from a weight column to an
    aggregate expression, under ``n`` reweightings of the rows.

    One pass: a row is repeated inside its task and summed up there, ``n`` small partial rows a
    task are shuffled."""
    g = _reweighted(df, key, range(n), seed, uniform).groupBy(F.col("_b").alias("replicate")).agg(*[m(F.col("_w")).cast("double").alias(name) for name, m in metrics.items()])
    return g.unpivot("replicate", list(metrics), "metric", "value")


def ranked_replicate_values(df: DataFrame, key: Column, y: str, score: str, n: int = 200, seed: int = 42, block: int = 25,
                            uniform: Callable[[Column, Column, int], Column] = hash_uniform) -> DataFrame:
    """(replicate, metric, value) of AUC and average precision: weights are summed per replicate
    and distinct score, then the prefix sums run per replicate.  ``block`` replicates at a time
    bound what a pass shuffles."""
    from revlens.session import materialize
    rows, out = df.select(F.col(score).alias("score"), (F.col(y) == 1).alias("_y"), key.alias("_k")), None
    for start in range(0, n, block):
        w = _reweighted(rows, F.col("_k"), range(start, min(start + block, n)), seed, uniform)
        part = _ranked(materialize(_score_cells(w.withColumnRenamed("_b", "replicate"))))
        out = part if out is None else out.unionAll(part)
    return out


def _score_cells(w: DataFrame) -> DataFrame:
    """(replicate, score, pos, neg): the weights of rows ``(replicate, score, _y, _w)``."""
    return w.groupBy("replicate", "score").agg(F.sum(F.when(F.col("_y"), F.col("_w")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("_y"), 0.0).otherwise(F.col("_w"))).alias("neg"))


def _ranked(cells: DataFrame) -> DataFrame:
    from revlens.operators.metrics import ap_of_counts, auc_of_counts
    out = None
    for values, name in ((auc_of_counts(cells, ["replicate"]), "roc_auc"), (ap_of_counts(cells, ["replicate"]), "average_precision")):
        part = values.select("replicate", F.lit(name).alias("metric"), F.col(name).alias("value"))
        out = part if out is None else out.unionAll(part)
    return out


def _values_in_one_pass(df: DataFrame, key: Column, key_cols, metrics, ranked, n: int, seed: int, block: int, uniform) -> DataFrame | None:
    """All values from one draw a row and replicate: rows alike in all but their key are one cell
    of summed weight, so metrics and ranks read cells.  None if a metric reads a key column."""
    from revlens.session import materialize
    kept, (y, score), out = [c for c in df.columns if c not in key_cols], ranked, None
    if not {y, score} <= set(kept) or {"replicate", "_w"} & set(kept):
        return None
    sums = [m(F.col("_w")).cast("double").alias(name) for name, m in metrics.items()]
    try:
        df.select(*kept, F.lit(1.0).alias("_w")).agg(*sums)
    except AnalysisException:
        return None
    for start in range(0, n, block):
        w = _reweighted(df.select(*kept, key.alias("_k")), F.col("_k"), range(start, min(start + block, n)), seed, uniform)
        cells = materialize(w.groupBy(F.col("_b").alias("replicate"), *kept).agg(F.sum("_w").alias("_w")))
        scores = materialize(_score_cells(cells.select("replicate", F.col(score).alias("score"), (F.col(y) == 1).alias("_y"), "_w")))
        part = cells.groupBy("replicate").agg(*sums).unpivot("replicate", list(metrics), "metric", "value").unionByName(_ranked(scores))
        out = part if out is None else out.unionAll(part)
    return out


def intervals(values: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(metric, low, high, mean) of replicate values: n values a metric, so an exact percentile."""
    return values.groupBy("metric").agg(F.percentile("value", alpha / 2).alias("low"), F.percentile("value", 1 - alpha / 2).alias("high"), F.avg("value").alias("mean"))


def bootstrap_rows(df: DataFrame, key_cols, metrics: dict[str, Callable[[Column], Column]], n: int = 200, alpha: float = 0.05, seed: int = 42,
                   ranked: tuple[str, str] | None = None, block: int = 25, uniform: Callable[[Column, Column, int], Column] = hash_uniform) -> DataFrame:
    """M13 on rows: (metric, low, high, mean) of any metric that can be written as an aggregate
    with a weight column, and with ``ranked=(y, score)`` of AUC and average precision.

    ``key_cols`` name the rows: equal keys get equal weights in every replicate."""
    key = F.concat_ws("-", *key_cols)
    if metrics and ranked:
        values = _values_in_one_pass(df, key, key_cols, metrics, ranked, n, seed, block, uniform)
        if values is not None:
            return intervals(values, alpha)
    values = replicate_values(df, key, metrics, n, seed, uniform) if metrics else None
    if ranked:
        more = ranked_replicate_values(df, key, *ranked, n=n, seed=seed, block=block, uniform=uniform)
        values = more if values is None else values.unionByName(more)
    return intervals(values, alpha)


# --- M14 --------------------------------------------------------------------
def friedman(scores: DataFrame, block: str = "fold", model: str = "model", score: str = "score") -> DataFrame:
    """Friedman chi-square with tie correction.  Ranks are averaged over ties
    within each block by a window partitioned by block (bounded by the number of
    models).  Output: statistic, df, n_blocks, k_models."""
    w = Window.partitionBy(block).orderBy(score)
    wt = Window.partitionBy(block, score)
    r = scores.select(block, model, score, (F.rank().over(w) + (F.count(F.lit(1)).over(wt) - 1) / 2.0).alias("rank"),
                      F.count(F.lit(1)).over(wt).alias("t"))
    per_model = r.groupBy(model).agg(F.sum("rank").alias("R"))
    n = scores.select(F.count_distinct(block).cast("double")).scalar()
    k = scores.select(F.count_distinct(model).cast("double")).scalar()
    # each tie group of size t appears t times: sum over rows of (t^2 - 1) = sum over groups of (t^3 - t)
    ties = r.select(F.sum(F.col("t") * F.col("t") - 1).cast("double")).scalar()
    ssbn = per_model.agg(F.sum(F.col("R") ** 2).alias("ssbn"))
    c = 1 - ties / (k * (k * k - 1) * n)
    stat = (12.0 / (k * n * (k + 1)) * F.col("ssbn") - 3 * n * (k + 1)) / c
    return ssbn.select(stat.alias("statistic"), (k - 1).alias("df"), n.alias("n_blocks"), k.alias("k_models"))


def chi2_sf(x: float, dof: float) -> float:
    """Upper tail of chi-square: regularised upper incomplete gamma Q(dof/2, x/2)
    (series / continued fraction; scipy is not a dependency)."""
    a, z = dof / 2.0, x / 2.0
    if z <= 0:
        return 1.0
    if z < a + 1:
        term = total = 1.0 / a
        ap = a
        for _ in range(1000):
            ap += 1
            term *= z / ap
            total += term
            if abs(term) < abs(total) * 1e-15:
                break
        return max(0.0, 1.0 - total * math.exp(-z + a * math.log(z) - math.lgamma(a)))
    b = z + 1 - a
    c = 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1 / d
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-z + a * math.log(z) - math.lgamma(a)) * h


def friedman_test(scores: DataFrame, block: str = "fold", model: str = "model", score: str = "score") -> dict:
    r = friedman(scores, block, model, score).first()
    return {"statistic": float(r["statistic"]), "p_value": chi2_sf(float(r["statistic"]), float(r["df"]))}


def studentized_range_tail(q: float, k: int, steps: int = 2_000) -> float:
    """Upper tail of the studentised range of ``k`` normal values (infinite degrees of
    freedom): 1 - k * integral of phi(z) (Phi(z) - Phi(z - q))^(k - 1), by Simpson's rule."""
    if q <= 0:
        return 1.0
    z = np.linspace(-8.5, 8.5 + q, steps + 1)
    cdf = lambda x: 0.5 * (1 + np.array([math.erf(v / math.sqrt(2)) for v in x]))
    f = k * np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (cdf(z) - cdf(z - q)) ** (k - 1)
    w = np.ones(steps + 1)
    w[1:-1:2], w[2:-1:2] = 4, 2
    return float(min(1.0, max(0.0, 1 - (f * w).sum() * (z[1] - z[0]) / 3)))


def studentized_range_quantile(alpha: float, k: int) -> float:
    """``q`` with ``studentized_range_tail(q, k) == alpha``, by bisection."""
    low, high = 0.0, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if studentized_range_tail(mid, k) > alpha else (low, mid)
    return (low + high) / 2


def nemenyi(scores: DataFrame, block: str = "fold", model: str = "model", score: str = "score", alpha: float = 0.05) -> DataFrame:
    """Post-hoc test after M14: (model_a, model_b, rank_diff, critical, significant, p_value) for
    every pair of models.  Mean ranks differ if they are further apart than
    ``q(alpha, k) / sqrt(2) * sqrt(k (k + 1) / (6 n))``.

    Ranks are taken within each block (ties share their mean rank); what follows has one row
    per model.  Blocks that lack a model make the test undefined and raise an error."""
    w, ties = Window.partitionBy(block).orderBy(score), Window.partitionBy(block, score)
    ranks = scores.select(block, model, (F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0).alias("r"))
    mean = ranks.groupBy(F.col(model).alias("m")).agg(F.avg("r").alias("r"), F.count(F.lit(1)).alias("n"))
    rows = mean.orderBy("m").collect()
    k, blocks = len(rows), scores.select(block).distinct().count()
    if any(r["n"] != blocks for r in rows):
        raise ValueError("every block needs one score of every model")
    unit = math.sqrt(k * (k + 1) / (6.0 * blocks)) if blocks else float("nan")
    critical = studentized_range_quantile(alpha, k) / math.sqrt(2) * unit if k > 1 else float("nan")
    out = [(a["m"], b["m"], abs(a["r"] - b["r"]), critical, abs(a["r"] - b["r"]) > critical, studentized_range_tail(abs(a["r"] - b["r"]) / unit * math.sqrt(2), k))
           for i, a in enumerate(rows) for b in rows[i + 1:]]
    return scores.sparkSession.createDataFrame(out, f"model_a {scores.schema[model].dataType.simpleString()}, model_b {scores.schema[model].dataType.simpleString()}, "
                                                    "rank_diff double, critical double, significant boolean, p_value double")
