"""Classification metrics (M1-M11), length breakdown (G14) and example pickers.

Scale design: n prediction rows are reduced once to confusion cells (at most
k^2 rows) or to one row per distinct score; everything after that is arithmetic
on those small frames.  Prefix sums over distinct scores (AUC, AP) use a
two-level scheme -- score buckets from approximate quantiles, bucket totals
prefixed over the (bounded) bucket list, then a window partitioned by bucket --
so no window ever runs over one unpartitioned partition of data-sized rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlens.functions import text as T

PREFIX_BUCKETS = 256


# --- M1 ---------------------------------------------------------------------
def confusion_cells(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Observed (y_true, y_pred, n) cells -- one partial-aggregated pass."""
    return df.groupBy(F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """M1: counts for every (true, pred) pair of labels seen in either column, 0 when absent.

    The label grid is the label set exploded twice (k^2 rows for k classes)."""
    cells = confusion_cells(df, y_true, y_pred)
    labels = cells.select(F.array_distinct(F.flatten(F.collect_set(F.array("y_true", "y_pred")))).alias("l"))
    grid = labels.select(F.explode("l").alias("y_true"), F.col("l")).select("y_true", F.explode("l").alias("y_pred"))
    cells = cells.select(F.col("y_true").alias("_t"), F.col("y_pred").alias("_p"), "n")
    return grid.join(cells, F.col("y_true").eqNullSafe(F.col("_t")) & F.col("y_pred").eqNullSafe(F.col("_p")), "left").select(
        "y_true", "y_pred", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))


def per_class(cells: DataFrame) -> DataFrame:
    """(label, tp, support, predicted, precision, recall, f1) over labels in true u pred."""
    t = cells.groupBy(F.col("y_true").alias("label")).agg(F.sum("n").alias("support"),
                                                         F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n"))
                                                               .otherwise(0)).alias("tp"))
    p = cells.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    j = t.join(p, "label", "full").select(
        "label", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("support", F.lit(0)).alias("support"),
        F.coalesce("predicted", F.lit(0)).alias("predicted"))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    j = j.select("*", prec.alias("precision"), rec.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return j.select("*", f1.alias("f1"))


def prf_weighted(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """M2: accuracy and support-weighted precision / recall / F1 (zero division -> 0)."""
    pc = per_class(confusion_cells(df, y_true, y_pred))
    s = F.sum("support")
    return pc.agg(
        (F.sum("tp") / s).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / s).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / s).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / s).alias("f1"),
    )


def argmax(prob_cols: Sequence[str]) -> Column:
    """Index of the largest probability (first on ties)."""
    arr = F.array(*[F.col(c) for c in prob_cols])
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def prf_macro(df: DataFrame, y_true: str, prob_cols: Sequence[str]) -> DataFrame:
    """M3: argmax prediction, accuracy and unweighted mean P/R/F1 over labels in true u pred."""
    d = df.select(F.col(y_true).alias("y_true"), argmax(prob_cols).alias("y_pred"))
    pc = per_class(confusion_cells(d))
    return pc.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("precision").alias("precision"),
                  F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def mcc(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """M4: multiclass Matthews correlation; 0 when undefined."""
    pc = per_class(confusion_cells(df, y_true, y_pred))
    g = pc.agg(F.sum("tp").cast("double").alias("c"), F.sum("support").cast("double").alias("s"),
               F.sum(F.col("predicted").cast("double") * F.col("support")).alias("pt"),
               F.sum(F.col("predicted").cast("double") ** 2).alias("pp"),
               F.sum(F.col("support").cast("double") ** 2).alias("tt"))
    den = F.sqrt((F.col("s") ** 2 - F.col("pp")) * (F.col("s") ** 2 - F.col("tt")))
    return g.select(F.when(den > 0, (F.col("c") * F.col("s") - F.col("pt")) / den).otherwise(F.lit(0.0)).alias("mcc"))


def cost_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", fn_weight: float = 2.0) -> DataFrame:
    """M5: binary cost = w*FN + FP and cost-sensitive accuracy (= accuracy)."""
    t, p = F.col(y_true), F.col(y_pred)
    g = df.agg(F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 0) & (p == 1)).alias("fp"),
               F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if((t == 0) & (p == 0)).alias("tn"))
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return g.select("tp", "tn", "fp", "fn", (F.lit(fn_weight) * F.col("fn") + F.col("fp")).cast("double").alias("cost"),
                    ((F.col("tp") + F.col("tn")) / F.greatest(F.lit(1), n)).alias("cost_sensitive_accuracy"))


# --- prefix sums over distinct scores ----------------------------------------
def score_counts(df: DataFrame, y: str, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """(group..., score, pos, neg): one row per distinct score (map-side combined)."""
    return df.groupBy(*group_cols, F.col(score).alias("score")).agg(
        F.count_if(F.col(y) == 1).cast("double").alias("pos"), F.count_if(F.col(y) != 1).cast("double").alias("neg"))


def prefix_below(sc: DataFrame, group_cols: Sequence[str] = (), buckets: int = PREFIX_BUCKETS) -> DataFrame:
    """Adds pos_below / neg_below = totals over strictly smaller scores (per group).

    Level 1: scores are cut into <= ``buckets`` ranges per group at approximate
    quantiles (a scalar-sized array); bucket totals are prefixed with a window
    over the bucket rows only.  Level 2: a window partitioned by (group, bucket)
    prefixes inside each bucket.  Neither window sees a data-sized single partition."""
    g = list(group_cols)
    probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    bounds = sc.groupBy(*g).agg(F.percentile_approx("score", probs, 10000).alias("_b")) if g else \
        sc.agg(F.percentile_approx("score", probs, 10000).alias("_b"))
    if g:
        b = sc.join(bounds, g)          # the planner broadcasts few groups, shuffles many
    else:
        b = sc.withColumn("_b", bounds.select("_b").scalar())
    # non-nullable bucket: otherwise an inferred isnotnull(_bucket) is pushed below the
    # aggregate and the bound lookup runs on every raw row instead of every distinct score
    b = b.withColumn("_bucket", F.coalesce(F.size(F.filter("_b", lambda x: x < F.col("score"))), F.lit(0))).drop("_b")
    tot = b.groupBy(*g, "_bucket").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    wb = Window.partitionBy(*g).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*g, "_bucket", F.coalesce(F.sum("_bp").over(wb), F.lit(0.0)).alias("_op"),
                     F.coalesce(F.sum("_bn").over(wb), F.lit(0.0)).alias("_on"))
    j = b.join(tot if g else F.broadcast(tot), [*g, "_bucket"])      # without groups: at most `buckets` rows
    wi = Window.partitionBy(*g, "_bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    return j.select(*g, "score", "pos", "neg",
                    (F.col("_op") + F.coalesce(F.sum("pos").over(wi), F.lit(0.0))).alias("pos_below"),
                    (F.col("_on") + F.coalesce(F.sum("neg").over(wi), F.lit(0.0))).alias("neg_below"))


def roc_auc(df: DataFrame, y: str = "y_true", score: str = "p_a", group_cols: Sequence[str] = ()) -> DataFrame:
    """M6: AUC = sum pos_s * (neg below s + neg_s / 2) / (P * N), ties count one half."""
    return auc_of_counts(score_counts(df, y, score, group_cols), group_cols)


def auc_of_counts(counts: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """M6 from (group..., score, pos, neg); the counts may be weights."""
    pb = prefix_below(counts, group_cols)
    g = pb.groupBy(*group_cols).agg(
        F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))).alias("_a"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return g.select(*group_cols, (F.col("_a") / (F.col("_p") * F.col("_n"))).alias("roc_auc"))


def roc_auc_ovr(df: DataFrame, y: str, prob_cols: Sequence[str]) -> DataFrame:
    """M6 multiclass: one-vs-rest macro AUC (explode the class index, group by it)."""
    e = df.select(F.col(y).alias("_y"), F.posexplode(F.array(*[F.col(c) for c in prob_cols])).alias("cls", "p"))
    e = e.select("cls", "p", (F.col("_y") == F.col("cls")).cast("int").alias("is_pos"))
    per = roc_auc(e, "is_pos", "p", ["cls"])
    return per.agg(F.avg("roc_auc").alias("roc_auc_ovr"))


def average_precision(df: DataFrame, y: str = "y_true", score: str = "p_a") -> DataFrame:
    """M7: step-form AP = sum over distinct thresholds (desc) of (pos_s / P) * precision(s)."""
    sc = score_counts(df, y, score)
    pb = prefix_below(sc)
    # totals over strictly-below prefixes: P - pos_below = positives at or above the score
    tot = sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    P, N = F.lit(float(tot["P"] or 0.0)), F.lit(float(tot["N"] or 0.0))
    tp = P - F.col("pos_below")
    fp = N - F.col("neg_below")
    return pb.agg((F.sum(F.col("pos") * tp / (tp + fp)) / F.sum("pos")).alias("average_precision"))


def ap_of_counts(counts: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """M7 per group from (group..., score, pos, neg); the counts may be weights."""
    g = list(group_cols)
    tot = counts.groupBy(*g).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    pb = prefix_below(counts, g).join(tot, g)
    tp, fp = F.col("_P") - F.col("pos_below"), F.col("_N") - F.col("neg_below")
    part = F.when(F.col("pos") > 0, F.col("pos") * tp / (tp + fp)).otherwise(F.lit(0.0))
    return pb.groupBy(*g).agg((F.sum(part) / F.sum("pos")).alias("average_precision"))


def brier(df: DataFrame, y: str = "y_true", p: str = "p_a") -> DataFrame:
    """M8: mean squared difference of probability and outcome."""
    return df.agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"))


def _ece_from(conf: Column, correct: Column, df: DataFrame, n_bins: int, include_right: bool = False) -> DataFrame:
    """Bins [i/n, (i+1)/n) with edges i * (1/n) as doubles (linspace values); conf == 1.0 falls
    in no bin (as in the reference) unless ``include_right`` closes the last bin."""
    step = 1.0 / n_bins
    b0 = F.floor(conf * n_bins).cast("int")
    b = (F.when(conf < b0 * F.lit(step), b0 - 1).when(conf >= (b0 + 1) * F.lit(step), b0 + 1).otherwise(b0))
    if include_right:
        b = F.when(conf == 1.0, F.lit(n_bins - 1)).otherwise(b)
    d = df.select(conf.alias("conf"), correct.cast("double").alias("correct"), b.alias("bin"))
    n = d.select(F.count(F.lit(1)).cast("double")).scalar()
    per = d.where((F.col("bin") >= 0) & (F.col("bin") < n_bins)).groupBy("bin").agg(
        F.count(F.lit(1)).alias("nb"), F.avg("correct").alias("acc"), F.avg("conf").alias("c"))
    return per.agg(F.coalesce(F.sum(F.col("nb") / n * F.abs(F.col("acc") - F.col("c"))), F.lit(0.0)).alias("ece"))


def ece_binary(df: DataFrame, y: str = "y_true", p: str = "p_a", n_bins: int = 10,
               include_right: bool = False) -> DataFrame:
    """M9 (1-D): conf = p, pred = p >= 0.5, correct = pred == y."""
    conf = F.col(p)
    return _ece_from(conf, (F.when(conf >= 0.5, 1).otherwise(0) == F.col(y)), df, n_bins, include_right)


def ece_multiclass(df: DataFrame, y: str, prob_cols: Sequence[str], n_bins: int = 10,
                   include_right: bool = False) -> DataFrame:
    """M9 (n x k): conf = max prob, pred = argmax."""
    conf = F.greatest(*[F.col(c) for c in prob_cols])
    return _ece_from(conf, argmax(prob_cols) == F.col(y), df, n_bins, include_right)


def top_k_accuracy(df: DataFrame, y: str, prob_cols: Sequence[str], k: int = 3) -> DataFrame:
    """True class among the k largest probabilities (stable order: lower index first on ties)."""
    arr = F.array(*[F.col(c) for c in prob_cols])
    pt = F.element_at(arr, F.col(y) + 1)
    idx = F.sequence(F.lit(0), F.lit(len(prob_cols) - 1))
    rank = 1 + F.size(F.filter(idx, lambda j: (F.element_at(arr, j + 1) > pt) |
                               ((F.element_at(arr, j + 1) == pt) & (j < F.col(y)))))
    return df.agg(F.avg((rank <= k).cast("double")).alias("top_k_accuracy"))


def classification_report(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Per-class rows plus 'macro avg' and 'weighted avg' rows (label as string)."""
    pc = per_class(confusion_cells(df, y_true, y_pred))
    rows = pc.select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1",
                     F.col("support").cast("bigint").alias("support"))
    s = F.sum("support")
    macro = pc.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), s.cast("bigint").alias("support"))
    weighted = pc.agg(F.lit("weighted avg").alias("label"),
                      (F.sum(F.col("precision") * F.col("support")) / s).alias("precision"),
                      (F.sum(F.col("recall") * F.col("support")) / s).alias("recall"),
                      (F.sum(F.col("f1") * F.col("support")) / s).alias("f1"), s.cast("bigint").alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


# --- G14 / T1-T3 --------------------------------------------------------------
def _length(text_col: str, len_col: str | None) -> Column:
    return F.col(len_col) if len_col else F.length(T.as_text(text_col))


def accuracy_by_length(df: DataFrame, y_true: str, y_pred: str, text_col: str = "review_text", q: int = 5,
                       len_col: str | None = None) -> DataFrame:
    """``qcut(len, q, duplicates='drop')`` bins (lo, hi], lowest edge inclusive;
    accuracy and size per bin.  Edges are exact linear quantiles (scalar subquery).
    ``len_col`` names a column that already holds the text length."""
    d = df.select(_length(text_col, len_col).alias("len"), (F.col(y_true) == F.col(y_pred)).cast("double").alias("ok"))
    probs = F.array(*[F.lit(i / q) for i in range(q + 1)])
    edges = d.select(F.array_distinct(F.percentile(F.col("len"), probs))).scalar()
    b = d.select("len", "ok", edges.alias("_e"))
    b = b.select("ok", "_e", F.greatest(F.lit(1), F.size(F.filter("_e", lambda e: e < F.col("len")))).alias("bin"))
    b = b.where(F.size("_e") >= 2)
    g = b.groupBy("bin", "_e").agg(F.avg("ok").alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return g.select("bin", F.element_at("_e", F.col("bin")).alias("bin_lo"), F.element_at("_e", F.col("bin") + 1)
                    .alias("bin_hi"), "accuracy", "n")


def misclassified_examples(df: DataFrame, y_true: str, y_pred: str, id_col: str, text_col: str = "review_text",
                           k: int = 25, len_col: str | None = None) -> DataFrame:
    """Rows with y_true != y_pred (both null counts as an error), longest text first, top k.
    With ``len_col`` the frame needs no text; join it to the k rows afterwards."""
    return misclassified(df, y_true, y_pred).withColumn("text_len", _length(text_col, len_col).cast("bigint")) \
        .orderBy(F.desc("text_len"), id_col).limit(k)


def misclassified(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """P5: rows whose prediction differs from the label (both null counts as an error)."""
    return df.where(~F.col(y_true).eqNullSafe(F.col(y_pred)) | (F.col(y_true).isNull() & F.col(y_pred).isNull()))


def lowest_confidence(df: DataFrame, conf_col: str, id_col: str, k: int = 5) -> DataFrame:
    """The k least confident predictions (TakeOrderedAndProject, no global sort)."""
    return df.orderBy(F.asc(conf_col), id_col).limit(k)


def sample_rows(df: DataFrame, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Repeatable sample of k rows -- bottom-k of a hash of (id, seed), independent of partitioning."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}")))
    return df.withColumn("_h", h).orderBy("_h").limit(k).drop("_h")
