"""Multi-label evaluation from one long table ``(id, label, y, p)``.

Per-label counts (tp, fp, fn, tn) come from a single conditional-sum aggregate
with map-side partial aggregation; every other metric is arithmetic on those few
rows. Per-sample F1 needs one more grouping by id. The threshold sweep bins
scores into 21 fixed buckets per label inside one aggregate, so its cost does not
grow with the number of thresholds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def _r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def _div(a: Column, b: Column) -> Column:
    """a / b, 0 when b = 0 (scikit-learn's zero_division=0)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def confusion_by_label(long: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Tn, fp, fn, tp per label (and optional extra group columns)."""
    keys = (group or []) + ["label"]
    y, p = F.col("y"), F.col("p")
    return long.groupBy(*keys).agg(
        F.sum(((y == 0) & (p == 0)).cast("bigint")).alias("tn"),
        F.sum(((y == 0) & (p == 1)).cast("bigint")).alias("fp"),
        F.sum(((y == 1) & (p == 0)).cast("bigint")).alias("fn"),
        F.sum(((y == 1) & (p == 1)).cast("bigint")).alias("tp"))


def display_name(label: Column) -> Column:
    """``loaded_language`` -> ``Loaded Language``."""
    return F.initcap(F.regexp_replace(label, "_", " "))


def _label_metrics_raw(long: DataFrame, group: list[str] | None = None) -> DataFrame:
    c = confusion_by_label(long, group)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    pos = tp + fn
    f1 = _div(2 * tp, 2 * tp + fp + fn)
    return c.select(*(group or []), "label", "tp", "fp", "fn", "tn",
                    _div(tp, tp + fp).alias("precision"), _div(tp, tp + fn).alias("recall"),
                    f1.alias("f1"), pos.cast("bigint").alias("support"), _div(tp + tn, n).alias("accuracy"),
                    F.when((pos == 0) | (pos == n), F.lit(None)).otherwise(f1).alias("f1_positive"))


def metrics_by_label(long: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1, support, accuracy per label; the
    positive-class F1 is null when the truth holds one class only."""
    m = _label_metrics_raw(long, group)
    return m.select(*(group or []), "label", display_name(F.col("label")).alias("display_name"),
                    "tp", "fp", "fn", "tn", *[_r6(F.col(x)).alias(x) for x in ("precision", "recall", "f1")],
                    "support", _r6(F.col("accuracy")).alias("accuracy"),
                    _r6(F.col("f1_positive")).alias("f1_positive"))


def _overall_raw(per: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    sup = F.col("support")
    return per.agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        _div(F.sum(tp), F.sum(tp + fp)).alias("micro_precision"),
        _div(F.sum(tp), F.sum(tp + fn)).alias("micro_recall"),
        _div(2 * F.sum(tp), 2 * F.sum(tp) + F.sum(fp) + F.sum(fn)).alias("micro_f1"),
        _div(F.sum(F.col("precision") * sup), F.sum(sup)).alias("weighted_precision"),
        _div(F.sum(F.col("recall") * sup), F.sum(sup)).alias("weighted_recall"),
        _div(F.sum(F.col("f1") * sup), F.sum(sup)).alias("weighted_f1"),
        _div(F.sum(fp + fn), F.sum(tp + fp + fn + tn)).alias("hamming_loss"),
        F.sum(sup).cast("bigint").alias("support"))


def _samples(long: DataFrame) -> DataFrame:
    y, p = F.col("y"), F.col("p")
    per_id = long.groupBy("id").agg(F.sum((y * p).cast("bigint")).alias("i"),
                                     F.sum(y.cast("bigint")).alias("ny"), F.sum(p.cast("bigint")).alias("np"))
    return per_id.agg(F.avg(_div(2 * F.col("i"), F.col("ny") + F.col("np"))).alias("samples_f1"),
                      F.avg(_div(F.col("i"), F.col("np"))).alias("samples_precision"),
                      F.avg(_div(F.col("i"), F.col("ny"))).alias("samples_recall"),
                      F.count(F.lit(1)).cast("bigint").alias("n_samples"))


def _side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row frames side by side: a product of one row with one."""
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


def metrics_overall(long: DataFrame) -> DataFrame:
    """Macro, micro, weighted and per-sample F1 (and P/R), Hamming loss.
    Per-sample F1 is 0 when truth and prediction are both empty (quirk Q22)."""
    o = _side_by_side(_overall_raw(_label_metrics_raw(long)), _samples(long))
    keep = ["macro_precision", "macro_recall", "macro_f1", "micro_precision", "micro_recall", "micro_f1",
            "weighted_f1", "samples_f1", "hamming_loss"]
    return o.select(*[_r6(F.col(x)).alias(x) for x in keep], "n_samples")


def classification_report(long: DataFrame) -> DataFrame:
    """Per-label rows plus micro / macro / weighted / samples average rows."""
    per = _label_metrics_raw(long)
    o = _side_by_side(_overall_raw(per), _samples(long))
    out = per.select(F.col("label").alias("row"), "precision", "recall", "f1", "support")
    for name in ("micro", "macro", "weighted", "samples"):
        out = out.unionByName(o.select(F.lit(f"{name} avg").alias("row"),
                                       F.col(f"{name}_precision").alias("precision"),
                                       F.col(f"{name}_recall").alias("recall"),
                                       F.col(f"{name}_f1").alias("f1"), "support"))
    return out.select("row", *[_r6(F.col(x)).alias(x) for x in ("precision", "recall", "f1")], "support")


# ---- threshold sweep -------------------------------------------------------------

def _bucket20(score: Column) -> Column:
    """Largest k in 0..20 with k / 20 <= score (exact for the boundary values)."""
    k = F.floor(score * 20.0).cast("int")
    k = F.when((k + 1) / 20.0 <= score, k + 1).when(k / 20.0 > score, k - 1).otherwise(k)
    return F.greatest(F.lit(0), F.least(F.lit(20), k))


def threshold_sweep(long_scores: DataFrame, lo: int = 2, hi: int = 18) -> DataFrame:
    """M2: F1 at thresholds k/20 for k in lo..hi (0.10..0.90 step 0.05), rule
    ``score >= threshold``, for every label at once.

    One aggregate per label holds 21 positive and 21 negative counts by score
    bucket; counts at a threshold are suffix sums of those buckets, done in-row.
    """
    b = _bucket20(F.col("score"))
    aggs = []
    for j in range(21):
        aggs.append(F.sum(F.when(b == j, F.col("y")).otherwise(0)).cast("bigint").alias(f"p{j}"))
        aggs.append(F.sum(F.when(b == j, 1 - F.col("y")).otherwise(0)).cast("bigint").alias(f"n{j}"))
    h = long_scores.groupBy("label").agg(*aggs).select(
        "label", F.array(*[F.col(f"p{j}") for j in range(21)]).alias("pa"),
        F.array(*[F.col(f"n{j}") for j in range(21)]).alias("na"))

    def suffix(arr: str, k: Column) -> Column:
        return F.aggregate(F.slice(F.col(arr), k + 1, F.lit(21) - k), F.lit(0).cast("bigint"), lambda a, x: a + x)

    ks = F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("k")
    e = h.select("label", "pa", "na", ks).select(
        "label", "k", suffix("pa", F.col("k")).alias("tp"), suffix("na", F.col("k")).alias("fp"),
        suffix("pa", F.lit(0)).alias("pos"), suffix("na", F.lit(0)).alias("neg"))
    e = e.withColumn("fn", F.col("pos") - F.col("tp"))
    f1 = _div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return e.select("label", _r6(F.col("k") / 20.0).alias("threshold"), "k",
                    F.col("tp").cast("bigint").alias("tp"), F.col("fp").cast("bigint").alias("fp"),
                    F.col("fn").cast("bigint").alias("fn"), _r6(f1).alias("f1"),
                    ((F.col("pos") > 0) & (F.col("neg") > 0)).alias("two_classes"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Per label the threshold with the highest F1, the lowest one on ties;
    0.5 when the validation truth holds one class only."""
    exact = _div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    key = F.struct(exact.alias("f1"), (-F.col("k")).alias("nk"))
    g = sweep.groupBy("label").agg(
        F.max(key).alias("b"),
        F.min("two_classes").alias("two"))
    return g.select("label",
                    F.when(F.col("two"), _r6(-F.col("b.nk") / 20.0)).otherwise(F.lit(0.5)).alias("threshold"),
                    F.when(F.col("two"), _r6(F.col("b.f1"))).alias("val_f1"))


def precision_recall_curve(long_scores: DataFrame) -> DataFrame:
    """M2: (label, threshold, tp, fp, pos, gain, precision, recall, f1) at every distinct score of a label,
    rule ``score >= threshold``; rows of one score are one step, and
    gain is its positive rows. Null scores are left out.

    A sort by range over all tasks, with counts in two passes: sums within a task's stretch of
    a label, plus the sums of the stretches before it. No task holds a whole label, however
    many of the rows it has; the stretches are one row for each task and label."""
    steps = (long_scores.where(F.col("score").isNotNull()).groupBy("label", "score")
             .agg(F.sum(F.col("y").cast("bigint")).alias("p"), F.sum(1 - F.col("y").cast("bigint")).alias("n")))
    order = [F.asc_nulls_first("label"), F.desc("score")]
    steps = checkpointed(steps.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    part, label = Window.partitionBy("part", "label"), Window.partitionBy("label")
    stretch = steps.groupBy("part", "label").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    before = label.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    stretch = stretch.select(F.col("part").alias("_part"), F.col("label").alias("_label"), offset("p").alias("_p"), offset("n").alias("_n"), F.sum("p").over(label).alias("pos"))
    here = part.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select("part", "label", "score", F.col("p").alias("gain"), F.sum("p").over(here).alias("tp"), F.sum("n").over(here).alias("fp"))
    both = steps.join(stretch, (F.col("part") == F.col("_part")) & F.col("label").eqNullSafe(F.col("_label")))
    tp, fp = F.col("tp") + F.col("_p"), F.col("fp") + F.col("_n")
    return both.select("label", F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"), "pos", "gain", _div(tp, tp + fp).alias("precision"),
                       _div(tp, F.col("pos")).alias("recall"), _div(2 * tp, tp + fp + F.col("pos")).alias("f1"))


def curve_summary(curve: DataFrame) -> DataFrame:
    """Per label of a precision-recall curve: average precision (each step's gain in recall times
    its precision) and the threshold of the best F1, the highest one on ties; null without a
    positive row. The gain is read off the counts, so one aggregate does it."""
    best = F.max(F.struct("f1", "threshold"))
    g = curve.groupBy("label").agg(F.count(F.lit(1)).alias("steps"), F.max("pos").alias("pos"), best.alias("b"),
                                   F.sum(F.col("gain") * F.col("precision")).alias("area"))
    some = lambda c: F.when(F.col("pos") > 0, c)
    return g.select("label", "steps", "pos", some(_r6(F.col("area") / F.col("pos"))).alias("average_precision"),
                    some(_r6(F.col("b.threshold"))).alias("threshold"), some(_r6(F.col("b.f1"))).alias("f1"))


def apply_thresholds(long_scores: DataFrame, thresholds: DataFrame, inclusive: bool = True) -> DataFrame:
    """Predict p per (id, label) with that label's threshold (``>=`` by default).
    The thresholds table has one row per label, so its broadcast is bounded by the
    label vocabulary, not by the data."""
    j = long_scores.join(F.broadcast(thresholds.select("label", "threshold")), "label")
    cmp = F.col("score") >= F.col("threshold") if inclusive else F.col("score") > F.col("threshold")
    return j.withColumn("p", cmp.cast("int"))


def rarity_thresholds(class_counts: DataFrame, rare_below: int = 200, rare: float = 0.3,
                      common: float = 0.5) -> DataFrame:
    """M5: 0.3 for classes with fewer than 200 examples, else 0.5."""
    return class_counts.select("label", F.col("count").cast("bigint").alias("count"),
                               F.when(F.col("count") < rare_below, F.lit(rare)).otherwise(F.lit(common))
                               .alias("threshold"))


def metrics_from_logits(df: DataFrame, logits_col: str, labels: list[str], truth_col: str) -> DataFrame:
    """Epoch evaluation from logits: sigmoid, > 0.5, micro/macro F1 and
    Hamming loss; if any logit is NaN the F1s are 0 and Hamming loss 1.0."""
    has_nan = F.exists(F.col(logits_col), lambda x: F.isnan(x))
    rows = F.array(*[F.struct(
        F.lit(lbl).alias("label"),
        F.array_contains(F.coalesce(F.col(truth_col), F.array().cast("array<string>")), lbl).cast("int").alias("y"),
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.get(F.col(logits_col), i))) > 0.5).cast("int").alias("p"))
        for i, lbl in enumerate(labels)])
    long = df.select("id", has_nan.alias("nan"), F.explode(rows).alias("e")).select("id", "nan", "e.*")
    c = long.groupBy("label").agg(
        F.sum((F.col("y") * F.col("p")).cast("bigint")).alias("tp"),
        F.sum(((1 - F.col("y")) * F.col("p")).cast("bigint")).alias("fp"),
        F.sum((F.col("y") * (1 - F.col("p"))).cast("bigint")).alias("fn"),
        F.count(F.lit(1)).alias("n"), F.max(F.col("nan").cast("int")).alias("nan"))
    f1 = _div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    o = c.agg(F.avg(f1).alias("macro"),
              _div(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("micro"),
              _div(F.sum(F.col("fp") + F.col("fn")), F.sum("n")).alias("ham"),
              F.max("nan").alias("nan"))
    bad = F.col("nan") == 1
    return o.select(_r6(F.when(bad, 0.0).otherwise(F.col("micro"))).alias("micro_f1"),
                    _r6(F.when(bad, 0.0).otherwise(F.col("macro"))).alias("macro_f1"),
                    _r6(F.when(bad, 1.0).otherwise(F.col("ham"))).alias("hamming_loss"))


def prediction_detail(long_scores: DataFrame, texts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per (id, label): text preview (100 chars + '...'), truth, score,
    predicted flag (score > threshold)."""
    prev = texts.select("id", F.concat(F.substring("content", 1, 100), F.lit("...")).alias("preview"))
    return long_scores.join(prev, "id").select(
        "id", "label", "preview", "y", _r6(F.col("score")).alias("score"),
        (F.col("score") > threshold).cast("int").alias("predicted"))
