"""Corpus and store statistics (distributions, cross-tabs, co-occurrence, tests).

Every function is ``DataFrame -> DataFrame`` over a posts-shaped frame and runs as
one scan with partial (map-side) aggregation. Totals that a ratio needs are
counted in the same pass as the groups (a marker row per post) instead of a
second scan of the text, and the small grouped result then carries them with a
window over its few rows (bounded by the label vocabulary or language domain).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .. import vocab


def _i64(c: Column) -> Column:
    return c.cast("bigint")


def _r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def null_profile(df: DataFrame) -> DataFrame:
    """G1: rows and null count per column, one row per column (unpivoted)."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in df.columns]
    wide = df.agg(*aggs)
    long = wide.unpivot("__n", df.columns, "column_name", "n_null")
    return long.select("column_name", _i64(F.col("__n")).alias("n_rows"),
                       _i64(F.coalesce("n_null", F.lit(0))).alias("n_null"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count and percent of each value of a low-cardinality column.

    The percent uses a window over the grouped rows, whose number is the number of
    distinct values (a flag or language code), not the number of input rows.
    """
    g = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return g.select(F.col("value").cast("string").alias("value"), _i64(F.col("count")).alias("count"),
                    _r6(F.col("count") * 100.0 / total).alias("percent"))


def crosstab_lang_flag(df: DataFrame) -> DataFrame:
    """Lang x manipulative counts and row percents; a missing cell is 0."""
    t = F.col("manipulative") == F.lit(True)
    f = F.col("manipulative") == F.lit(False)
    g = df.groupBy("lang").agg(F.sum(t.cast("bigint")).alias("n_true"),
                               F.sum(f.cast("bigint")).alias("n_false"))
    n = F.col("n_true") + F.col("n_false")
    return g.select("lang", _i64(F.coalesce("n_false", F.lit(0))).alias("n_false"),
                    _i64(F.coalesce("n_true", F.lit(0))).alias("n_true"),
                    _r6(F.col("n_false") * 100.0 / n).alias("pct_false"),
                    _r6(F.col("n_true") * 100.0 / n).alias("pct_true"))


def _labels_with_post_marker(df: DataFrame, labels_col: str = "techniques") -> DataFrame:
    """One row per (post marker) and per label occurrence; ``is_post`` rows count posts."""
    marker = F.array(F.struct(F.lit(True).alias("is_post"), F.lit(None).cast("string").alias("label")))
    occ = F.transform(F.coalesce(F.col(labels_col), F.array().cast("array<string>")),
                      lambda x: F.struct(F.lit(False).alias("is_post"), x.alias("label")))
    return df.select(F.explode_outer(F.concat(marker, occ)).alias("e")).select("e.is_post", "e.label")


def label_distribution(df: DataFrame) -> DataFrame:
    """Label counts in manipulative posts and percent of manipulative posts."""
    rows = _labels_with_post_marker(df.where(F.col("manipulative")))
    g = rows.groupBy("is_post", "label").agg(F.count(F.lit(1)).alias("count"))
    n_posts = F.max(F.when(F.col("is_post"), F.col("count"))).over(Window.partitionBy())
    out = g.select("is_post", "label", "count", n_posts.alias("n_posts")).where(~F.col("is_post"))
    return out.select("label", _i64(F.col("count")).alias("count"),
                      _r6(F.col("count") * 100.0 / F.col("n_posts")).alias("percent")) \
              .orderBy(F.desc("count"), "label")                      # O1: count desc, name breaks ties


def store_label_stats(store: DataFrame) -> DataFrame:
    """Per label: documents and manipulative documents (empty lists drop out)."""
    e = store.select(F.explode("techniques").alias("label"), "manipulative")
    return e.groupBy("label").agg(
        _i64(F.count(F.lit(1))).alias("count"),
        _i64(F.sum(F.col("manipulative").cast("int"))).alias("manipulative_count")) \
            .orderBy(F.desc("count"), "label")


def store_totals(store: DataFrame) -> DataFrame:
    """Total documents, manipulative documents, ratio (0 when empty)."""
    a = store.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("manipulative").cast("bigint")).alias("m"))
    return a.select(_i64(F.col("n")).alias("total_documents"),
                    _i64(F.coalesce("m", F.lit(0))).alias("manipulative_documents"),
                    _r6(F.when(F.col("n") > 0, F.coalesce("m", F.lit(0)) / F.col("n")).otherwise(0.0))
                    .alias("manipulative_ratio"))


def describe(df: DataFrame, value: Column, measure: str) -> DataFrame:
    """Pandas ``describe``: count, mean, sample std, min, quartiles (linear), max.

    ``percentile`` is exact with linear interpolation (pandas' rule); its buffer
    holds one entry per distinct value, which is small for counts and lengths.
    """
    v = value.cast("double")
    return df.select(v.alias("v")).agg(
        _i64(F.count("v")).alias("count"), _r6(F.avg("v")).alias("mean"),
        _r6(F.stddev_samp("v")).alias("std"), _r6(F.min("v")).alias("min"),
        _r6(F.percentile("v", 0.25)).alias("p25"), _r6(F.percentile("v", 0.5)).alias("p50"),
        _r6(F.percentile("v", 0.75)).alias("p75"), _r6(F.max("v")).alias("max"),
    ).select(F.lit(measure).alias("measure"), "*")


def label_count_describe(df: DataFrame) -> DataFrame:
    """Techniques per manipulative post."""
    return describe(df.where(F.col("manipulative")),
                    F.size(F.coalesce("techniques", F.array())), "techniques_per_manipulative_post")


def trigger_count_describe(df: DataFrame) -> DataFrame:
    """Triggers per post, all posts and manipulative posts (null list -> 0, Q6)."""
    n = F.size(F.coalesce("trigger_words", F.array()))
    return describe(df, n, "triggers_all").unionByName(
        describe(df.where(F.col("manipulative")), n, "triggers_manipulative"))


def label_by_lang(df: DataFrame) -> DataFrame:
    """Label x language counts over manipulative posts (long form)."""
    e = df.where(F.col("manipulative")).select("lang", F.explode("techniques").alias("label"))
    return e.groupBy("label", "lang").agg(_i64(F.count(F.lit(1))).alias("count"))


def _explode_rows(arr_col, name: str):
    """explode() that keeps the optimizer from inferring ``size(arr) > 0`` and
    pushing that copy of the array expression into the scan: explode_outer, then
    drop the null element rows."""
    return F.explode_outer(arr_col).alias(name)


def label_cooccurrence(df: DataFrame) -> DataFrame:
    """Co-occurrence matrix over manipulative posts, diagonal included.

    Pairs are exploded inside each row (at most k^2 per post), never by a self
    join, and counted in one aggregate. Its at most L^2 cells (L = labels seen, a
    bounded vocabulary) are gathered into one row and zero-filled there, so the
    posts are scanned once.
    """
    m = df.where(F.col("manipulative")).select(F.array_distinct("techniques").alias("t"))
    a = m.select(_explode_rows(F.col("t"), "label_a"), "t").where(F.col("label_a").isNotNull())
    pairs = (a.select("label_a", _explode_rows(F.col("t"), "label_b")).where(F.col("label_b").isNotNull())
              .groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("count")))
    sep = "\u0001"
    cells = pairs.agg(F.collect_list(F.struct("label_a", "label_b", "count")).alias("c"))
    cells = cells.select(
        F.array_sort(F.array_distinct(F.transform("c", lambda x: x["label_a"]))).alias("labs"),
        F.map_from_entries(F.transform("c", lambda x: F.struct(
            F.concat(x["label_a"], F.lit(sep), x["label_b"]), x["count"]))).alias("m"))
    z = F.arrays_zip(F.col("labs").alias("a"), F.array_repeat(F.struct("labs", "m"), F.size("labs")).alias("ctx"))
    grid = F.flatten(F.transform(z, lambda e: F.transform(e["ctx"]["labs"], lambda b: F.struct(
        e["a"].alias("label_a"), b.alias("label_b"),
        F.coalesce(F.try_element_at(e["ctx"]["m"], F.concat(e["a"], F.lit(sep), b)), F.lit(0)).alias("count")))))
    return cells.select(F.explode(grid).alias("g")).select(
        "g.label_a", "g.label_b", _i64(F.col("g.count")).alias("count"))


def label_count_histogram(df: DataFrame) -> DataFrame:
    """Number of manipulative posts by number of labels."""
    n = F.size(F.coalesce("techniques", F.array()))
    return (df.where(F.col("manipulative")).groupBy(_i64(n).alias("n_techniques"))
              .agg(_i64(F.count(F.lit(1))).alias("n_posts")))


def length_box_stats(df: DataFrame) -> DataFrame:
    """Box statistics of content length (code points) by flag."""
    ln = F.length(F.coalesce("content", F.lit(""))).cast("double")
    return df.select("manipulative", ln.alias("len")).groupBy("manipulative").agg(
        _i64(F.count(F.lit(1))).alias("n"), _r6(F.min("len")).alias("min"),
        _r6(F.percentile("len", 0.25)).alias("q1"), _r6(F.percentile("len", 0.5)).alias("median"),
        _r6(F.percentile("len", 0.75)).alias("q3"), _r6(F.max("len")).alias("max"),
        _r6(F.avg("len")).alias("mean"))


def label_trigger_points(df: DataFrame) -> DataFrame:
    """(labels per post, triggers per post) scatter points with counts."""
    m = df.where(F.col("manipulative"))
    x = _i64(F.size(F.coalesce("techniques", F.array())))
    y = _i64(F.size(F.coalesce("trigger_words", F.array())))
    return m.groupBy(x.alias("n_techniques"), y.alias("n_triggers")).agg(
        _i64(F.count(F.lit(1))).alias("n_posts"))


def label_trigger_corr(df: DataFrame) -> DataFrame:
    """Pearson correlation of labels per post and triggers per post."""
    m = df.where(F.col("manipulative"))
    x = F.size(F.coalesce("techniques", F.array())).cast("double")
    y = F.size(F.coalesce("trigger_words", F.array())).cast("double")
    return m.select(x.alias("x"), y.alias("y")).agg(
        _i64(F.count(F.lit(1))).alias("n_posts"), _r6(F.corr("x", "y")).alias("corr"))


# ---- tests of independence / difference ----------------------------------------

def chi2_sf(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution: regularised gamma Q(dof/2, x/2)."""
    if x is None or dof is None or dof <= 0 or (isinstance(x, float) and math.isnan(x)):
        return float("nan")
    return _gamma_q(dof / 2.0, x / 2.0)


def _gamma_q(a: float, x: float) -> float:
    if x <= 0:
        return 1.0
    lg = math.lgamma(a)
    if x < a + 1.0:  # series for P, then Q = 1 - P
        term = total = 1.0 / a
        ap = a
        for _ in range(10000):
            ap += 1.0
            term *= x / ap
            total += term
            if abs(term) < abs(total) * 1e-15:
                break
        return max(0.0, 1.0 - total * math.exp(-x + a * math.log(x) - lg))
    # continued fraction for Q (modified Lentz)
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - lg) * h


def student_t_sf2(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t: I_{dof/(dof+t^2)}(dof/2, 1/2)."""
    if t is None or dof is None or dof <= 0 or math.isnan(t):
        return float("nan")
    x = dof / (dof + t * t)
    return _betainc(dof / 2.0, 0.5, x)


def _betainc(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log(1 - x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _betainc(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (tiny if abs(d) < tiny else d)
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        num = m * (b - m) * x / ((a + m2 - 1) * (a + m2))
        d = 1.0 + num * d
        d = 1.0 / (tiny if abs(d) < tiny else d)
        c = 1.0 + num / c
        c = tiny if abs(c) < tiny else c
        h *= d * c
        num = -(a + m) * (a + b + m) * x / ((a + m2) * (a + m2 + 1))
        d = 1.0 + num * d
        d = 1.0 / (tiny if abs(d) < tiny else d)
        c = 1.0 + num / c
        c = tiny if abs(c) < tiny else c
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return front * h / a


@F.pandas_udf(DoubleType())
def _chi2_sf_udf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(a, int(b)) if pd.notna(a) and pd.notna(b) else float("nan")
                      for a, b in zip(x, dof)])


@F.pandas_udf(DoubleType())
def _t_sf2_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([student_t_sf2(a, b) if pd.notna(a) and pd.notna(b) else float("nan")
                      for a, b in zip(t, dof)])


def chi_square(df: DataFrame, row: str, col: str, with_p: bool = True) -> DataFrame:
    """Chi-square test of independence of two categorical columns.

    One grouped pass counts the observed cells. The r x c grid is zero-filled by
    exploding the distinct row and column values inside one row (the domains of
    two categorical columns), then expected counts come from the margins. Yates'
    correction applies when dof = 1, as in scipy's default.
    """
    src = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    cells = src.groupBy(F.col(row).cast("string").alias("r"), F.col(col).cast("string").alias("c")) \
               .agg(F.count(F.lit(1)).cast("double").alias("o"))
    dom = cells.agg(F.collect_set("r").alias("rs"), F.collect_set("c").alias("cs"))
    grid = dom.select(F.explode("rs").alias("r"), "cs").select("r", F.explode("cs").alias("c"))
    full = grid.join(cells, ["r", "c"], "left").select("r", "c", F.coalesce("o", F.lit(0.0)).alias("o"))
    w = Window.partitionBy()
    full = full.select(
        "o", F.sum("o").over(Window.partitionBy("r")).alias("rt"),
        F.sum("o").over(Window.partitionBy("c")).alias("ct"), F.sum("o").over(w).alias("n"),
        F.size(F.collect_set("r").over(w)).alias("nr"), F.size(F.collect_set("c").over(w)).alias("nc"))
    dof = (F.col("nr") - 1) * (F.col("nc") - 1)
    e = F.col("rt") * F.col("ct") / F.col("n")
    o_adj = F.when(dof == 1, F.col("o") + F.signum(e - F.col("o")) * F.least(F.lit(0.5), F.abs(e - F.col("o")))) \
             .otherwise(F.col("o"))
    part = full.select(((o_adj - e) * (o_adj - e) / e).alias("q"), dof.alias("dof"))
    out = part.agg(_r6(F.sum("q")).alias("statistic"), _i64(F.first("dof")).alias("dof"))
    if with_p:
        out = out.withColumn("p_value", _r6(_chi2_sf_udf(F.col("statistic"), F.col("dof"))))
    return out


def t_test(df: DataFrame, value: Column, group: Column, with_p: bool = True) -> DataFrame:
    """Two-sample t-test with pooled variance (scipy ttest_ind default);
    sample 1 is ``group = true``."""
    g = df.select(value.cast("double").alias("v"), group.alias("g")).agg(
        F.count(F.when(F.col("g"), F.col("v"))).alias("n1"),
        F.avg(F.when(F.col("g"), F.col("v"))).alias("m1"),
        F.var_samp(F.when(F.col("g"), F.col("v"))).alias("v1"),
        F.count(F.when(~F.col("g"), F.col("v"))).alias("n2"),
        F.avg(F.when(~F.col("g"), F.col("v"))).alias("m2"),
        F.var_samp(F.when(~F.col("g"), F.col("v"))).alias("v2"))
    dof = F.col("n1") + F.col("n2") - 2
    sp2 = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / dof
    t = (F.col("m1") - F.col("m2")) / F.sqrt(sp2 * (1.0 / F.col("n1") + 1.0 / F.col("n2")))
    out = g.select(_r6(t).alias("t_statistic"), _i64(dof).alias("dof"),
                   _r6(F.col("m1")).alias("mean_1"), _r6(F.col("m2")).alias("mean_2"))
    if with_p:
        out = out.withColumn("p_value", _r6(_t_sf2_udf(F.col("t_statistic"), F.col("dof").cast("double"))))
    return out


# ---- label counts and weights ----------------------------------------------------

def label_positives(df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Positives per label (one aggregate, no explode) and posts with no label."""
    labels = labels or vocab.CANONICAL_LABELS
    t = F.coalesce("techniques", F.array().cast("array<string>"))
    aggs = [F.sum(F.array_contains(t, lbl).cast("bigint")).alias(lbl) for lbl in labels]
    aggs.append(F.sum((F.size(t) == 0).cast("bigint")).alias("__none"))
    aggs.append(F.count(F.lit(1)).alias("__n"))
    wide = df.agg(*aggs)
    long = wide.unpivot(["__none", "__n"], labels, "label", "positives")
    return long.select("label", _i64(F.col("positives")).alias("positives"),
                       _i64(F.col("__none")).alias("posts_without_label"),
                       _i64(F.col("__n")).alias("n_posts"))


def class_weights_balanced(df: DataFrame, labels_col: str = "techniques") -> DataFrame:
    """N / (k * count) per learned class; an empty list counts as class 'none'."""
    t = F.col(labels_col)
    t = F.when(F.size(F.coalesce(t, F.array())) == 0, F.array(F.lit("none"))).otherwise(F.array_distinct(t))
    rows = _labels_with_post_marker(df.select(t.alias("t")), "t")
    g = rows.groupBy("is_post", "label").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy()
    n = F.max(F.when(F.col("is_post"), F.col("count"))).over(w)
    k = F.sum(F.when(~F.col("is_post"), 1).otherwise(0)).over(w)
    out = g.select("is_post", "label", "count", n.alias("n"), k.alias("k")).where(~F.col("is_post"))
    return out.select("label", _i64(F.col("count")).alias("count"),
                      _r6(F.col("n") / (F.col("k") * F.col("count"))).alias("weight"))


def pos_weights(df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Negatives / (positives + 1e-6) per label."""
    p = label_positives(df, labels)
    neg = F.col("n_posts") - F.col("positives")
    return p.select("label", "positives", _i64(neg).alias("negatives"),
                    _r6(neg / (F.col("positives") + F.lit(1e-6))).alias("pos_weight"))


def label_vocabulary(df: DataFrame) -> DataFrame:
    """Distinct languages and distinct labels, each sorted (long form)."""
    langs = df.select(F.lit("lang").alias("kind"), F.col("lang").alias("value")).distinct()
    labs = df.select(F.lit("label").alias("kind"), F.explode("techniques").alias("value")).distinct()
    u = langs.unionByName(labs)
    return u.select("kind", "value", _i64(F.row_number().over(
        Window.partitionBy("kind").orderBy("value"))).alias("rank"))
