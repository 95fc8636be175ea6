"""Evaluation queries (E1-E11, M2, M5, W3, O4) over the stored-scores fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions.hashing import duck_seeded_bucket
from ..operators import metrics as ME
from ..operators import split as S
from ..operators import stats
from ..sources import fixtures
from .common import r6
from .registry import register
from .sqlviews import with_views

SC = with_views("scores")
B = duck_seeded_bucket("id")


def _counts_sql(src: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    return (f"SELECT {g}label, "
            "CAST(sum(CASE WHEN y = 0 AND p = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn, "
            "CAST(sum(CASE WHEN y = 0 AND p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
            "CAST(sum(CASE WHEN y = 1 AND p = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, "
            "CAST(sum(CASE WHEN y = 1 AND p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp "
            f"FROM {src} GROUP BY {g}label")


def _raw_sql(src: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    f1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END"
    return (f"SELECT {g}label, tp, fp, fn, tn, "
            "CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, "
            "CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall, "
            f"{f1} AS f1, CAST(tp + fn AS BIGINT) AS support, "
            "CASE WHEN tp + fp + fn + tn = 0 THEN 0.0 ELSE (tp + tn) / (tp + fp + fn + tn) END AS accuracy, "
            f"CASE WHEN tp + fn = 0 OR tp + fn = tp + fp + fn + tn THEN NULL ELSE {f1} END AS f1_positive "
            f"FROM ({_counts_sql(src, group)})")


DISPLAY = ("array_to_string(list_transform(string_split(replace(label, '_', ' '), ' '), "
           "lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')")


def _by_label_sql(src: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    return (f"SELECT {g}label, {DISPLAY} AS display_name, tp, fp, fn, tn, {r6('precision')} AS precision, "
            f"{r6('recall')} AS recall, {r6('f1')} AS f1, support, {r6('accuracy')} AS accuracy, "
            f"{r6('f1_positive')} AS f1_positive FROM ({_raw_sql(src, group)})")


_OVERALL = ("SELECT avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1, "
            "sum(tp) / sum(tp + fp) AS micro_precision, sum(tp) / sum(tp + fn) AS micro_recall, "
            "2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS micro_f1, "
            "sum(precision * support) / sum(support) AS weighted_precision, "
            "sum(recall * support) / sum(support) AS weighted_recall, "
            "sum(f1 * support) / sum(support) AS weighted_f1, "
            "sum(fp + fn) / sum(tp + fp + fn + tn) AS hamming_loss, CAST(sum(support) AS BIGINT) AS support FROM lm")
_SAMPLES = ("SELECT avg(CASE WHEN ny + np = 0 THEN 0.0 ELSE 2 * i / (ny + np) END) AS samples_f1, "
            "avg(CASE WHEN np = 0 THEN 0.0 ELSE i / np END) AS samples_precision, "
            "avg(CASE WHEN ny = 0 THEN 0.0 ELSE i / ny END) AS samples_recall, count(*) AS n_samples FROM "
            "(SELECT id, sum(y * p) AS i, sum(y) AS ny, sum(p) AS np FROM scores GROUP BY id)")
OV = with_views("scores", extra=[("lm", _raw_sql("scores")), ("o", _OVERALL), ("smp", _SAMPLES)])


def _scores(spark, sf):
    return fixtures.scores(spark, sf)


@register("metrics_by_label", covers="E1 E4 E5 E11 O4", sql=SC + _by_label_sql("scores"))
def q_e1(spark, sf):
    return ME.metrics_by_label(_scores(spark, sf)).orderBy(F.desc("f1"), "label")      # O4


@register("confusion_by_label", covers="E6", sql=SC + _counts_sql("scores"))
def q_e6(spark, sf):
    return ME.confusion_by_label(_scores(spark, sf))


@register("metrics_overall", covers="E2 E3 Q22", sql=OV + "SELECT " + ", ".join(
    f"{r6(x)} AS {x}" for x in ["macro_precision", "macro_recall", "macro_f1", "micro_precision", "micro_recall",
                                "micro_f1", "weighted_f1", "samples_f1", "hamming_loss"]) + ", n_samples FROM o, smp")
def q_e2(spark, sf):
    return ME.metrics_overall(_scores(spark, sf))


@register("classification_report", covers="E7", sql=OV + "SELECT row, " + ", ".join(
    f"{r6(x)} AS {x}" for x in ("precision", "recall", "f1")) + ", support FROM ("
    "SELECT label AS row, precision, recall, f1, support FROM lm " + "".join(
        f"UNION ALL SELECT '{n} avg', {n}_precision, {n}_recall, {n}_f1, support FROM o, smp "
        for n in ("micro", "macro", "weighted", "samples")) + ")")
def q_e7(spark, sf):
    return ME.classification_report(_scores(spark, sf))


SPLIT_SQL = (f"SELECT s.*, CASE WHEN {B} < 60 THEN 'train' WHEN {B} < 80 THEN 'val' ELSE 'test' END AS split "
             "FROM scores s")


@register("metrics_by_split", covers="E8", sql=with_views("scores", extra=[("ss", SPLIT_SQL)])
          + _by_label_sql("ss", "split"))
def q_e8(spark, sf):
    return ME.metrics_by_label(S.split_60_20_20(_scores(spark, sf)), ["split"])


_SV = with_views("posts", extra=[("sv", "SELECT id, techniques, list_transform(%s, lambda l: "
                                  "(CAST(0.55 AS DOUBLE) * CAST(list_contains(techniques, l) AS INTEGER) + "
                                  "CAST(0.45 AS DOUBLE) * (('0x' || substr(md5(id || l), 1, 8))::BIGINT / 4294967296.0) - 0.5) * 8.0) "
                                  "AS logits FROM posts" % vocab.sql_str_array(vocab.CANONICAL_LABELS, duck=True))])


@register("metrics_from_logits", covers="E9", sql=_SV + """
, lg AS (SELECT id, label, CAST(list_contains(coalesce(techniques, []), label) AS INTEGER) AS y,
                CAST(1.0 / (1.0 + exp(-logits[i])) > 0.5 AS INTEGER) AS p, isnan(logits[i]) AS nan
         FROM (SELECT id, techniques, logits, unnest(%s) AS label, generate_subscripts(%s, 1) AS i FROM sv)),
c AS (SELECT label, sum(y * p) AS tp, sum((1 - y) * p) AS fp, sum(y * (1 - p)) AS fn, count(*) AS n,
             max(CAST(nan AS INTEGER)) AS nan FROM lg GROUP BY label)
SELECT %s AS micro_f1, %s AS macro_f1, %s AS hamming_loss FROM (
  SELECT 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS micro,
         avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END) AS macro,
         sum(fp + fn) / sum(n) AS ham, max(nan) AS nan FROM c)""" % (
    vocab.sql_str_array(vocab.CANONICAL_LABELS, duck=True), vocab.sql_str_array(vocab.CANONICAL_LABELS, duck=True),
    r6("CASE WHEN nan = 1 THEN 0.0 ELSE micro END"), r6("CASE WHEN nan = 1 THEN 0.0 ELSE macro END"),
    r6("CASE WHEN nan = 1 THEN 1.0 ELSE ham END")))
def q_e9(spark, sf):
    return ME.metrics_from_logits(fixtures.score_vectors(spark, sf), "logits", vocab.CANONICAL_LABELS, "techniques")


@register("prediction_detail", covers="E10 P8", sql=SC + f"""
SELECT s.id, s.label, substr(p.content, 1, 100) || '...' AS preview, s.y, {r6('s.score')} AS score,
       CAST(s.score > 0.5 AS INTEGER) AS predicted FROM scores s JOIN posts p ON s.id = p.id""")
def q_e10(spark, sf):
    return ME.prediction_detail(_scores(spark, sf), fixtures.posts(spark, sf).select("id", "content"))


VAL_SQL = f"SELECT * FROM scores WHERE {B} >= 60 AND {B} < 80"
SWEEP_SQL = ("SELECT label, k, CAST(sum(CASE WHEN y = 1 AND score >= CAST(k AS DOUBLE) / 20.0 THEN 1 ELSE 0 END) AS BIGINT) AS tp, "
             "CAST(sum(CASE WHEN y = 0 AND score >= CAST(k AS DOUBLE) / 20.0 THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
             "CAST(sum(CASE WHEN y = 1 AND score < CAST(k AS DOUBLE) / 20.0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, "
             "sum(y) AS pos, sum(1 - y) AS neg FROM val CROSS JOIN (SELECT CAST(unnest(range(2, 19)) AS INTEGER) AS k) ks "
             "GROUP BY label, k")
F1X = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END"
BEST_SQL = (f"SELECT label, CASE WHEN two THEN round(k / 20.0, 6) ELSE 0.5 END AS threshold, "
            f"CASE WHEN two THEN {r6('f1')} END AS val_f1 FROM ("
            f"SELECT label, k, {F1X} AS f1, bool_and(pos > 0 AND neg > 0) OVER (PARTITION BY label) AS two, "
            f"row_number() OVER (PARTITION BY label ORDER BY {F1X} DESC, k) AS rn FROM sw) WHERE rn = 1")
SW = with_views("scores", extra=[("val", VAL_SQL), ("sw", SWEEP_SQL)])


def _sweep(spark, sf):
    sc = S.split_60_20_20(_scores(spark, sf)).where(F.col("split") == "val")
    return ME.threshold_sweep(sc)


@register("threshold_sweep", covers="M2", sql=SW + f"""
SELECT label, round(k / 20.0, 6) AS threshold, k, tp, fp, fn, {r6(F1X)} AS f1, (pos > 0 AND neg > 0) AS two_classes FROM sw""")
def q_m2(spark, sf):
    return _sweep(spark, sf)


@register("best_threshold", covers="W3", sql=SW + BEST_SQL)
def q_w3(spark, sf):
    return ME.best_threshold(_sweep(spark, sf))


CURVE = with_views("scores", extra=[
    ("step", "SELECT label, score, CAST(sum(y) AS BIGINT) AS gain, CAST(sum(1 - y) AS BIGINT) AS lose FROM scores WHERE score IS NOT NULL GROUP BY label, score"),
    ("curve", "SELECT label, score, gain, CAST(sum(gain) OVER w AS BIGINT) AS tp, CAST(sum(lose) OVER w AS BIGINT) AS fp, "
              "CAST(sum(gain) OVER (PARTITION BY label) AS BIGINT) AS pos FROM step WINDOW w AS (PARTITION BY label ORDER BY score DESC)")])


@register("precision_recall_curve", covers="M2", sql=CURVE + f"""
SELECT label, {r6('score')} AS threshold, tp, fp, pos, gain, {r6('tp / (tp + fp)')} AS "precision",
       {r6('CASE WHEN pos = 0 THEN 0.0 ELSE tp / pos END')} AS recall, {r6('2 * tp / (tp + fp + pos)')} AS f1 FROM curve""")
def q_curve(spark, sf):
    """Every step of every label's curve over all rows."""
    c = ME.precision_recall_curve(_scores(spark, sf))
    return c.select("label", "tp", "fp", "pos", "gain", *[F.round(x, 6).alias(x) for x in ("threshold", "precision", "recall", "f1")])


@register("average_precision", covers="M2", sql=CURVE + f"""
SELECT label, count(*) AS steps, max(pos) AS pos, CASE WHEN max(pos) > 0 THEN {r6('sum(gain * (tp / (tp + fp))) / max(pos)')} END AS average_precision,
       CASE WHEN max(pos) > 0 THEN {r6('arg_max(score, struct_pack(f := 2 * tp / (tp + fp + pos), s := score))')} END AS threshold,
       CASE WHEN max(pos) > 0 THEN {r6('max(2 * tp / (tp + fp + pos))')} END AS f1 FROM curve GROUP BY label""")
def q_area(spark, sf):
    """Area under every label's curve and its best threshold among all scores."""
    return ME.curve_summary(ME.precision_recall_curve(_scores(spark, sf)))


TUNED = with_views("scores", extra=[
    ("val", VAL_SQL), ("sw", SWEEP_SQL), ("best", BEST_SQL),
    ("tst", f"SELECT s.id, s.label, s.y, CAST(s.score >= b.threshold AS INTEGER) AS p FROM scores s "
            f"JOIN best b ON s.label = b.label WHERE {B} >= 80")])


@register("tuned_test_metrics", covers="M2 W3 E1", sql=TUNED + _by_label_sql("tst"))
def q_tuned(spark, sf):
    sc = S.split_60_20_20(_scores(spark, sf))
    best = ME.best_threshold(ME.threshold_sweep(sc.where(F.col("split") == "val")))
    tst = ME.apply_thresholds(sc.where(F.col("split") == "test").drop("p"), best)
    return ME.metrics_by_label(tst.select("id", "label", "y", "p"))


@register("rarity_threshold", covers="M5", sql=with_views("store") + """
SELECT label, count, CAST(CASE WHEN count < 200 THEN 0.3 ELSE 0.5 END AS DOUBLE) AS threshold FROM (
  SELECT label, count(*) AS count FROM (SELECT unnest(CASE WHEN len(coalesce(techniques, [])) = 0 THEN ['none']
  ELSE list_distinct(techniques) END) AS label FROM store) GROUP BY label)""")
def q_m5(spark, sf):
    counts = stats.class_weights_balanced(fixtures.store(spark, sf)).select("label", "count")
    return ME.rarity_thresholds(counts)
