"""Label normalisation and model-output parsing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions import labels as LF
from ..operators import labels as LO
from ..sources import conv_text, fixtures
from . import duckfn as D
from .common import arr_str
from .registry import register
from .sqlviews import with_views
from ..vocab import sql_str

LT = with_views("label_text")
RP = with_views("raw_predictions")


def _lt(spark, sf):
    return fixtures.label_text(spark, sf)


@register("labels_bracket_split", covers="L1", sql=LT + f"""
SELECT id, array_to_string({D.bracket_split('techniques_text')}, ',') AS labels FROM label_text""")
def q_l1(spark, sf):
    return _lt(spark, sf).select("id", arr_str(LF.labels_bracket_split(F.col("techniques_text"))).alias("labels"))


@register("labels_quoted", covers="L2", sql=LT + f"""
SELECT id, array_to_string({D.quoted_or_single('techniques_text')}, ',') AS labels FROM label_text""")
def q_l2(spark, sf):
    return _lt(spark, sf).select("id", arr_str(LF.labels_quoted_or_single(F.col("techniques_text"))).alias("labels"))


@register("labels_canonical", covers="L3 Q5 Q14", sql=LT + f"""
SELECT id, array_to_string({D.canonical('techniques_text')}, ',') AS labels FROM label_text""")
def q_l3(spark, sf):
    return _lt(spark, sf).select("id", arr_str(LF.labels_canonical(F.col("techniques_text"))).alias("labels"))


@register("labels_quote_delimited", covers="L4", sql=LT + f"""
, t AS (SELECT id, {D.quote_delimited('techniques_text')} AS toks FROM label_text)
SELECT id, {D.multi_hot_str('toks', vocab.SUBMISSION_LABELS)} AS multi_hot,
       array_to_string(list_filter(toks, lambda x: NOT list_contains({D.canon()}, x)), ',') AS unknown
FROM t""")
def q_l4(spark, sf):
    toks = LF.quote_delimited_tokens(F.col("techniques_text"))
    df = _lt(spark, sf).select("id", toks.alias("toks"))
    mh = F.transform(LF.multi_hot(F.col("toks"), vocab.SUBMISSION_LABELS), lambda x: x.cast("string"))
    unk = F.filter("toks", lambda x: ~F.array_contains(F.array(*[F.lit(v) for v in vocab.CANONICAL_LABELS]), x))
    return df.select("id", F.array_join(mh, ",").alias("multi_hot"), F.array_join(unk, ",").alias("unknown"))


@register("labels_alias", covers="L5 Q15 Q21", sql=LT + f"""
SELECT id, array_to_string({D.labels_alias('techniques_text')}, ',') AS labels FROM label_text""")
def q_l5(spark, sf):
    return _lt(spark, sf).select("id", arr_str(LF.labels_alias(F.col("techniques_text"))).alias("labels"))


def _strict_sql() -> str:
    st = D.py_strip("raw_prediction")
    lowv = D.canon()
    parts = (f"CASE WHEN starts_with({st}, '[''') AND suffix({st}, ''']') "
             f"THEN regexp_extract_all({st}, '''(.*?)''', 1) ELSE string_split({st}, ',') END")
    return (
        "SELECT id, raw_prediction, blank, "
        "(NOT blank AND (has_err OR malformed OR unknown)) AS is_exception, "
        "CASE WHEN blank THEN [] WHEN NOT (has_err OR malformed OR unknown) THEN list_sort(list_distinct(cleaned)) END AS labels "
        "FROM (SELECT id, raw_prediction, blank, has_err, "
        f"(bracket AND len(parts) = 0 AND length({st}) > 2) AS malformed, cleaned, "
        f"len(list_filter(cleaned, lambda p: NOT list_contains({lowv}, p))) > 0 AS unknown "
        "FROM (SELECT id, raw_prediction, "
        f"(raw_prediction IS NULL OR {st} = '') AS blank, "
        f"instr(raw_prediction, {sql_str(vocab.GENERATION_ERROR)}) > 0 AS has_err, "
        f"(starts_with({st}, '[''') AND suffix({st}, ''']')) AS bracket, ({parts}) AS parts, "
        f"list_filter(list_transform(({parts}), lambda p: lower({D.py_strip('p')})), lambda p: p <> '') AS cleaned "
        "FROM raw_predictions) a) b"
    )


S1 = with_views("raw_predictions", extra=[("s1", _strict_sql())])


@register("parse_output_strict", covers="L6 Q18", sql=S1 + """
SELECT id, is_exception, array_to_string(labels, ',') AS labels FROM s1""")
def q_l6(spark, sf):
    df = LO.parse_output_strict(fixtures.raw_predictions(spark, sf))
    return df.select("id", "is_exception", arr_str("labels").alias("labels"))


_RX = LO.label_regex(vocab.CANONICAL_LABELS)
S2 = with_views("raw_predictions", extra=[
    ("s1", _strict_sql()),
    ("s2", "SELECT id, raw_prediction, list_sort(list_distinct(regexp_extract_all(lower(coalesce(raw_prediction, '')), "
           f"{sql_str(_RX)}, 1))) AS labels FROM s1 WHERE is_exception"),
    ("stages", "SELECT id, labels, 1 AS stage FROM s1 WHERE NOT is_exception "
             "UNION ALL SELECT id, labels, 2 AS stage FROM s2 WHERE len(labels) > 0"),
    ("final", "SELECT id, labels FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stage) AS rn FROM stages) WHERE rn = 1"),
])


@register("parse_output_two_stage", covers="L7 W2 U2 L10 M8", sql=S2 + "SELECT id, " + ", ".join(
    f"CAST(list_contains(coalesce(labels, []), '{x}') AS INTEGER) AS {x}" for x in vocab.SUBMISSION_LABELS) + " FROM final")
def q_l7(spark, sf):
    final, _ = LO.two_stage_parse(fixtures.raw_predictions(spark, sf))
    return LO.wide_labels(final, "labels", vocab.SUBMISSION_LABELS)


@register("exceptions_with_content", covers="J5", sql=S2 + f"""
SELECT s2.id, s2.raw_prediction, coalesce(p.content, {sql_str(vocab.CONTENT_NOT_FOUND)}) AS content
FROM s2 LEFT JOIN posts p ON s2.id = p.id WHERE len(s2.labels) = 0""")
def q_j5(spark, sf):
    _, exc = LO.two_stage_parse(fixtures.raw_predictions(spark, sf))
    content = fixtures.posts(spark, sf).select("id", "content")
    return LO.attach_content(exc, content)


@register("multi_hot", covers="L8 L17", sql=with_views("posts") + f"""
SELECT id, {D.multi_hot_str('techniques', vocab.CANONICAL_LABELS)} AS multi_hot FROM posts""")
def q_l8(spark, sf):
    p = fixtures.posts(spark, sf)
    mh = F.transform(LF.multi_hot(F.col("techniques"), vocab.CANONICAL_LABELS), lambda x: x.cast("string"))
    return p.select("id", F.array_join(mh, ",").alias("multi_hot"))


@register("multi_hot_learned", covers="L9", sql=with_views("store") + """
, t AS (SELECT id, CASE WHEN len(coalesce(techniques, [])) = 0 THEN ['none'] ELSE techniques END AS t FROM store),
c AS (SELECT list_sort(list_distinct(flatten(list(t)))) AS classes FROM t)
SELECT id, array_to_string(list_transform(classes, lambda v: CAST(CAST(list_contains(t, v) AS INTEGER) AS VARCHAR)), ',') AS multi_hot,
       array_to_string(classes, ',') AS classes FROM t, c""")
def q_l9(spark, sf):
    s = fixtures.store(spark, sf)
    df, classes = LO.multi_hot_learned(s)
    return df.select("id", F.array_join(F.transform("y", lambda x: x.cast("string")), ",").alias("multi_hot"),
                     F.lit(",".join(classes)).alias("classes"))


@register("multi_hot_sparse", covers="L9", sql=with_views("store") + """
, t AS (SELECT id, CASE WHEN len(coalesce(techniques, [])) = 0 THEN ['none'] ELSE techniques END AS t FROM store),
c AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS place FROM (SELECT DISTINCT unnest(t) AS label FROM t))
SELECT id, string_agg(DISTINCT place, ',' ORDER BY place) AS places FROM (SELECT id, unnest(t) AS label FROM t) JOIN c USING (label) GROUP BY id""")
def q_l9_sparse(spark, sf):
    """The non-zero columns of every row's vector over all learned classes."""
    s = fixtures.store(spark, sf)
    return LO.multi_hot_sparse(s, LO.class_index(s)).select("id", F.array_join(F.transform("places", lambda x: x.cast("string")), ",").alias("places"))


SUB = with_views("submitted")


@register("submission_wide", covers="L10 P16 S7", sql=SUB + "SELECT id, " + ", ".join(
    f"CAST(list_contains(coalesce(techniques, []), '{x}') AS INTEGER) AS {x}" for x in vocab.SUBMISSION_LABELS)
    + " FROM submitted")
def q_l10(spark, sf):
    sub = fixtures.submitted_ids(spark, sf)
    wide = LO.wide_labels(sub, "techniques", vocab.SUBMISSION_LABELS)
    return LO.reorder_columns(wide, ["id"] + vocab.SUBMISSION_LABELS)


SV = with_views("posts", extra=[("sv", "SELECT id, techniques, list_transform(%s, lambda l: (CAST(0.55 AS DOUBLE) * CAST(list_contains(techniques, l) AS INTEGER) + CAST(0.45 AS DOUBLE) * %s - 0.5) * 8.0) AS logits FROM posts" % (
    D.canon(), "(('0x' || substr(md5(id || l), 1, 8))::BIGINT / 4294967296.0)"))])


@register("scores_to_labels", covers="L11 A11 M6 Q17", sql=SV + """
SELECT id, array_to_string(list_filter(%s, lambda t, i: 1.0 / (1.0 + exp(-logits[i])) > 0.5), ',') AS labels,
       array_to_string(techniques, ',') AS truth FROM sv""" % D.canon())
def q_l11(spark, sf):
    sv = fixtures.score_vectors(spark, sf)
    df = LO.scores_to_labels(sv, "logits", vocab.CANONICAL_LABELS, 0.5, inclusive=False)
    return df.select("id", arr_str("labels").alias("labels"), arr_str("techniques").alias("truth"))


@register("unknown_labels", covers="L12 L18", sql=LT + f"""
SELECT label, count(*) AS count FROM (SELECT unnest(list_filter({D.bracket_split('techniques_text')},
    lambda x: NOT list_contains({D.canon()}, x))) AS label FROM label_text) GROUP BY label""")
def q_l12(spark, sf):
    df = _lt(spark, sf).select(LF.labels_bracket_split(F.col("techniques_text")).alias("labels"))
    return LO.unknown_label_audit(df, "labels")


@register("label_length_check", covers="L13", sql=LT + f"""
SELECT count(*) AS n_rows, CAST(sum(CASE WHEN len(list_transform({D.canon(vocab.SUBMISSION_LABELS)}, lambda v: list_contains({D.quote_delimited('techniques_text')}, v))) <> 10 THEN 1 ELSE 0 END) AS BIGINT) AS n_wrong_length FROM label_text""")
def q_l13(spark, sf):
    df = _lt(spark, sf).select(LF.multi_hot(LF.quote_delimited_tokens(F.col("techniques_text")),
                                            vocab.SUBMISSION_LABELS, as_double=True).alias("y"))
    return LO.label_length_check(df, "y", len(vocab.SUBMISSION_LABELS))


@register("numbered_list_rows", covers="L15 O2", sql=with_views() + f"""
SELECT conv_id, turn, CAST(pos AS BIGINT) AS item, example FROM (
  SELECT conv_id, turn, unnest(items) AS example, generate_subscripts(items, 1) AS pos FROM (
    SELECT conv_id, turn, list_filter(list_transform(string_split({D.py_strip('text')}, chr(10)),
        lambda ln: {D.py_strip(D.rx(D.py_strip('ln'), r'^\d+\.\s*'))}), lambda x: x <> '') AS items
    FROM conversations WHERE role = 'assistant')) WHERE pos <= 25""")
def q_l15(spark, sf):
    conv = conv_text.assistant_turns(spark, sf)
    return LO.numbered_list_rows(conv, "text", 25, ["conv_id", "turn"])


@register("json_or_raw", covers="L16", sql="""
WITH p AS (SELECT 'e' || CAST(event_id AS VARCHAR) AS event_id, props AS payload FROM events
           UNION ALL SELECT 'c' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR), text FROM conversations WHERE role = 'assistant')
SELECT event_id, coalesce(json_valid(payload), false) AS is_json, CASE WHEN json_valid(payload) THEN CAST(json(payload) AS VARCHAR) ELSE payload END AS analysis FROM p""")
def q_l16(spark, sf):
    ev = conv_text.event_payloads(spark, sf)
    return LO.json_or_raw(ev, "payload").select("event_id", "is_json", "analysis")
