"""Span, trigger-dictionary and phrase-presence queries (A1-A3, A10 weights, J7, J8, G17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as T
from ..operators import spans as SP
from ..operators import split as S
from ..sources import fixtures
from . import duckfn as D
from .common import r6
from .registry import register
from .sqlviews import with_views
from ..functions.hashing import duck_seeded_bucket

P = with_views("posts")
B = duck_seeded_bucket("id")


def _phr_sql(content: str, tw: str) -> str:
    valid = (f"list_filter(coalesce({tw}, []), lambda s: s[1] >= 0 AND s[1] < length({content}) "
             f"AND s[1] < s[2] AND s[2] <= length({content}))")
    raw = f"list_transform({valid}, lambda s: {D.py_strip(f'substr({content}, s[1] + 1, s[2] - s[1])')})"
    cl = f"list_filter(list_transform(list_filter({raw}, lambda x: x <> ''), lambda x: {D.clean_text('x')}), lambda x: x <> '')"
    return f"CASE WHEN len({cl}) > 0 THEN {cl} END"


@register("span_phrases", covers="A1 A5", sql=P + f"""
SELECT id, array_to_string({_phr_sql('content', 'trigger_words')}, '|') AS phrases FROM posts""")
def q_a1(spark, sf):
    p = fixtures.posts(spark, sf)
    return p.select("id", F.array_join(SP.span_phrases(F.col("content"), F.col("trigger_words")), "|").alias("phrases"))


@register("span_weights", covers="A2 A10 Q7", sql=P + f"""
, e AS (SELECT id, length(content) AS n, unnest(trigger_words) AS s, generate_subscripts(trigger_words, 1) AS pos,
               content FROM posts WHERE length(content) > 0),
w AS (SELECT id, pos, substr(content, greatest(least(s[1], n), 0) + 1, greatest(least(s[2], n) - least(s[1], n), 0)) AS piece,
             0.5 * ((1.0 - s[1] / n * 0.3) + length(substr(content, least(s[1], n) + 1, greatest(least(s[2], n) - least(s[1], n), 0))) / n) AS weight
      FROM e)
SELECT id, CAST(pos - 1 AS INTEGER) AS pos, piece, {r6('weight')} AS weight,
       {r6('weight / (1.0 + sum(weight) OVER (PARTITION BY id))')} AS weight_norm FROM w""")
def q_a10(spark, sf):
    p = fixtures.posts(spark, sf)
    w = p.select("id", F.posexplode(SP.span_weights(F.col("content"), F.col("trigger_words"))).alias("pos", "w"))
    return w.select("id", "pos", "w.piece", F.round("w.weight", 6).alias("weight"),
                    F.round("w.weight_norm", 6).alias("weight_norm"))


@register("attention_mask", covers="A3", sql=P + f"""
SELECT id, CAST(length(content) AS BIGINT) AS length, {r6('sum_mask')} AS mask_sum FROM (
  SELECT id, content, (SELECT sum(CASE WHEN len(list_filter(coalesce(trigger_words, []), lambda s: i >= s[1] AND i < s[2])) > 0
                                  THEN 1.0 ELSE 0.5 END) FROM range(0, length(content)) t(i)) AS sum_mask FROM posts)""")
def q_a3(spark, sf):
    p = fixtures.posts(spark, sf)
    m = SP.attention_mask(F.col("content"), F.col("trigger_words"))
    return p.select("id", F.length("content").cast("bigint").alias("length"),
                    F.round(F.aggregate(m, F.lit(0.0), lambda a, x: a + x), 6).alias("mask_sum"))


TRAIN = f"SELECT * FROM posts WHERE {B} < 60"
DICT_SQL = (f"SELECT id, unnest(techniques) AS label, phrases FROM (SELECT id, techniques, "
            f"{_phr_sql('content', 'trigger_words')} AS phrases FROM tr) WHERE len(coalesce(techniques, [])) > 0 "
            "AND phrases IS NOT NULL")
DICT = with_views("posts", extra=[("tr", TRAIN), ("d0", DICT_SQL),
                                  ("dict", "SELECT id, label, unnest(phrases) AS phrase FROM d0")])


def _dictionary(spark, sf):
    p = S.split_60_20_20(fixtures.posts(spark, sf)).where(F.col("split") == "train")
    return SP.trigger_dictionary(p)


@register("trigger_dictionary", covers="J8 Q12", sql=DICT + "SELECT id, label, phrase FROM dict")
def q_j8(spark, sf):
    return _dictionary(spark, sf)


@register("trigger_dictionary_counts", covers="G17 O2", sql=DICT + """
SELECT label, CAST(count(*) AS BIGINT) AS instances, CAST(count(DISTINCT id) AS BIGINT) AS rows
FROM dict GROUP BY label ORDER BY instances DESC, label LIMIT 10""")
def q_g17(spark, sf):
    return SP.trigger_dictionary_counts(_dictionary(spark, sf))


NORM = r"[^\p{L}\p{N}_]+"


#: One row per post with a flag for each label, from ``ph (label, phrase)`` and ``posts``.
FLAGS_SQL = f"""
WITH ct AS (SELECT id, ' ' || {D.rx(D.clean_text('content'), NORM, ' ')} || ' ' AS t FROM posts),
hit AS (SELECT DISTINCT ct.id, ph.label FROM ct, ph WHERE instr(ct.t, ' ' || {D.rx('ph.phrase', NORM, ' ')} || ' ') > 0)
SELECT ct.id, """ + ", ".join(
    f"CAST(coalesce(max(CASE WHEN hit.label = '{x}' THEN 1 END), 0) AS INTEGER) AS trigger_present_{x}"
    for x in vocab.CANONICAL_LABELS) + " FROM ct LEFT JOIN hit ON ct.id = hit.id GROUP BY ct.id"


@register("trigger_presence", covers="J7", sql=DICT + f"""
, ph AS (SELECT DISTINCT label, phrase FROM dict WHERE length(phrase) >= 2), flags AS ({FLAGS_SQL}) SELECT * FROM flags""")
def q_j7(spark, sf):
    texts = fixtures.posts(spark, sf).select("id", T.clean_text(F.col("content")).alias("cleaned"))
    return SP.trigger_presence(texts, _dictionary(spark, sf), vocab.CANONICAL_LABELS)
