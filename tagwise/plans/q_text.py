"""Text cleaning and null-handling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import fixtures, tables
from . import duckfn as D
from .registry import register
from ..vocab import sql_str
from .sqlviews import with_views

P = with_views("posts")
PN = with_views("posts_nulls")


@register("clean_text_space", covers="P3", sql=P + f"""
SELECT id, {D.clean_text('content', ' ')} AS cleaned FROM posts""")
def q_p3(spark, sf):
    return fixtures.posts(spark, sf).select("id", T.clean_text(F.col("content"), " ").alias("cleaned"))


@register("clean_text_drop", covers="P4", sql=P + f"""
SELECT id, {D.clean_text('content', '')} AS cleaned FROM posts""")
def q_p4(spark, sf):
    return fixtures.posts(spark, sf).select("id", T.clean_text(F.col("content"), "").alias("cleaned"))


@register("clean_for_embedding", covers="P5", sql=P + f"""
SELECT id, {D.clean_for_embedding('content')} AS cleaned FROM posts""")
def q_p5(spark, sf):
    return fixtures.posts(spark, sf).select("id", T.clean_for_embedding(F.col("content")).alias("cleaned"))


@register("missing_values", covers="P1 P2 P15 L17", sql=PN + """
SELECT id, coalesce(content, '') AS content_filled,
       array_to_string(coalesce(techniques, []), ',') AS techniques,
       CAST(techniques IS NULL AS BOOLEAN) AS techniques_was_null
FROM posts_nulls WHERE content IS NOT NULL AND length(id) > 0 AND length(content) > 0""")
def q_p1(spark, sf):
    p = fixtures.posts(spark, sf, null_every=17)
    kept = p.na.drop(subset=["content"]).where((F.length("id") > 0) & (F.length("content") > 0))
    return kept.select(
        "id", F.coalesce("content", F.lit("")).alias("content_filled"),
        F.array_join(F.coalesce("techniques", F.array().cast("array<string>")), ",").alias("techniques"),
        F.col("techniques").isNull().alias("techniques_was_null"))


@register("language_repair", covers="P9 P10 P11 Q9", sql=f"""
SELECT CAST(doc_id AS VARCHAR) AS id,
       CASE WHEN instr(source || '.csv', 'uk') > 0 THEN 'uk' WHEN instr(source || '.csv', 'ru') > 0 THEN 'ru' ELSE 'uk' END AS file_lang,
       CASE WHEN {D.count_chars('lower(text)', T.UK_LETTERS)} > {D.count_chars('lower(text)', T.RU_LETTERS)} THEN 'uk'
            WHEN {D.count_chars('lower(text)', T.RU_LETTERS)} > {D.count_chars('lower(text)', T.UK_LETTERS)} THEN 'ru'
            WHEN {D.count_chars('lower(text)', 'і')} > {D.count_chars('lower(text)', 'ы')} THEN 'uk' ELSE 'ru' END AS content_lang
FROM documents""".replace("SELECT CAST(doc_id", "SELECT *, CASE WHEN file_lang = 'uk' AND content_lang = 'ru' THEN 'ru' "
                          "WHEN file_lang = 'ru' AND content_lang = 'uk' THEN 'uk' ELSE file_lang END AS lang FROM (SELECT CAST(doc_id", 1) + ")")
def q_p9(spark, sf):
    d = tables.documents(spark, sf).select("doc_id", "text", "source")
    fname = F.concat(F.col("source"), F.lit(".csv"))
    file_lang = T.language_from_filename(fname)
    return d.select(F.col("doc_id").cast("string").alias("id"), file_lang.alias("file_lang"),
                    T.language_from_content(F.col("text")).alias("content_lang"),
                    T.repaired_language(file_lang, F.col("text")).alias("lang"))


# The test texts hold no URL, emoji, Cyrillic, apostrophe, blank or null: these queries put them
# there by id, on both sides, so that every rule is reached.
_MARKS = [
    ("", " https://ex.org/a?b=1&c=%20 \U0001F600 @user #tag"), ("Привіт, їжаку Ґ ", ""), ("Это ЫЭЪЁ ", ""), ("don't «цитата» ", " Http://Up.Case/x"),
    None, "", ("www.site.net ", " ©™ \U0001F1FA\U0001F1E6 end"), ("", " і і ы"),
]


def _marked(content, doc_id):
    out = F.lit(None).cast("string")
    for i, m in enumerate(_MARKS):
        text = F.lit(m).cast("string") if not isinstance(m, tuple) else F.concat(F.lit(m[0]), content, F.lit(m[1]))
        out = F.when(doc_id % len(_MARKS) == i, text).otherwise(out)
    return out


def _marked_sql() -> str:
    cases = []
    for i, m in enumerate(_MARKS):
        text = "CAST(NULL AS VARCHAR)" if m is None else "''" if m == "" else f"{sql_str(m[0])} || text || {sql_str(m[1])}"
        cases.append(f"WHEN {i} THEN {text}")
    return f"SELECT doc_id, CASE doc_id % {len(_MARKS)} {' '.join(cases)} END AS content FROM documents"


@register("clean_text_marked", covers="P3 P4 P5", sql=f"""
WITH m AS ({_marked_sql()})
SELECT doc_id, {D.clean_text('content', ' ')} AS spaced, {D.clean_text('content', '')} AS dropped,
       {D.clean_for_embedding('content')} AS for_embedding FROM m""")
def q_marked_clean(spark, sf):
    c = _marked(F.col("text"), F.col("doc_id"))
    m = tables.documents(spark, sf).select("doc_id", c.alias("content"))
    return m.select("doc_id", T.clean_text(F.col("content"), " ").alias("spaced"), T.clean_text(F.col("content"), "").alias("dropped"),
                    T.clean_for_embedding(F.col("content")).alias("for_embedding"))


@register("missing_values_marked", covers="P1 P2", sql=f"""
WITH m AS ({_marked_sql()})
SELECT doc_id, coalesce(content, '') AS content_filled, content IS NOT NULL AS kept FROM m""")
def q_marked_missing(spark, sf):
    c = _marked(F.col("text"), F.col("doc_id"))
    m = tables.documents(spark, sf).select("doc_id", c.alias("content"), c.isNotNull().alias("kept"))
    return m.na.fill({"content": ""}).select("doc_id", F.col("content").alias("content_filled"), "kept")


@register("language_repair_marked", covers="P9 P10 P11 Q9", sql=f"""
WITH m AS ({_marked_sql()}),
f AS (SELECT doc_id, coalesce(content, '') AS content, CASE doc_id % 3 WHEN 0 THEN 'uk' WHEN 1 THEN 'ru' ELSE 'uk' END AS file_lang FROM m),
l AS (SELECT doc_id, file_lang, CASE
       WHEN {D.count_chars('lower(content)', T.UK_LETTERS)} > {D.count_chars('lower(content)', T.RU_LETTERS)} THEN 'uk'
       WHEN {D.count_chars('lower(content)', T.RU_LETTERS)} > {D.count_chars('lower(content)', T.UK_LETTERS)} THEN 'ru'
       WHEN {D.count_chars('lower(content)', 'і')} > {D.count_chars('lower(content)', 'ы')} THEN 'uk' ELSE 'ru' END AS content_lang FROM f)
SELECT doc_id, file_lang, content_lang, CASE WHEN file_lang = content_lang THEN file_lang ELSE content_lang END AS lang FROM l""")
def q_marked_language(spark, sf):
    c = _marked(F.col("text"), F.col("doc_id"))
    name = F.when(F.col("doc_id") % 3 == 0, F.lit("synthetic_uk.csv")).when(F.col("doc_id") % 3 == 1, F.lit("data_ru_2.csv")).otherwise(F.lit("other.csv"))
    m = tables.documents(spark, sf).select("doc_id", c.alias("content"), T.language_from_filename(name).alias("file_lang"))
    return m.select("doc_id", "file_lang", T.language_from_content(F.col("content")).alias("content_lang"),
                    T.repaired_language(F.col("file_lang"), F.col("content")).alias("lang"))
