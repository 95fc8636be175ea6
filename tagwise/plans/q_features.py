"""Character n-gram TF-IDF queries (TF1-TF4, J10, O3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import duck_md5_u32, md5_u32, duck_seeded_bucket, plain_md5_u32
from ..operators import features as FE
from ..operators import split as S
from ..sources import fixtures
from . import duckfn as D
from .common import r6
from .registry import register
from .sqlviews import with_views

B = duck_seeded_bucket("id")
# DuckDB: char_wb n-grams of the cleaned text, one row per occurrence
GRAMS = (
    "SELECT id, substr(w, i, n) AS term FROM ("
    "  SELECT id, ' ' || w0 || ' ' AS w FROM (SELECT id, unnest(list_filter(string_split_regex(lower(cleaned), '\\s+'), lambda x: x <> '')) AS w0 FROM {src})) ws,"
    "  (SELECT unnest([3, 4, 5]) AS n) ns, LATERAL (SELECT unnest(range(1, length(w) - n + 2)) AS i) r"
    "  WHERE length(w) >= n")
CLEAN = f"SELECT id, {D.clean_text('content')} AS cleaned FROM posts"
BASE = with_views("posts", extra=[
    ("docs", CLEAN), ("tr", f"SELECT * FROM docs WHERE {B} < 60"),
    ("g_tr", GRAMS.format(src="tr")),
    ("vocab0", "SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM g_tr GROUP BY term"),
    ("vocab", "SELECT term, CAST(df AS BIGINT) AS df, CAST(tf AS BIGINT) AS tf, "
              "CAST(row_number() OVER (ORDER BY tf DESC, term) AS BIGINT) AS rank, "
              "CAST((SELECT count(*) FROM tr) AS BIGINT) AS n_docs FROM (SELECT * FROM vocab0 "
              "WHERE df >= 3 AND df <= 0.9 * (SELECT count(*) FROM tr) ORDER BY tf DESC, term LIMIT 10000)"),
    ("idf", "SELECT term, df, rank, ln((1.0 + n_docs) / (1.0 + df)) + 1.0 AS idf FROM vocab"),
])


def _docs(spark, sf):
    return fixtures.posts(spark, sf).select("id", T.clean_text(F.col("content")).alias("cleaned"))


def _train(spark, sf):
    return S.split_60_20_20(_docs(spark, sf)).where(F.col("split") == "train").drop("split")


def _vocab(spark, sf):
    return FE.fit_vocabulary(_train(spark, sf), "cleaned")


@register("char_ngrams", covers="TF1", sql=BASE + ", g AS (" + GRAMS.format(src="docs") + f""")
SELECT id, count(*) AS n_grams, count(DISTINCT term) AS n_distinct,
       CAST(sum({duck_md5_u32('term')}) AS BIGINT) AS checksum FROM g GROUP BY id""")
def q_tf1(spark, sf):
    # documents without any n-gram have no row
    return FE.gram_profile(_docs(spark, sf), "cleaned", plain_md5_u32, md5_u32)


@register("tfidf_vocabulary", covers="TF2 O3", sql=BASE + "SELECT term, df, tf, rank, n_docs FROM vocab")
def q_tf2(spark, sf):
    return _vocab(spark, sf)


@register("tfidf_idf", covers="TF3", sql=BASE + f"SELECT term, {r6('idf')} AS idf FROM idf")
def q_tf3(spark, sf):
    return FE.smoothed_idf(_vocab(spark, sf)).select("term", F.round("idf", 6).alias("idf"))


@register("tfidf_transform", covers="TF4 J10", sql=BASE + ", g AS (" + GRAMS.format(src="docs") + f"""),
tfc AS (SELECT g.id, g.term, count(*) AS tf, first(idf.idf) AS idf FROM g JOIN idf ON g.term = idf.term GROUP BY g.id, g.term),
wt AS (SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS weight FROM tfc),
wr AS (SELECT id, term, round(weight, 9) AS weight FROM wt),
mx AS (SELECT id, max(weight) AS mw FROM wr GROUP BY id)
SELECT wr.id, count(*) AS nnz, {r6('sum(weight)')} AS l1, {r6('max(weight)')} AS max_weight,
       min(CASE WHEN weight = mw THEN term END) AS top_term FROM wr JOIN mx ON wr.id = mx.id GROUP BY wr.id""")
def q_tf4(spark, sf):
    idf = FE.smoothed_idf(_vocab(spark, sf))
    rows = FE.tfidf_rows(_docs(spark, sf), "cleaned", idf)
    each = F.transform(F.arrays_zip("terms", "weights"), lambda e: F.struct((-F.round(e["weights"], 9)).alias("w"), e["terms"].alias("t")))
    lw = rows.select("id", each.alias("e")).select("id", "e", F.array_min("e").alias("top"))
    return lw.select("id", F.size("e").cast("bigint").alias("nnz"), F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a - x["w"]), 6).alias("l1"),
                     F.round(-F.col("top.w"), 6).alias("max_weight"), F.col("top.t").alias("top_term"))
