"""Source/sink, id-set and union queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as LF
from ..functions import text as TX
from ..operators import spans as SP
from ..operators import synthetic as SY
from ..operators import vectors as V
from ..session import scratch_path
from ..sources import fixtures, io
from ..sources import store as ST
from ..sources.fixtures import python_list_text
from . import duckfn as D
from .common import r6
from .q_vectors import chunk_views, duck_encode, encoded
from .registry import register
from .sqlviews import python_list_text as duck_python_list_text
from .sqlviews import with_views
from ..functions.hashing import duck_seeded_bucket

P = with_views("posts")
B = duck_seeded_bucket("id")


@register("posts_scan", covers="S1 P13 L17 A5", sql=P + """
SELECT id, lang, coalesce(manipulative, false) AS manipulative, array_to_string(coalesce(techniques, []), ',') AS techniques,
       array_to_string(list_transform(trigger_words, lambda s: s[1] || '-' || s[2]), ',') AS trigger_words,
       CAST(length(content) AS BIGINT) AS n_chars FROM posts""")
def q_s1(spark, sf):
    path = scratch_path(spark, "posts")
    fixtures.posts(spark, sf).write.mode("overwrite").parquet(path)
    p = io.load_posts(spark, path)
    return p.select("id", "lang", "manipulative", F.array_join("techniques", ",").alias("techniques"),
                    F.array_join(F.transform("trigger_words", lambda s: F.concat_ws("-", F.get(s, 0).cast("string"),
                                                                                     F.get(s, 1).cast("string"))), ",")
                    .alias("trigger_words"), F.length("content").cast("bigint").alias("n_chars"))


CSV_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in
                           ("id", "content", "lang", "manipulative", "techniques")])


@register("csv_roundtrip", covers="S2 S3 S7 Q16", sql=P + f"""
SELECT id, content, lang, CAST(manipulative AS VARCHAR) AS manipulative,
       {duck_python_list_text('techniques')} AS techniques FROM posts""")
def q_s2(spark, sf):
    path = scratch_path(spark, "posts_csv")
    p = fixtures.posts(spark, sf)
    out = p.select("id", "content", "lang", F.col("manipulative").cast("string").alias("manipulative"),
                   python_list_text(F.col("techniques")).alias("techniques"))
    io.write_csv(out, path)
    return io.read_csv_checked(spark, path, CSV_SCHEMA, ["id", "content"])


def _synthetic_files(spark, sf) -> str:
    """Write posts as synthetic-data CSV files, one folder per language."""
    base = scratch_path(spark, "synthetic")
    p = fixtures.posts(spark, sf)
    rows = p.select(F.concat(F.lit('"'), F.col("content"), F.lit('"')).alias("content"),
                    python_list_text(F.col("techniques")).alias("techniques"),
                    F.concat(F.lit("synthetic_data_"), F.col("lang")).alias("part"))
    rows.write.mode("overwrite").partitionBy("part").options(**io.CSV_OPTIONS).csv(base)
    return base + "/*/*.csv"


_LANG_SQL = (f"CASE WHEN {D.count_chars('lower(content)', 'їієґ')} > {D.count_chars('lower(content)', 'ыэъё')} THEN 'uk' "
             f"WHEN {D.count_chars('lower(content)', 'ыэъё')} > {D.count_chars('lower(content)', 'їієґ')} THEN 'ru' "
             f"WHEN {D.count_chars('lower(content)', 'і')} > {D.count_chars('lower(content)', 'ы')} THEN 'uk' ELSE 'ru' END")
SYN = with_views("posts", extra=[("syn", f"""
SELECT content, CASE WHEN file_lang = 'uk' AND cl = 'ru' THEN 'ru' WHEN file_lang = 'ru' AND cl = 'uk' THEN 'uk'
       ELSE file_lang END AS lang, true AS manipulative,
       CASE WHEN trim(tt) = '[]' THEN [] ELSE {D.quoted_or_single('tt')} END AS techniques
FROM (SELECT content, {duck_python_list_text('techniques')} AS tt,
        CASE WHEN instr('synthetic_data_' || lang, 'uk') > 0 THEN 'uk' WHEN instr('synthetic_data_' || lang, 'ru') > 0
        THEN 'ru' ELSE 'uk' END AS file_lang, {_LANG_SQL} AS cl FROM posts)""")])


@register("synthetic_compose", covers="T7 S4 U4 P6 P9 P10 P11 P12 L2 L14 Q20", sql=SYN + """
SELECT content, lang, manipulative, '[' || array_to_string(techniques, ', ') || ']' AS techniques,
       '[]' AS trigger_words FROM syn""")
def q_t7(spark, sf):
    df = SY.as_csv_rows(SY.compose(spark, _synthetic_files(spark, sf)))
    return df.select("content", "lang", "manipulative", "techniques",
                     F.lit("[]").alias("trigger_words"))


@register("synthetic_label_counts", covers="G22 Q10", sql=SYN + """
SELECT label, count(*) AS count FROM (SELECT unnest(techniques) AS label FROM syn) GROUP BY label""")
def q_g22(spark, sf):
    return SY.label_counts(SY.compose(spark, _synthetic_files(spark, sf)))


@register("augment_union", covers="U1", sql=SYN + """
SELECT lang, is_synthetic, count(*) AS n_posts, CAST(sum(len(techniques)) AS BIGINT) AS n_labels FROM (
  SELECT lang, false AS is_synthetic, coalesce(techniques, []) AS techniques FROM posts
  UNION ALL SELECT lang, true AS is_synthetic, techniques FROM syn) GROUP BY lang, is_synthetic""")
def q_u1(spark, sf):
    native = fixtures.posts(spark, sf).withColumn("is_synthetic", F.lit(False))
    syn = SY.compose(spark, _synthetic_files(spark, sf)).drop("source_file").withColumn("is_synthetic", F.lit(True))
    u = native.unionByName(syn, allowMissingColumns=True)
    return u.groupBy("lang", "is_synthetic").agg(
        F.count(F.lit(1)).alias("n_posts"),
        F.sum(F.size(F.coalesce("techniques", F.array().cast("array<string>")))).cast("bigint").alias("n_labels"))


def _result_log(spark, sf) -> str:
    """The done ids appended as JSON lines, as the labelling loop would."""
    path = scratch_path(spark, "results")
    done = fixtures.submitted_ids(spark, sf).select("id", "techniques", F.lit(0.0).alias("timestamp"))
    io.append_jsonl(done, path)
    return path


@register("resume_unprocessed", covers="J1 S5 S6", sql=P + f"SELECT id FROM posts WHERE {B} >= 70")
def q_j1(spark, sf):
    done = io.read_jsonl(spark, _result_log(spark, sf), io.RESULT_LOG, "tolerant")
    done = done.where(F.col("_corrupt_record").isNull() & F.col("id").isNotNull()).select("id")
    todo = fixtures.posts(spark, sf).select("id")
    return todo.join(done, "id", "left_anti")


@register("jsonl_tolerant_read", covers="S5", sql=P + f"""
SELECT CAST(sum(CASE WHEN {B} < 90 THEN 1 ELSE 0 END) AS BIGINT) AS n_valid,
       CAST(sum(CASE WHEN {B} >= 95 THEN 1 ELSE 0 END) AS BIGINT) AS n_malformed FROM posts""")
def q_s5(spark, sf):
    """Valid lines, truncated lines and blank lines in one log; count what the
    tolerant reader keeps and sets aside."""
    path = scratch_path(spark, "log_mixed")
    p = fixtures.posts(spark, sf).select("id", "techniques")
    b = fixtures.id_bucket(F.col("id"))
    js = F.to_json(F.struct("id", "techniques"))
    line = F.when(b < 90, js).when(b < 95, F.lit("")).otherwise(F.substring(js, 1, 12))
    p.select(line.alias("value")).write.mode("overwrite").text(path)
    df = io.read_jsonl(spark, path, io.RESULT_LOG, "tolerant")
    bad = F.col("_corrupt_record").isNotNull()
    return df.agg(F.sum((~bad & F.col("id").isNotNull()).cast("bigint")).alias("n_valid"),
                  F.sum((bad | F.col("id").isNull()).cast("bigint")).alias("n_malformed"))


@register("missing_ids", covers="J2 U3 S13 O2", sql=with_views("submitted") + """
SELECT p.id FROM posts p WHERE NOT EXISTS (SELECT 1 FROM submitted s WHERE s.id = p.id)""")
def q_j2(spark, sf):
    expected = fixtures.posts(spark, sf).select("id").distinct()
    got = fixtures.submitted_ids(spark, sf).select("id").distinct()
    missing = expected.join(got, "id", "left_anti")
    path = scratch_path(spark, "missing_ids")
    io.write_lines(missing, "id", path)
    return spark.read.text(path).select(F.col("value").alias("id")).orderBy("id")     # O2: sorted id list


@register("submission_completeness", covers="G21", sql=with_views("submitted") + """
SELECT (SELECT count(DISTINCT id) FROM submitted) AS n_unique, (SELECT count(DISTINCT id) FROM posts) AS n_expected,
       (SELECT count(DISTINCT id) FROM submitted) = (SELECT count(DISTINCT id) FROM posts) AS complete""")
def q_g21(spark, sf):
    sub = fixtures.submitted_ids(spark, sf).agg(F.countDistinct("id").alias("n_unique"))
    exp = fixtures.posts(spark, sf).agg(F.countDistinct("id").alias("n_expected"))
    j = sub.withColumn("_k", F.lit(1)).join(exp.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return j.select("n_unique", "n_expected", (F.col("n_unique") == F.col("n_expected")).alias("complete"))


@register("store_upsert", covers="S10 J3", sql=with_views("store") + """
SELECT id, 'existing' AS origin FROM store
UNION ALL SELECT id, 'inserted' AS origin FROM posts p WHERE NOT EXISTS (SELECT 1 FROM store s WHERE s.id = p.id)""")
def q_s10(spark, sf):
    store = fixtures.store(spark, sf).select("id", "techniques", "manipulative", "original_text") \
                    .withColumn("origin", F.lit("existing"))
    new = fixtures.posts(spark, sf).select("id", "techniques", "manipulative",
                                           F.col("content").alias("original_text")).withColumn("origin", F.lit("inserted"))
    return io.store_upsert(store, new).select("id", "origin")


@register("store_commit", covers="S10 S11 J3", sql=with_views("store") + """
SELECT id, manipulative, 1 AS version FROM store
UNION ALL SELECT id, manipulative, 2 AS version FROM posts p WHERE NOT EXISTS (SELECT 1 FROM store s WHERE s.id = p.id)""")
def q_commit(spark, sf):
    """The store as a first commit, all posts as an insert, the same insert once more; each row
    with the version that brought it."""
    path, schema = scratch_path(spark, "store"), "id string, techniques array<string>, manipulative boolean, original_text string"
    ST.append(spark, path, fixtures.store(spark, sf).select("id", "techniques", "manipulative", "original_text"), 0)
    posts = fixtures.posts(spark, sf).select("id", "techniques", "manipulative", F.col("content").alias("original_text"))
    ST.insert(spark, path, posts, schema)
    last = ST.insert(spark, path, posts, schema)
    rows = ST.read(spark, path, schema, last).select("id", "manipulative")
    return rows.join(ST.read(spark, path, schema, 1).select("id", F.lit(1).alias("version")), "id", "left").na.fill(2, ["version"])


def bulk_load(store, docs):
    """Store rows with the new documents (id, content, techniques, manipulative,
    trigger_words), and the rejects with their reason. A text's vector is the mean of its
    chunks', combined with its spans' vectors where it has spans (A10). Ids that the store has
    are left out before anything is embedded, so every new text is embedded once."""
    ok = io.anti_join_big(docs.where(F.col("content").isNotNull()), store.select("id"))
    rejects = docs.where(F.col("content").isNull()).select("id", F.lit("no text").alias("reason"), "techniques", "manipulative")
    spans = F.coalesce("trigger_words", F.array().cast(docs.schema["trigger_words"].dataType))
    pieces = F.transform(SP.span_slices(F.col("content"), spans), lambda p: TX.clean_for_embedding(p))
    d = ok.withColumn("_v", F.transform(F.concat(F.array(TX.clean_for_embedding(F.col("content"))), pieces), lambda p: V.embed(p))) \
          .withColumn("_w", F.transform(SP.span_weights(F.col("content"), spans), lambda x: x["weight"]))
    base, sv = F.col("_v")[0], F.slice("_v", 2, F.size("_v"))
    usable = (F.size("_w") > 0) & (F.size("_w") == F.size(sv)) & ~F.exists("_w", lambda w: w.isNull())
    emb = F.when(usable, V.weighted_combine(base, sv, F.col("_w"))).otherwise(base)
    fresh = io.first_by_id(d.select("id", emb.alias("embedding"), "techniques", "manipulative"))
    return store.unionByName(fresh, allowMissingColumns=True), rejects


_SPAN = "substr(content, least(greatest(tw[1], 0), n) + 1, greatest(least(tw[2], n) - least(greatest(tw[1], 0), n), 0))"
_BULK_SQL = chunk_views(
    "store", "label_text",
    before=[("loads", f"SELECT l.id, CASE WHEN CAST(l.id AS BIGINT) % 17 = 0 THEN NULL ELSE l.content END AS content, {D.bracket_split('l.techniques_text')} AS techniques, "
                      "coalesce(CAST(l.manipulative AS BOOLEAN), false) AS manipulative, p.trigger_words FROM label_text l LEFT JOIN posts p ON l.id = p.id")],
    docs=f"SELECT id, {D.clean_for_embedding('content')} AS t FROM loads WHERE content IS NOT NULL AND id NOT IN (SELECT id FROM store)",
    extra=[
        ("sw", f"SELECT id, 0.5 * ((1.0 - tw[1] / n * 0.3) + length({_SPAN}) / n) AS w, CAST({duck_encode(D.clean_for_embedding(_SPAN))} AS DOUBLE[]) AS raw_v FROM (SELECT id, content, "
               "length(content) AS n, unnest(trigger_words) AS tw FROM loads WHERE content <> '' AND id NOT IN (SELECT id FROM store)) _s"),
        ("sv", f"SELECT id, w, {encoded('raw_v')} AS v FROM sw"),
        ("parts", "SELECT id, i, CAST(1 AS DOUBLE) AS w, CAST(v[i] AS DOUBLE) AS x FROM (SELECT id, v, unnest(range(1, 65)) AS i FROM m) _m "
                  "UNION ALL SELECT id, i, CAST(w AS DOUBLE) AS w, CAST(v[i] AS DOUBLE) AS x FROM (SELECT id, w, v, unnest(range(1, 65)) AS i FROM sv) _v"),
        ("vec", "SELECT id, i, sum(w * x) / sum(w) AS c FROM parts GROUP BY id, i UNION ALL SELECT id, i, CAST(embedding[i] AS DOUBLE) AS c "
                "FROM (SELECT id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM store) _e"),
        ("digest", f"SELECT id, {r6('sum(c)')} AS component_sum, {r6('sqrt(sum(c * c))')} AS norm FROM vec GROUP BY id"),
        ("kept", "SELECT id, techniques, CAST(manipulative AS BOOLEAN) AS manipulative FROM store UNION ALL "
                 "SELECT id, techniques, manipulative FROM loads WHERE content IS NOT NULL AND id NOT IN (SELECT id FROM store)")])


@register("store_bulk_load", covers="S11 L1 P13 A6 A7 A8 A10", sql=_BULK_SQL + """
SELECT k.id, array_to_string(k.techniques, ',') AS techniques, k.manipulative, CAST(NULL AS VARCHAR) AS reason, d.component_sum, d.norm
FROM kept k LEFT JOIN digest d ON k.id = d.id
UNION ALL SELECT id, array_to_string(techniques, ','), manipulative, 'no text', NULL, NULL FROM loads WHERE content IS NULL""")
def q_s11(spark, sf):
    """Bulk load: parse the label text (L1), default the flag, embed (chunk, encode,
    mean, spans), insert new ids into the store; rows without text go to rejects. Returns
    both, with the reason of a reject; vectors by the sum of their components and their length.
    The input has a null text where 17 divides the id."""
    spans = fixtures.posts(spark, sf).select("id", "trigger_words")
    content = F.when(F.col("id").cast("bigint") % 17 != 0, F.col("content"))
    docs = fixtures.label_text(spark, sf).join(spans, "id", "left").select(
        "id", content.alias("content"), LF.labels_bracket_split(F.col("techniques_text")).alias("techniques"),
        F.coalesce(F.col("manipulative"), F.lit(False)).alias("manipulative"), "trigger_words")
    store = fixtures.store(spark, sf).select("id", F.col("embedding").cast("array<double>"), "techniques", "manipulative")
    loaded, rejects = bulk_load(store, docs)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return loaded.unionByName(rejects, allowMissingColumns=True).select(
        "id", F.array_join("techniques", ",").alias("techniques"), "manipulative", "reason",
        F.round(total, 6).alias("component_sum"), F.round(length, 6).alias("norm"))
