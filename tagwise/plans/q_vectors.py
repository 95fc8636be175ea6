"""Vector store, k-NN and embedding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import spans as SP
from ..operators import vectors as V
from ..sources import fixtures, io, tables
from . import duckfn as D
from .common import r6
from .registry import register
from .sqlviews import with_views

ST = with_views("store")


def _store(spark, sf):
    return fixtures.store(spark, sf).where(F.size("embedding") > 0)


@register("store_scan", covers="S9 P13 L17", sql=ST + """
SELECT id, CAST(len(embedding) AS BIGINT) AS n_dims, array_to_string(coalesce(techniques, []), ',') AS techniques,
       coalesce(CAST(manipulative AS BOOLEAN), false) AS manipulative FROM store WHERE len(embedding) > 0""")
def q_s9(spark, sf):
    s = io.store_scan(fixtures.store(spark, sf))
    return s.select("id", F.size("embedding").cast("bigint").alias("n_dims"),
                    F.array_join(F.coalesce("techniques", F.array().cast("array<string>")), ",").alias("techniques"),
                    F.coalesce(F.col("manipulative").cast("boolean"), F.lit(False)).alias("manipulative"))


def query_posts(s):
    """The posts searched with: every id divisible by 100. Each is sought among all others."""
    return s.where(F.col("id").cast("bigint") % 100 == 0)


def _knn(spark, sf, k=5):
    s = _store(spark, sf)
    q = query_posts(s).select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    return V.knn_exact(s, q, k=k, exclude_self=True)


SQ = ("sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), "
      "lambda p: (p[1] - p[2]) * (p[1] - p[2])))")
KNN = with_views("store", extra=[
    ("pairs", "SELECT a.id AS qid, b.id AS id, list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), "
              "CAST(b.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS l2_sq "
              "FROM store a, store b WHERE len(a.embedding) > 0 AND len(b.embedding) > 0 "
              "AND CAST(a.id AS BIGINT) % 100 = 0 AND a.id <> b.id"),
    ("knn", "SELECT qid, CAST(rank AS INTEGER) AS rank, id, l2_sq FROM (SELECT *, row_number() OVER "
            "(PARTITION BY qid ORDER BY l2_sq, id) AS rank FROM pairs) WHERE rank <= 5")])


@register("knn_search", covers="J6 J4 W1 Q1 Q2 Q3", sql=KNN + f"""
SELECT k.qid, k.rank, k.id, {r6('k.l2_sq')} AS l2_sq, array_to_string(s.techniques, ',') AS techniques,
       s.manipulative FROM knn k JOIN store s ON k.id = s.id""")
def q_j6(spark, sf):
    hits = _knn(spark, sf)
    docs = _store(spark, sf).select("id", "techniques", "manipulative")
    # One join of all hits with the documents (no per-hit lookups)
    return hits.join(docs, "id").select("qid", "rank", "id", F.round("l2_sq", 6).alias("l2_sq"),
                                        F.array_join("techniques", ",").alias("techniques"), "manipulative")


@register("knn_lsh_recall", covers="J6")
def q_lsh(spark, sf):
    s = _store(spark, sf)
    q = query_posts(s).select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    return V.recall_at_k(V.knn_exact(s, q, k=5), V.knn_lsh(s, q, k=5, radius=1.3))


@register("doc_mean_vector", covers="A8", sql=f"""
, m AS (SELECT label, count(*) AS n, list_transform(range(1, 65), lambda j: 0.0) AS z FROM embeddings GROUP BY label)
""".replace(", m AS", "WITH m AS") + f"""
, mv AS (SELECT e.label, list_transform(range(1, len(first(e.embedding)) + 1), lambda j: 0.0) AS z,
                count(*) AS n FROM embeddings e GROUP BY e.label),
el AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS mi FROM (SELECT label, embedding,
       unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i)
SELECT el.label, CAST(count(*) AS BIGINT) AS n_dims, {r6('sum(mi)')} AS component_sum,
       {r6('sqrt(sum(mi * mi))')} AS norm, CAST(max(mv.n) AS BIGINT) AS n_vectors
FROM el JOIN mv ON el.label = mv.label GROUP BY el.label""")
def q_a8(spark, sf):
    e = tables.embeddings(spark, sf).select("label", F.col("embedding").cast("array<double>").alias("v"))
    m = V.mean_vector(e, "label", "v")
    return m.select("label", F.size("mean_vector").cast("bigint").alias("n_dims"),
                    F.round(F.aggregate("mean_vector", F.lit(0.0), lambda a, x: a + x), 6).alias("component_sum"),
                    F.round(F.sqrt(F.aggregate("mean_vector", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"),
                    "n_vectors")


def duck_encode(t: str) -> str:
    h = "('0x' || substr(md5(x), 1, 8))::BIGINT"
    toks = f"list_filter(string_split('passage: ' || {t}, ' '), lambda x: x <> '')"
    bs = (f"list_transform({toks}, lambda x: {{'b': {h} % 64, "
          f"'s': CASE WHEN ({h} // 64) % 2 = 0 THEN 1.0 ELSE -1.0 END}})")
    v = (f"list_transform(range(64), lambda j: coalesce(list_sum(list_transform(list_filter({bs}, "
         f"lambda x: x.b = j), lambda x: x.s)), 0.0))")
    return v


def chunk_ctes(docs: str, budget: int = 512) -> list[tuple[str, str]]:
    """DuckDB: ``chunks (id, chunk_no, chunk, n_words)`` of a query giving (id, t). Running costs of
    the words, then one step of a recursion per chunk: as many words as the budget holds."""
    words = D.split_ws("coalesce(t, '')")
    run = "list_transform(range(1, len(w) + 1), lambda i: list_sum(list_transform(w[1:i], lambda x: 1 + CAST(ceil(length(x) / 4.0) AS BIGINT))))"
    end = "greatest(past + 1, len(list_filter(run, lambda s: s <= (CASE WHEN past = 0 THEN 0 ELSE run[past] END) + {b})))".replace("{b}", str(budget))
    return [
        ("cw", f"SELECT id, w, {run} AS run FROM (SELECT id, {words} AS w FROM ({docs}) _d) _w"),
        ("cuts", "SELECT id, 0 AS chunk_no, w, run, CAST(0 AS BIGINT) AS past, "
                 f"least(CAST({end} AS BIGINT), len(w)) AS upto FROM (SELECT *, 0 AS past FROM cw) _c "
                 "UNION ALL SELECT id, chunk_no + 1, w, run, past, "
                 f"least(CAST({end} AS BIGINT), len(w)) AS upto FROM (SELECT id, chunk_no, w, run, upto AS past FROM cuts WHERE upto < len(w)) _n"),
        ("chunks", "SELECT id, CAST(chunk_no AS INTEGER) AS chunk_no, array_to_string(w[past + 1:upto], ' ') AS chunk, "
                   "CAST(upto - past AS INTEGER) AS n_words FROM cuts")]


def encoded(vec: str) -> str:
    """DuckDB: a list of doubles over its length; zeros stay."""
    n = f"sqrt(list_sum(list_transform({vec}, lambda y: y * y)))"
    return f"CASE WHEN {n} > 0 THEN list_transform({vec}, lambda x: x / {n}) ELSE {vec} END"


def chunk_views(*views: str, docs: str, before: list[tuple[str, str]] | None = None,
                extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH RECURSIVE`` clause of the views, ``before``, the chunks of ``docs`` and ``m (id, n_vectors, v)``, the
    mean of their vectors."""
    means = [("cv", f"SELECT id, {duck_encode('chunk')} AS raw_v FROM chunks"),
             ("cn", f"SELECT id, {encoded('raw_v')} AS v FROM cv"),
             ("m", "SELECT id, any_value(n) AS n_vectors, list(c ORDER BY i) AS v FROM (SELECT id, i, avg(v[i]) AS c, count(*) AS n "
                   "FROM (SELECT id, v, unnest(range(1, 65)) AS i FROM cn) _e GROUP BY id, i) _g GROUP BY id")]
    return with_views(*views, extra=(before or []) + chunk_ctes(docs) + means + (extra or [])).replace("WITH ", "WITH RECURSIVE ", 1)


CLEANED = f"SELECT id, {D.clean_for_embedding('content')} AS t FROM posts"


@register("chunk_by_budget", covers="A6 Q4", sql=chunk_views("posts", docs=CLEANED) + "SELECT id, chunk_no, n_words FROM chunks")
def q_a6(spark, sf):
    docs = fixtures.posts(spark, sf).select("id", T.clean_for_embedding(F.col("content")).alias("t"))
    return V.chunk_and_embed(docs, "t", budget=512).select("id", "chunk_no", "n_words")


@register("embed_chunks", covers="A7 A8", sql=chunk_views("posts", docs=CLEANED) + f"""
SELECT id, CAST(n_vectors AS BIGINT) AS n_vectors, {r6('sqrt(list_sum(list_transform(v, lambda x: x * x)))')} AS norm FROM m""")
def q_a7(spark, sf):
    docs = fixtures.posts(spark, sf).select("id", T.clean_for_embedding(F.col("content")).alias("t"))
    ch = V.chunk_and_embed(docs, "t", budget=512)
    m = V.mean_vector(ch, "id", "vector")
    return m.select("id", "n_vectors", F.round(F.sqrt(F.aggregate("mean_vector", F.lit(0.0),
                                                                 lambda a, x: a + x * x)), 6).alias("norm"))


def _enrich_sql(weighted: bool) -> str:
    n = "length(s.original_text)"
    piece = "substr(original_text, least(greatest(tw[1], 0), n) + 1, greatest(least(tw[2], n) - least(greatest(tw[1], 0), n), 0))"
    w = (f"0.5 * ((1.0 - tw[1] / n * 0.3) + length({piece}) / n)" if weighted else "0.5")
    return with_views("store") + f"""
, sp AS (SELECT s.id, {n} AS n, unnest(s.trigger_positions) AS tw, s.original_text FROM store s WHERE len(s.embedding) > 0),
sv AS (SELECT id, {w} AS w, raw_v FROM (SELECT id, n, tw, original_text,
        {duck_encode(D.clean_for_embedding('substr(original_text, least(greatest(tw[1], 0), n) + 1, greatest(least(tw[2], n) - least(greatest(tw[1], 0), n), 0))'))} AS raw_v
        FROM sp) s2),
svn AS (SELECT id, w, CASE WHEN sqrt(list_sum(list_transform(raw_v, lambda x: x * x))) > 0
        THEN list_transform(raw_v, lambda x: x / sqrt(list_sum(list_transform(raw_v, lambda y: y * y)))) ELSE raw_v END AS v FROM sv),
agg AS (SELECT id, sum(w) AS ws, list_transform(range(1, 65), lambda j: 0.0) AS z FROM svn GROUP BY id),
comp AS (SELECT s.id, i, (CAST(s.embedding[i] AS DOUBLE) + coalesce((SELECT sum(svn.w * svn.v[i]) FROM svn WHERE svn.id = s.id), 0.0))
         / (1.0 + coalesce((SELECT sum(w) FROM svn WHERE svn.id = s.id), 0.0)) AS c
         FROM (SELECT id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM store WHERE len(embedding) > 0) s)
SELECT id, {r6('sum(c)')} AS component_sum, {r6('sqrt(sum(c * c))')} AS norm FROM comp GROUP BY id"""


def _enrich(spark, sf, weighted: bool):
    s = _store(spark, sf)
    pieces = SP.span_slices(F.col("original_text"), F.col("trigger_positions"))
    cleaned = F.transform(pieces, lambda p: T.clean_for_embedding(p))
    df = s.select("id", F.col("embedding").cast("array<double>").alias("e"), "original_text", "trigger_positions",
                  F.transform(cleaned, lambda p: V.embed(p)).alias("sv"))
    if weighted:
        w = F.transform(SP.span_weights(F.col("original_text"), F.col("trigger_positions")), lambda x: x["weight"])
    else:
        w = F.transform(F.col("sv"), lambda x: F.lit(0.5))
    comb = V.weighted_combine(F.col("e"), F.col("sv"), w)
    out = df.select("id", comb.alias("v"))
    return out.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("component_sum"),
                      F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))


@register("enrich_flat", covers="A9", sql=_enrich_sql(False))
def q_a9(spark, sf):
    return _enrich(spark, sf, False)


@register("enrich_weighted", covers="A10 Q7", sql=_enrich_sql(True))
def q_a10(spark, sf):
    return _enrich(spark, sf, True)
