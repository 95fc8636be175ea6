"""Prompt and training-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions.hashing import duck_md5_u32, md5_u32
from ..operators import prompts as PR
from ..operators import vectors as V
from ..sources import fixtures, tables
from .q_vectors import query_posts
from .registry import register
from .sqlviews import with_views
from ..vocab import sql_str


def _fill_sql(template: str, **exprs: str) -> str:
    order = sorted(exprs, key=lambda n: template.index("{" + n + "}"))
    pieces = PR.split_template(template, *order)
    out = [sql_str(pieces[0])]
    for n, p in zip(order, pieces[1:]):
        out += [f"({exprs[n]})", sql_str(p)]
    return "(" + " || ".join(out) + ")"


def _json_msgs_sql(pairs: list[tuple[str, str]]) -> str:
    parts = []
    for i, (role, expr) in enumerate(pairs):
        parts.append(sql_str((", " if i else "[") + '{"role": "' + role + '", "content": '))
        parts.append(f"coalesce(CAST(to_json({expr}) AS VARCHAR), 'null')")
        parts.append("'}'")
    parts.append("']'")
    return "(" + " || ".join(parts) + ")"


def _store(spark, sf):
    return fixtures.store(spark, sf).where(F.size("embedding") > 0)


KNN10 = with_views("store", extra=[
    ("pairs", "SELECT a.id AS qid, b.id AS id, list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), "
              "CAST(b.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS l2_sq "
              "FROM store a, store b WHERE len(a.embedding) > 0 AND len(b.embedding) > 0 "
              "AND CAST(a.id AS BIGINT) % 100 = 0 AND a.id <> b.id"),
    ("knn", "SELECT qid, rank, id, l2_sq FROM (SELECT *, row_number() OVER "
            "(PARTITION BY qid ORDER BY l2_sq, id) AS rank FROM pairs) WHERE rank <= 10"),
    ("blocks", "SELECT k.qid, string_agg(printf(" + sql_str("\n%d. Text: %s...\nTechniques: %s\nManipulative: %s\nSimilarity score: %s\n")
               + ", k.rank, substr(s.original_text, 1, 200), array_to_string(coalesce(s.techniques, []), ', '), "
               "CASE WHEN s.manipulative THEN 'True' ELSE 'False' END, printf('%.4f', k.l2_sq)), '' ORDER BY k.rank) AS section "
               "FROM knn k JOIN store s ON k.id = s.id GROUP BY k.qid")])


@register("retrieval_prompt", covers="T1 P8 J4 J6 W1", sql=KNN10 + "SELECT s.id AS qid, " + _fill_sql(
    PR.RETRIEVAL_TEMPLATE, query_text="s.original_text", similar_texts_section="coalesce(b.section, '')")
    + " AS prompt FROM store s LEFT JOIN blocks b ON s.id = b.qid WHERE len(s.embedding) > 0 AND CAST(s.id AS BIGINT) % 100 = 0")
def q_t1(spark, sf):
    s = _store(spark, sf)
    asked = query_posts(s)
    hits = V.knn_exact(s, asked.select(F.col("id").alias("qid"), F.col("embedding").alias("qvec")), k=10, exclude_self=True)
    docs = s.select("id", "original_text", "techniques", "manipulative")
    sections = PR.neighbour_blocks(hits.join(docs, "id"))
    queries = asked.select(F.col("id").alias("qid"), F.col("original_text").alias("query_text"))
    return PR.retrieval_prompt(queries, sections)


@register("sft_binary_pairs", covers="T2 S8 Q11", sql=with_views("posts") + "SELECT id, " + _json_msgs_sql([
    ("user", sql_str(PR.ANALYZE_POST) + " || content"),
    ("assistant", "CASE WHEN manipulative THEN 'true' ELSE '[]' END")]) + " AS line FROM posts")
def q_t2(spark, sf):
    return PR.sft_binary_pairs(fixtures.posts(spark, sf))


_LABEL_TPL = PR.LABEL_INSTRUCTION.replace("{labels_string_with_descriptions}", PR.labels_with_descriptions())


@register("sft_label_pairs", covers="T3", sql=with_views("label_text") + "SELECT id, " + _fill_sql(
    _LABEL_TPL, text="content") + " AS user, CASE WHEN techniques_text IS NULL OR techniques_text = '' THEN '' "
    "ELSE techniques_text END AS assistant FROM label_text")
def q_t3(spark, sf):
    return PR.sft_label_pairs(fixtures.label_text(spark, sf))


@register("chat_render", covers="T4", sql="""
SELECT conv_id, CASE WHEN bool_or(role IS NULL OR text IS NULL) THEN NULL ELSE '<bos>' || string_agg(
  '<start_of_turn>' || CASE WHEN role = 'assistant' THEN 'model' ELSE role END || chr(10) || text || '<end_of_turn>' || chr(10),
  '' ORDER BY turn) END AS text FROM conversations GROUP BY conv_id""")
def q_t4(spark, sf):
    msgs = PR.conversation_messages(tables.conversations(spark, sf))
    return msgs.select("conv_id", PR.chat_render(F.col("messages")).alias("text"))


@register("inference_prompts", covers="T6 P15", sql=with_views("posts") + "SELECT id, " + sql_str(PR.ANALYZE_POST)
          + " || content AS plain_prompt, '<bos><start_of_turn>user' || chr(10) || " + _fill_sql(_LABEL_TPL, text="content")
          + " || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) AS chat_prompt FROM posts "
            "WHERE length(id) > 0 AND length(content) > 0")
def q_t6(spark, sf):
    p = fixtures.posts(spark, sf).where((F.length("id") > 0) & (F.length("content") > 0))
    return PR.inference_prompts(p)


def _examples(spark, sf):
    p = fixtures.posts(spark, sf).select("id", "content", F.explode("techniques").alias("label"))
    key = F.struct(md5_u32(F.concat(F.col("id"), F.lit(":42"))).alias("h"), F.col("id"))
    return p.groupBy("label").agg(F.min_by("content", key).alias("example"))


_AUG = PR.AUGMENT_USER.replace("{n}", "25")


@register("augment_prompts", covers="T5", sql=with_views("posts") + f"""
, ex AS (SELECT label, arg_min(content, ({duck_md5_u32("id || ':42'")}, id)) AS example
         FROM (SELECT id, content, unnest(techniques) AS label FROM posts) GROUP BY label),
d AS (SELECT * FROM (VALUES {", ".join(f"({sql_str(k)}, {sql_str(v)})" for k, v in vocab.LABEL_DEFINITIONS.items())}) t(label, d))
SELECT ex.label, {sql_str(PR.AUGMENT_SYSTEM)} AS system,
       replace({_fill_sql(_AUG.replace("{t}", chr(0)), d="coalesce(d.d, 'A specific manipulation technique.')",
                          e="'Example: \"' || ex.example || '\"'")}, chr(0), ex.label) AS user
FROM ex LEFT JOIN d ON ex.label = d.label WHERE ex.label <> 'loaded_language'""")
def q_t5(spark, sf):
    return PR.augment_prompts(_examples(spark, sf))


@register("sft_accounting", covers="G20", sql=with_views("posts") + """
SELECT count(*) AS n_raw, count(*) AS n_formatted,
       CAST(sum(CASE WHEN content IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_final,
       CAST(sum(CASE WHEN content IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_skipped FROM posts""")
def q_g20(spark, sf):
    p = fixtures.posts(spark, sf)
    msg = F.array(F.struct(F.lit("user").alias("role"), PR.label_user_content(F.col("content")).alias("content")),
                  F.struct(F.lit("assistant").alias("role"), F.lit("").alias("content")))
    text = PR.chat_render(msg)
    return p.select(text.alias("t")).agg(
        F.count(F.lit(1)).alias("n_raw"), F.count(F.lit(1)).alias("n_formatted"),
        F.sum(F.col("t").isNotNull().cast("bigint")).cast("bigint").alias("n_final"),
        F.sum(F.col("t").isNull().cast("bigint")).cast("bigint").alias("n_skipped"))
