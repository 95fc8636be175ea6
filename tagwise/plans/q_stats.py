"""Statistics queries (G1-G16, G18) with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from ..sources import fixtures
from .common import r6
from .registry import register
from .sqlviews import with_views

P = with_views("posts")
PN = with_views("posts_nulls")
ST = with_views("store")
M = with_views("posts", extra=[("m", "SELECT * FROM posts WHERE manipulative")])
POST_COLS = ["id", "content", "lang", "manipulative", "techniques", "trigger_words"]


@register("null_profile", covers="G1", sql=PN + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null FROM posts_nulls"
    for c in POST_COLS))
def q_null_profile(spark, sf):
    return stats.null_profile(fixtures.posts(spark, sf, null_every=17))


@register("value_counts_flag", covers="G2", sql=P + f"""
SELECT CAST(manipulative AS VARCHAR) AS value, count(*) AS count,
       {r6('count(*) * CAST(100.0 AS DOUBLE) / sum(count(*)) OVER ()')} AS percent
FROM posts GROUP BY manipulative""")
def q_value_counts_flag(spark, sf):
    return stats.value_counts(fixtures.posts(spark, sf), "manipulative")


@register("value_counts_lang", covers="G2", sql=P + f"""
SELECT lang AS value, count(*) AS count,
       {r6('count(*) * CAST(100.0 AS DOUBLE) / sum(count(*)) OVER ()')} AS percent
FROM posts GROUP BY lang""")
def q_value_counts_lang(spark, sf):
    return stats.value_counts(fixtures.posts(spark, sf), "lang")


@register("crosstab_lang_flag", covers="G3", sql=P + f"""
SELECT lang, CAST(sum(CASE WHEN NOT manipulative THEN 1 ELSE 0 END) AS BIGINT) AS n_false,
       CAST(sum(CASE WHEN manipulative THEN 1 ELSE 0 END) AS BIGINT) AS n_true,
       {r6('sum(CASE WHEN NOT manipulative THEN 1 ELSE 0 END) * CAST(100.0 AS DOUBLE) / count(*)')} AS pct_false,
       {r6('sum(CASE WHEN manipulative THEN 1 ELSE 0 END) * CAST(100.0 AS DOUBLE) / count(*)')} AS pct_true
FROM posts GROUP BY lang""")
def q_crosstab(spark, sf):
    return stats.crosstab_lang_flag(fixtures.posts(spark, sf))


@register("label_distribution", covers="G4 P14 O1", sql=M + f"""
SELECT label, count(*) AS count,
       {r6('count(*) * CAST(100.0 AS DOUBLE) / (SELECT count(*) FROM m)')} AS percent
FROM (SELECT unnest(techniques) AS label FROM m) GROUP BY label""")
def q_label_distribution(spark, sf):
    return stats.label_distribution(fixtures.posts(spark, sf))


@register("store_label_stats", covers="G5", sql=ST + """
SELECT label, count(*) AS count, CAST(sum(CASE WHEN manipulative THEN 1 ELSE 0 END) AS BIGINT) AS manipulative_count
FROM (SELECT unnest(techniques) AS label, manipulative FROM store) GROUP BY label""")
def q_store_label_stats(spark, sf):
    return stats.store_label_stats(fixtures.store(spark, sf))


@register("store_totals", covers="G6", sql=ST + f"""
SELECT count(*) AS total_documents,
       CAST(coalesce(sum(CASE WHEN manipulative THEN 1 ELSE 0 END), 0) AS BIGINT) AS manipulative_documents,
       {r6('CASE WHEN count(*) > 0 THEN coalesce(sum(CASE WHEN manipulative THEN 1 ELSE 0 END), 0) / count(*) ELSE 0 END')} AS manipulative_ratio
FROM store""")
def q_store_totals(spark, sf):
    return stats.store_totals(fixtures.store(spark, sf))


def _describe_sql(src: str, expr: str, measure: str) -> str:
    return (f"SELECT '{measure}' AS measure, count(v) AS count, {r6('avg(v)')} AS mean, "
            f"{r6('stddev_samp(v)')} AS std, {r6('min(v)')} AS min, {r6('quantile_cont(v, 0.25)')} AS p25, "
            f"{r6('quantile_cont(v, 0.5)')} AS p50, {r6('quantile_cont(v, 0.75)')} AS p75, {r6('max(v)')} AS max "
            f"FROM (SELECT CAST({expr} AS DOUBLE) AS v FROM {src})")


@register("label_count_describe", covers="G7 A4", sql=M + _describe_sql(
    "m", "len(coalesce(techniques, []))", "techniques_per_manipulative_post"))
def q_label_count_describe(spark, sf):
    return stats.label_count_describe(fixtures.posts(spark, sf))


@register("trigger_count_describe", covers="G7 A4 Q6", sql=M + _describe_sql(
    "posts", "len(coalesce(trigger_words, []))", "triggers_all") + " UNION ALL " + _describe_sql(
    "m", "len(coalesce(trigger_words, []))", "triggers_manipulative"))
def q_trigger_count_describe(spark, sf):
    return stats.trigger_count_describe(fixtures.posts(spark, sf))


@register("label_by_lang", covers="G8", sql=M + """
SELECT label, lang, count(*) AS count FROM (SELECT lang, unnest(techniques) AS label FROM m) GROUP BY label, lang""")
def q_label_by_lang(spark, sf):
    return stats.label_by_lang(fixtures.posts(spark, sf))


@register("label_cooccurrence", covers="G9", sql=M + """
, t AS (SELECT list_distinct(techniques) AS t FROM m),
pairs AS (SELECT a AS label_a, b AS label_b, count(*) AS c FROM
          (SELECT unnest(t) AS a, t FROM t) x CROSS JOIN LATERAL (SELECT unnest(x.t) AS b) z GROUP BY a, b),
v AS (SELECT DISTINCT label_a AS l FROM pairs)
SELECT va.l AS label_a, vb.l AS label_b, CAST(coalesce(p.c, 0) AS BIGINT) AS count
FROM v va CROSS JOIN v vb LEFT JOIN pairs p ON p.label_a = va.l AND p.label_b = vb.l""")
def q_label_cooccurrence(spark, sf):
    return stats.label_cooccurrence(fixtures.posts(spark, sf))


@register("label_count_histogram", covers="G10", sql=M + """
SELECT CAST(len(coalesce(techniques, [])) AS BIGINT) AS n_techniques, count(*) AS n_posts FROM m GROUP BY 1""")
def q_label_count_histogram(spark, sf):
    return stats.label_count_histogram(fixtures.posts(spark, sf))


@register("length_box_stats", covers="G11 P7", sql=P + f"""
SELECT manipulative, count(*) AS n, {r6('min(l)')} AS min, {r6('quantile_cont(l, 0.25)')} AS q1,
       {r6('quantile_cont(l, 0.5)')} AS median, {r6('quantile_cont(l, 0.75)')} AS q3,
       {r6('max(l)')} AS max, {r6('avg(l)')} AS mean
FROM (SELECT manipulative, CAST(length(coalesce(content, '')) AS DOUBLE) AS l FROM posts) GROUP BY manipulative""")
def q_length_box_stats(spark, sf):
    return stats.length_box_stats(fixtures.posts(spark, sf))


@register("label_trigger_points", covers="G11", sql=M + """
SELECT CAST(len(coalesce(techniques, [])) AS BIGINT) AS n_techniques,
       CAST(len(coalesce(trigger_words, [])) AS BIGINT) AS n_triggers, count(*) AS n_posts FROM m GROUP BY 1, 2""")
def q_label_trigger_points(spark, sf):
    return stats.label_trigger_points(fixtures.posts(spark, sf))


@register("label_trigger_corr", covers="G11", sql=M + f"""
SELECT count(*) AS n_posts, {r6('corr(CAST(len(coalesce(techniques, [])) AS DOUBLE), CAST(len(coalesce(trigger_words, [])) AS DOUBLE))')} AS corr FROM m""")
def q_label_trigger_corr(spark, sf):
    return stats.label_trigger_corr(fixtures.posts(spark, sf))


@register("chi_square_lang_flag", covers="G12", sql=P + f"""
, cells AS (SELECT lang AS r, CAST(manipulative AS VARCHAR) AS c, CAST(count(*) AS DOUBLE) AS o
            FROM posts WHERE lang IS NOT NULL AND manipulative IS NOT NULL GROUP BY 1, 2),
g AS (SELECT rr.r, cc.c FROM (SELECT DISTINCT r FROM cells) rr CROSS JOIN (SELECT DISTINCT c FROM cells) cc),
f AS (SELECT g.r, g.c, coalesce(cells.o, 0) AS o FROM g LEFT JOIN cells ON g.r = cells.r AND g.c = cells.c),
m2 AS (SELECT o, sum(o) OVER (PARTITION BY r) AS rt, sum(o) OVER (PARTITION BY c) AS ct, sum(o) OVER () AS n,
       ((SELECT count(DISTINCT r) FROM cells) - 1) * ((SELECT count(DISTINCT c) FROM cells) - 1) AS dof FROM f),
m3 AS (SELECT rt * ct / n AS e, o, dof FROM m2),
m4 AS (SELECT e, dof, CASE WHEN dof = 1 THEN o + sign(e - o) * least(0.5, abs(e - o)) ELSE o END AS oa FROM m3)
SELECT {r6('sum((oa - e) * (oa - e) / e)')} AS statistic, CAST(first(dof) AS BIGINT) AS dof FROM m4""")
def q_chi_square(spark, sf):
    return stats.chi_square(fixtures.posts(spark, sf), "lang", "manipulative", with_p=False)


@register("t_test_length", covers="G13", sql=P + f"""
, s AS (SELECT count(*) FILTER (WHERE manipulative) AS n1, avg(l) FILTER (WHERE manipulative) AS m1,
              var_samp(l) FILTER (WHERE manipulative) AS v1, count(*) FILTER (WHERE NOT manipulative) AS n2,
              avg(l) FILTER (WHERE NOT manipulative) AS m2, var_samp(l) FILTER (WHERE NOT manipulative) AS v2
       FROM (SELECT manipulative, CAST(length(content) AS DOUBLE) AS l FROM posts))
SELECT {r6('(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2))')} AS t_statistic,
       CAST(n1 + n2 - 2 AS BIGINT) AS dof, {r6('m1')} AS mean_1, {r6('m2')} AS mean_2 FROM s""")
def q_t_test(spark, sf):
    p = fixtures.posts(spark, sf)
    return stats.t_test(p, F.length("content"), F.col("manipulative"), with_p=False)


_LP = P + """
, lp AS (SELECT label, CAST(sum(CASE WHEN list_contains(coalesce(techniques, []), label) THEN 1 ELSE 0 END) AS BIGINT) AS positives,
       CAST((SELECT count(*) FROM posts WHERE len(coalesce(techniques, [])) = 0) AS BIGINT) AS posts_without_label,
       CAST((SELECT count(*) FROM posts) AS BIGINT) AS n_posts
  FROM posts CROSS JOIN (SELECT unnest(%s) AS label) v GROUP BY label)
"""


def _lp_sql() -> str:
    from .sqlviews import canon_list
    return _LP % canon_list()


@register("label_positives", covers="G14", sql=_lp_sql() + "SELECT * FROM lp")
def q_label_positives(spark, sf):
    return stats.label_positives(fixtures.posts(spark, sf))


@register("pos_weights", covers="G16", sql=_lp_sql() + f"""
SELECT label, positives, CAST(n_posts - positives AS BIGINT) AS negatives,
       {r6('(n_posts - positives) / (positives + 1e-6)')} AS pos_weight FROM lp""")
def q_pos_weights(spark, sf):
    return stats.pos_weights(fixtures.posts(spark, sf))


@register("class_weights_balanced", covers="G15 L9", sql=ST + f"""
, t AS (SELECT CASE WHEN len(coalesce(techniques, [])) = 0 THEN ['none'] ELSE list_distinct(techniques) END AS t FROM store),
c AS (SELECT label, count(*) AS count FROM (SELECT unnest(t) AS label FROM t) GROUP BY label)
SELECT label, count, {r6('(SELECT count(*) FROM t) / ((SELECT count(*) FROM c) * count)')} AS weight FROM c""")
def q_class_weights(spark, sf):
    return stats.class_weights_balanced(fixtures.store(spark, sf))


@register("label_vocabulary", covers="G18", sql=P + """
, u AS (SELECT DISTINCT 'lang' AS kind, lang AS value FROM posts
        UNION SELECT DISTINCT 'label' AS kind, unnest(techniques) AS value FROM posts)
SELECT kind, value, CAST(row_number() OVER (PARTITION BY kind ORDER BY value) AS BIGINT) AS rank FROM u""")
def q_label_vocabulary(spark, sf):
    return stats.label_vocabulary(fixtures.posts(spark, sf))


@register("chi_square_p_value", covers="G12")
def q_chi_square_p(spark, sf):
    """Statistic, dof and p-value (regularised gamma tail on the one aggregated row)."""
    return stats.chi_square(fixtures.posts(spark, sf), "lang", "manipulative", with_p=True)


@register("t_test_p_value", covers="G13")
def q_t_test_p(spark, sf):
    """t, dof and the two-sided p-value (regularised incomplete beta on one row)."""
    p = fixtures.posts(spark, sf)
    return stats.t_test(p, F.length("content"), F.col("manipulative"), with_p=True)
