"""Split, sample and long-form queries."""

from __future__ import annotations


from .. import vocab
from ..functions.hashing import duck_md5_u32, duck_seeded_bucket
from ..operators import split as S
from ..sources import fixtures
from .registry import register
from .sqlviews import canon_list, with_views

P = with_views("posts")
B = duck_seeded_bucket("id")
H = duck_md5_u32("id || ':42'")


def _posts(spark, sf):
    return fixtures.posts(spark, sf).select("id", "manipulative", "techniques")


@register("split_80_20", covers="R1", sql=P + f"""
SELECT id, CASE WHEN {B} < 80 THEN 'train' ELSE 'test' END AS split FROM posts""")
def q_r1(spark, sf):
    return S.split_80_20(_posts(spark, sf)).select("id", "split")


SPLIT_60_20_20 = f"SELECT id, CASE WHEN {B} < 60 THEN 'train' WHEN {B} < 80 THEN 'val' ELSE 'test' END AS split FROM posts"


@register("split_60_20_20", covers="R2", sql=P + SPLIT_60_20_20)
def q_r2(spark, sf):
    return S.split_60_20_20(_posts(spark, sf)).select("id", "split")


@register("split_90_10", covers="R3", sql=P + f"""
SELECT id, CASE WHEN {B} < 90 THEN 'train' ELSE 'val' END AS split FROM posts""")
def q_r3(spark, sf):
    return S.split_90_10(_posts(spark, sf)).select("id", "split")


@register("split_stratified", covers="R4", sql=P + f"""
SELECT id, manipulative, CASE WHEN rn <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT id, manipulative, row_number() OVER (PARTITION BY manipulative ORDER BY {H}, id) AS rn,
         count(*) OVER (PARTITION BY manipulative) AS n FROM posts)""")
def q_r4(spark, sf):
    return S.stratified_split(_posts(spark, sf), "manipulative", 0.2).select("id", "manipulative", "split")


@register("split_sizes", covers="G19", sql=P + f"""
SELECT split, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM (
  SELECT CASE WHEN {B} < 60 THEN 'train' WHEN {B} < 80 THEN 'val' ELSE 'test' END AS split FROM posts) GROUP BY split""")
def q_g19(spark, sf):
    return S.split_sizes(S.split_60_20_20(_posts(spark, sf)))


@register("sample_n", covers="R5", sql=P + f"""
SELECT id, manipulative FROM posts ORDER BY {H}, id LIMIT 100""")
def q_r5(spark, sf):
    return S.sample_n(_posts(spark, sf), 100).select("id", "manipulative")


@register("labels_long_form", covers="R7 Q8", sql=P + f"""
SELECT id, CAST(i - 1 AS INTEGER) AS label_index, label, CAST(list_contains(coalesce(techniques, []), label) AS INTEGER) AS y
FROM (SELECT id, techniques, unnest({canon_list()}) AS label, generate_subscripts({canon_list()}, 1) AS i FROM posts)""")
def q_r7(spark, sf):
    return S.labels_long_form(_posts(spark, sf), vocab.CANONICAL_LABELS)
