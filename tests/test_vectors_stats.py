"""Vectors, k-NN, splits and statistics: properties and brute-force checks."""

import math

import numpy as np
import pandas as pd
import plain_vectors as plain
from pyspark.sql import functions as F

from tagwise.operators import models as MO
from tagwise.operators import split as S
from tagwise.operators import stats
from tagwise.operators import vectors as V
from tagwise.sources import fixtures


def test_chunks_and_vectors_match_plain_forms(spark):
    long, words = "x" * 100, " ".join(f"w{i}" for i in range(50))
    texts = ["", None, " \n", f"a {long} b", long, words, " two\twords\n", "a a a b", "žluť 日本語 слово " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for budget in (5, 7, 512):
        got = {r.id: r for r in df.select("id", V.chunks(F.col("t"), budget).alias("c"), V.embed(F.col("t"), budget).alias("v")).collect()}
        for i, t in enumerate(texts):
            assert got[i].c == plain.chunk_words(t, budget)
            assert np.allclose(got[i].v, plain.embed_text(t, budget))
    assert plain.chunk_words("") == [""]                               # no document is lost


def test_costs_and_encoder_can_be_replaced(spark):
    @F.pandas_udf("array<int>")
    def letters(words: pd.Series) -> pd.Series:
        return words.map(lambda ws: [len(w) for w in ws])

    df = spark.createDataFrame([("1", "aaa bb c dddd"), ("2", None)], "id string, t string")
    rows = V.chunk_and_embed(df, "t", budget=5, costs=letters, encoder=lambda c: F.array(F.length(c).cast("double"))).collect()
    assert sorted((r.id, r.chunk_no, r.chunk, r.n_words, r.vector) for r in rows) == [
        ("1", 0, "aaa bb", 2, [6.0]), ("1", 1, "c dddd", 2, [6.0]), ("2", 0, "", 0, [0.0])]


def test_long_text_in_chunks(spark):
    df = spark.range(1).select(F.col("id").cast("string").alias("id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ").alias("t"))
    r = V.chunk_and_embed(df, "t").agg(F.sum("n_words").alias("n"), F.count("vector").alias("c")).first()
    assert r.n == 200_000 and r.c > 1000


def test_knn_tiles_and_leaves_out_the_query(spark, sf, monkeypatch):
    s = fixtures.store(spark, sf).select("id", "embedding")
    q = s.where("CAST(id AS INT) % 20 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    whole = {tuple(r) for r in V.knn_exact(s, q, k=4, exclude_self=True).collect()}
    monkeypatch.setattr(V, "TILE_BYTES", 4000)
    assert {tuple(r) for r in V.knn_exact(s, q, k=4, exclude_self=True).collect()} == whole
    assert len(whole) == 4 * q.count() and all(qid != i for qid, _, i, _ in whole)
    full = {(r.qid, r.id) for r in V.knn_exact(s, q, k=5).collect()}
    assert {(a, b) for a, b in full if a != b} == {(a, c) for a, _, c, _ in whole}


def test_knn_matches_brute_force(spark, sf):
    s = fixtures.store(spark, sf).select("id", "embedding")
    q = s.select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    got = V.knn_exact(s, q, k=5, max_block_bytes=20_000)             # forces several query blocks
    pdf = s.toPandas()
    x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf.embedding])
    ids = pdf.id.to_numpy()
    want = set()
    for i in range(len(ids)):
        d = ((x - x[i]) ** 2).sum(1)
        order = np.lexsort((ids, d))[:5]
        want |= {(ids[i], r + 1, ids[j]) for r, j in enumerate(order)}
    assert {(r.qid, r.rank, r.id) for r in got.collect()} == want


def test_splits_disjoint_complete_and_stratified(spark, sf):
    p = fixtures.posts(spark, sf).select("id", "manipulative")
    n = p.count()
    r2 = S.split_60_20_20(p)
    assert r2.select("id").distinct().count() == n
    strat = S.stratified_split(p, "manipulative", 0.2).cache()
    assert strat.count() == n
    for row in p.groupBy("manipulative").count().collect():
        t = strat.where((F.col("manipulative") == row.manipulative) & (F.col("split") == "test")).count()
        assert t == math.ceil(0.2 * row["count"])


def test_same_result_for_1_and_8_partitions(spark, sf):
    p = fixtures.posts(spark, sf)
    a = sorted(stats.label_distribution(p.coalesce(1)).collect())
    b = sorted(stats.label_distribution(p.repartition(8)).collect())
    assert a == b


def test_cooccurrence_diagonal_equals_label_counts(spark, sf):
    p = fixtures.posts(spark, sf)
    diag = {r.label_a: r["count"] for r in stats.label_cooccurrence(p).where("label_a = label_b").collect()}
    dist = {r.label: r["count"] for r in stats.label_distribution(p).collect()}
    assert diag == dist


def test_p_values_against_known_quantiles():
    assert abs(stats.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(stats.chi2_sf(7.814727903251178, 3) - 0.05) < 1e-9
    assert abs(stats.student_t_sf2(2.0859634472658364, 20) - 0.05) < 1e-9


def test_chi_square_with_p(spark, sf):
    r = stats.chi_square(fixtures.posts(spark, sf), "lang", "manipulative").first()
    assert r.dof == 3 and 0.0 <= r.p_value <= 1.0


def test_smote_reaches_parity(spark):
    rows = [(str(i), [float(i), float(i % 3)], 1 if i < 4 else 0) for i in range(12)]
    df = spark.createDataFrame(rows, "id string, v array<double>, y int")
    new = MO.smote(df, "v", "y")
    assert new.count() == 4 and {r.y for r in new.collect()} == {1}     # 4 minority + 4 new = 8
    for r in new.collect():
        assert 0.0 <= r.v[0] <= 3.0                                     # interpolated inside the minority


def test_knn_with_many_exact_ties(spark):
    # 20 identical vectors at the same distance: the k smallest ids must win
    rows = [(f"{i:02d}", [1.0, 0.0]) for i in range(20)] + [("q", [0.0, 0.0])]
    s = spark.createDataFrame(rows, "id string, embedding array<double>")
    q = spark.createDataFrame([("q", [0.0, 0.0])], "qid string, qvec array<double>")
    got = [(r.rank, r.id) for r in V.knn_exact(s, q, k=4).orderBy("rank").collect()]
    assert got == [(1, "q"), (2, "00"), (3, "01"), (4, "02")]
