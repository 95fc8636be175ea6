"""The trees learn from every document."""

import numpy as np

from tagwise.llm import pii


def test_sums_of_parts_give_the_model_of_the_whole(spark):
    r = np.random.default_rng(5)
    x = r.integers(0, 4, (600, pii.N_FEATURES)).astype(float)
    y, held = (x[:, 1] + x[:, 2] + r.integers(0, 2, 600) > 3).astype(float), r.random(600) < 0.3
    whole = pii.boost(x, y, held, 3)
    rows = [(*map(int, a), int(b), bool(c), 1) for a, b, c in zip(x, y, held)]
    names = [*(f"f{i}" for i in range(pii.N_FEATURES)), "y", "held", "n"]
    got = pii.boost_rows(spark.createDataFrame(rows, names).repartition(3), 3)
    assert np.allclose(sum(pii._value(t, x) for t in got.trees), sum(pii._value(t, x) for t in whole.trees))
    assert np.allclose(got.thresholds, whole.thresholds)


def test_trees_are_fitted_by_dataframe_operations_only(spark, monkeypatch):
    """No Python on the executors."""
    docs = spark.range(60).selectExpr("id AS doc_id", "concat('write to a', id, '@b.org or look at x', id, '.This') AS text")

    def used(*_, **__):
        raise AssertionError("Python on the executors")
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(docs), name, used)
    assert any(isinstance(t, pii.Tree) for t in pii.fit_pii(docs).trees)


def test_every_document_is_learnt_from(spark, monkeypatch):
    held = {}
    monkeypatch.setattr(pii, "boost_rows", lambda rows: held.update(n=rows.groupBy().sum("n").first()[0]))
    docs = spark.range(3600).selectExpr("id AS doc_id", "concat('write to a', id, '@b.org') AS text")
    pii.fit_pii(docs)
    assert held["n"] >= 3600 * 7            # the address and its rewritings, more than 3,000 documents
    pii.fit_pii(spark.createDataFrame([(1, "host 10.2.3.4")], "doc_id int, text string"))
    assert held["n"] >= 2                   # neither five digits in a row nor an @
