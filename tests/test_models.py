"""Model quality beats the base rate (coefficients are not compared with scikit-learn)."""

from pyspark.sql import functions as F

from tagwise.operators import models as MO
from tagwise.plans.registry import load_all
from tagwise.session import checkpointed, few_tasks

SF = "/root/testdata/sf0.01"


def test_logistic_beats_all_positive_base_rate(spark):
    rows = load_all()["ovr_logistic"].fn(spark, SF).collect()
    assert len(rows) == 10
    model_f1 = sum(r.f1 for r in rows) / len(rows)
    base = []
    for r in rows:
        n = r.tp + r.fp + r.fn + r.tn
        p = (r.tp + r.fn) / n                       # predicting all positive: precision p, recall 1
        base.append(2 * p / (1 + p) if p > 0 else 0.0)
    assert model_f1 > sum(base) / len(base) + 0.2


def test_trees_are_fitted_over_few_partitions(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector

    seen = []
    monkeypatch.setattr(MO, "checkpointed", lambda df: seen.append(df.rdd.getNumPartitions()) or checkpointed(df))
    rows = spark.range(0, 400, 1, 64).select(F.col("id").cast("string"), (F.col("id") % 10 == 0).alias("is_val"), array_to_vector(
        F.array(F.rand(1), F.rand(2))).alias("features"), F.when(F.col("id") % 3 == 0, F.array(F.lit("a"))).alias("techniques"))
    got = MO.fit_one_vs_rest(rows, ["a"], validation_col="is_val", max_iter=2)
    assert seen == [spark.sparkContext.defaultParallelism] and got["a"].getNumTrees >= 1
    assert few_tasks(rows, 20 * 50_000).rdd.getNumPartitions() == 20
