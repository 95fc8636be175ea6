"""Model queries (TF5, J9, M1, M3, M4, M5, M7, M8, R6) and the flagship submission."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as T
from ..operators import boosting as BO
from ..operators import features as FE
from ..operators import labels as LO
from ..operators import linear as LIN
from ..operators import metrics as ME
from ..operators import models as MO
from ..operators import oversample as OS
from ..operators import spans as SP
from ..operators import split as S
from ..operators import stats
from ..session import checkpointed, scratch_path, stored
from ..sources import fixtures, io
from . import q_features as QF
from . import q_spans as SPQ
from .q_splits import SPLIT_60_20_20
from .registry import register
from .sqlviews import with_views
from ..functions.hashing import duck_seeded_bucket, seeded_bucket

LABELS = vocab.CANONICAL_LABELS


def _features(spark, sf):
    """TF-IDF (vocabulary and idf fitted on the train split) plus trigger flags
    (dictionary from the train split), assembled into one vector per post."""
    posts = S.split_60_20_20(fixtures.posts(spark, sf))
    # cleaned once; fitted and transformed from there
    docs = stored(posts.select("id", "split", "techniques", T.clean_text(F.col("content")).alias("cleaned")), "cleaned")
    train_docs = docs.where(F.col("split") == "train")
    idf = FE.smoothed_idf(FE.fit_vocabulary(train_docs, "cleaned"))
    terms, idfs = FE.vocabulary_list(idf)
    dictionary = SP.trigger_dictionary(posts.where(F.col("split") == "train"))
    flagged = _with_flags(docs, checkpointed(SP.phrase_table(dictionary)))
    tf = FE.tfidf_vectors(flagged, "cleaned", terms, idfs)
    return FE.assemble(tf, "tfidf", [f"trigger_present_{x}" for x in LABELS])


def _with_flags(docs, dictionary):
    """Each row of ``docs`` with the trigger flags of every row of its id: its own where the id is there once
    (no row is shuffled), by a join on the id for the others. Null ids have none."""
    columns = tuple(c for c in docs.columns if c != "id")
    once, again = FE.keys_once(docs.where(F.col("id").isNotNull()), "id")
    out = SP.trigger_presence(once, dictionary, LABELS, keep=columns)
    if again is not None:
        out = out.unionByName(again.join(SP.trigger_presence(again, dictionary, LABELS), "id"))
    return out


FEATURE_SQL = QF.BASE + f"""
, ptr AS ({SPQ.TRAIN}), d0 AS ({SPQ.DICT_SQL.replace('FROM tr)', 'FROM ptr)')}), dict AS (SELECT id, label, unnest(phrases) AS phrase FROM d0),
ph AS (SELECT DISTINCT label, phrase FROM dict WHERE length(phrase) >= 2), flags AS ({SPQ.FLAGS_SQL}),
g AS ({QF.GRAMS.format(src='docs')}), split AS ({SPLIT_60_20_20})"""
_FLAGS = " + ".join(f"trigger_present_{x}" for x in LABELS)


@register("feature_assembly", covers="TF5 J9", sql=FEATURE_SQL + f"""
, nz AS (SELECT g.id, count(DISTINCT g.term) AS n FROM g JOIN vocab v ON g.term = v.term GROUP BY g.id)
SELECT f.id, s.split, CAST((SELECT count(*) FROM vocab) + {len(LABELS)} AS INTEGER) AS n_features,
       CAST(coalesce(nz.n, 0) + {_FLAGS} AS INTEGER) AS nnz
FROM flags f JOIN split s ON f.id = s.id LEFT JOIN nz ON f.id = nz.id""")
def q_tf5(spark, sf):
    f = _features(spark, sf).select("id", "split", F.unwrap_udt("features").alias("v"))
    # a sparse vector carries its size, a dense one is as long as its values
    return f.select("id", "split", F.when(F.col("v.type") == 0, F.col("v.size")).otherwise(F.size("v.values")).alias("n_features"),
                    F.size(F.filter("v.values", lambda x: x != 0)).alias("nnz"))


def _model_rows(spark, sf):
    """What fits and scores read of the features; they are stored once, without the parts they are made of."""
    return _features(spark, sf).select("id", "split", "techniques", "features")


def _tuned_metrics(spark, sf, kind: str):
    """Test metrics per label, with the solver's steps and the norms of its first and last gradient."""
    f = checkpointed(_model_rows(spark, sf))
    return _model_metrics(spark, f, MO.fit_linear_models(f.where(F.col("split") == "train"), LABELS, kind), kind)


def _model_metrics(spark, f, model, kind: str):
    scores = MO.score_long(MO.linear_scorer(model, spark), f.where(F.col("split") != "train"), LABELS)
    if kind == "svm":
        tst = scores.where(F.col("split") == "test").withColumn("p", (F.col("score") > 0).cast("int"))
    else:
        best = ME.best_threshold(ME.threshold_sweep(scores.where(F.col("split") == "val")))
        tst = ME.apply_thresholds(scores.where(F.col("split") == "test"), best)
    fits = spark.createDataFrame([(x, int(model.steps[i]), float(model.first_norm[i]), float(model.norm[i])) for i, x in enumerate(LABELS)],
                                 "label string, steps int, first_gradient double, last_gradient double")
    return ME.metrics_by_label(tst.select("id", "label", "y", "p")).join(fits, "label")


@register("ovr_logistic", covers="M1 M2 W3 E1")
def q_m1(spark, sf):
    return _tuned_metrics(spark, sf, "logistic")


@register("ovr_logistic_oversampled", covers="M1 M2 R6 W3 E1")
def q_m1_oversampled(spark, sf):
    """As ``ovr_logistic``, each label fitted on its own oversampled rows in the space of the
    features, as the reference does; with the number of synthetic rows."""
    f = checkpointed(_model_rows(spark, sf))
    train = f.where(F.col("split") == "train")
    made = checkpointed(OS.sparse_smote(train, LABELS))
    size = train.select("features").first()[0].size
    model = LIN.fit_linear(OS.oversampled_rows(train, made, LABELS), size, LABELS, "logistic")
    n = F.broadcast(made.groupBy("label").agg(F.count(F.lit(1)).alias("n_synthetic")))     # one row a label
    return _model_metrics(spark, f, model, "logistic").join(n, "label", "left").na.fill(0, ["n_synthetic"])


@register("ovr_linear_svc", covers="M3 E1")
def q_m3(spark, sf):
    return _tuned_metrics(spark, sf, "svm")


def _store_features(spark, sf):
    from pyspark.ml.functions import array_to_vector
    s = S.split_80_20(fixtures.store(spark, sf).where(F.size("embedding") > 0))
    return s.select("id", "split", "techniques", "embedding", array_to_vector("embedding").alias("features"))


@register("ovr_gbt", covers="M4 M5 Q8 Q19")
def q_m4(spark, sf):
    f = checkpointed(_store_features(spark, sf))
    # 10% of the training rows (by hash) are the early-stopping validation set
    train = f.where(F.col("split") == "train").withColumn(
        "is_val", seeded_bucket(F.col("id"), 7) < 10)
    models = MO.fit_one_vs_rest(train, LABELS, validation_col="is_val")
    counts = stats.class_weights_balanced(train).select("label", "count")
    thr = ME.rarity_thresholds(counts)
    scores = MO.score_trees(models, f.where(F.col("split") == "test"), LABELS)
    tst = ME.apply_thresholds(scores, thr, inclusive=True)
    trees = F.coalesce(*[F.when(F.col("label") == x, F.lit(m.getNumTrees if m else 0)) for x, m in models.items()])
    return ME.metrics_by_label(tst.select("id", "label", "y", "p")).withColumn("n_trees", trees)


@register("leafwise_gbt", covers="M4 M5 R7 Q8 Q19")
def q_m4_leafwise(spark, sf):
    """Test metrics per label of one leaf-wise model over (row, label) rows, with the rounds grown and
    kept and the validation loss before the first and after the last kept round."""
    return leafwise_metrics(spark, sf, MO.MAX_ROUNDS)


def leafwise_metrics(spark, sf, max_rounds):
    f = checkpointed(_store_features(spark, sf))
    train = f.where(F.col("split") == "train")
    model = BO.fit_boosted(BO.training_rows(train, LABELS, seeded_bucket(F.col("id"), 7) >= 10, "embedding"), LABELS, max_rounds, MO.PATIENCE)
    thr = ME.rarity_thresholds(stats.class_weights_balanced(train).select("label", "count"))
    test = f.where(F.col("split") == "test").withColumn("embedding", F.col("embedding").cast("array<double>"))
    tst = ME.apply_thresholds(MO.score_long(BO.scorer(model, spark), test, LABELS, features="embedding"), thr, inclusive=True)
    loss = model.losses or [None]
    return (ME.metrics_by_label(tst.select("id", "label", "y", "p"))
            .withColumn("rounds_kept", F.lit(len(model.trees))).withColumn("rounds_grown", F.lit(model.grown))
            .withColumn("first_loss", F.lit(loss[0]).cast("double")).withColumn("best_loss", F.lit(min(loss)).cast("double")))


B = duck_seeded_bucket("id")


@register("smote_oversample", covers="R6", sql=with_views("store") + f"""
, t AS (SELECT * FROM store WHERE len(embedding) > 0 AND {B} < 80),
c AS (SELECT label, sum(CASE WHEN list_contains(coalesce(techniques, []), label) THEN 1 ELSE 0 END) AS n_pos,
             sum(CASE WHEN list_contains(coalesce(techniques, []), label) THEN 0 ELSE 1 END) AS n_neg
      FROM t CROSS JOIN (SELECT unnest({vocab.sql_str_array(LABELS, duck=True)}) AS label) v GROUP BY label)
SELECT label, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg,
       CAST(CASE WHEN least(n_pos, n_neg) >= 2 THEN abs(n_pos - n_neg) ELSE 0 END AS BIGINT) AS n_synthetic FROM c""")
def q_r6(spark, sf):
    """Rows of each class by label, and the synthetic rows made for it."""
    f, new = _smote_rows(spark, sf)
    arr = F.coalesce("techniques", F.array().cast("array<string>"))
    each = f.select(F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.array_contains(arr, x).cast("bigint").alias("y")) for x in LABELS])).alias("e"))
    counts = each.groupBy("e.label").agg(F.sum("e.y").alias("n_pos"), F.sum(1 - F.col("e.y")).alias("n_neg"))
    made = new.groupBy("label").agg(F.count("vector").alias("n_synthetic"))
    return counts.join(made, "label", "left").select("label", "n_pos", "n_neg", F.coalesce("n_synthetic", F.lit(0).cast("bigint")).alias("n_synthetic"))


def _smote_rows(spark, sf):
    """The training rows, and (label, id, y, vector) of all labels' synthetic rows."""
    f = checkpointed(_store_features(spark, sf).where(F.col("split") == "train"))
    arr = F.coalesce("techniques", F.array().cast("array<string>"))
    new = [MO.smote(f.select("id", F.col("embedding").cast("array<double>").alias("vector"), F.array_contains(arr, x).cast("int").alias("y")), "vector", "y")
           .select(F.lit(x).alias("label"), "id", "y", "vector") for x in LABELS]
    return f, reduce(DataFrame.unionByName, new)


@register("smote_rows", covers="R6")
def q_r6_rows(spark, sf):
    """The synthetic rows themselves."""
    return _smote_rows(spark, sf)[1]


@register("score_and_submit", covers="M7 M8 L10 P16 S12 Q13")
def q_m7(spark, sf):
    f = checkpointed(_model_rows(spark, sf))
    fitted = MO.fit_linear_models(f.where(F.col("split") == "train"), LABELS, "logistic")
    path = scratch_path(spark, "models")
    io.save_model(spark, fitted, path)                       # S12: the scores come from the model read back
    model = io.load_model(spark, path)
    scores = MO.score_long(MO.linear_scorer(model, spark), f, model.labels)
    best = ME.best_threshold(ME.threshold_sweep(scores.where(F.col("split") == "val")))
    pred = ME.apply_thresholds(scores, best).where(F.col("p") == 1)
    labels = pred.groupBy("id").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    ids = f.select("id").join(labels, "id", "left")
    return LO.reorder_columns(LO.wide_labels(ids, "labels", vocab.SUBMISSION_LABELS), ["id"] + vocab.SUBMISSION_LABELS)
