"""Derived views over the test tables (the formulas are fixed in FIXTURES.md).

``posts`` turns ``documents`` + ``labels`` into the labelled-post schema the
operators expect; the other views (store, label text forms, raw model output,
scores) are built from ``posts``. Every view is a lazy DataFrame plan, so Catalyst
prunes and pushes filters through it into the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.hashing import md5_unit, seeded_bucket
from . import tables


def _word_table() -> Column:
    """Constant array<struct<label, word>> in canonical label order."""
    return F.array(*[
        F.struct(F.lit(lbl).alias("label"), F.lit(vocab.FIXTURE_WORDS[lbl]).alias("word"))
        for lbl in vocab.CANONICAL_LABELS
    ])


def posts(spark: SparkSession, sf_dir: str, null_every: int | None = None) -> DataFrame:
    """Labelled posts: id, content, lang, manipulative, techniques, trigger_words.

    ``null_every``: when set, techniques and trigger_words are null where
    ``doc_id % null_every = 0`` (used by the null-handling queries).
    """
    docs = tables.documents(spark, sf_dir).select("doc_id", "text", "lang")
    labs = tables.labels(spark, sf_dir).select("doc_id", "quality", "toxic")
    low = F.lower(F.col("text"))
    # One position per fixed label word, each computed once as a plain column
    # (no lambda captures an outer column).
    pos_cols = {lbl: _locate(F.lit(vocab.FIXTURE_WORDS[lbl]), low) for lbl in vocab.CANONICAL_LABELS}
    df = docs.join(labs, "doc_id", "left").select(
        "doc_id", "text", "lang", "quality", "toxic",
        *[p.alias(f"_p{i}") for i, p in enumerate(pos_cols.values())])
    techniques = F.filter(F.array(*[
        F.when(F.col(f"_p{i}") > 0, F.lit(lbl)) for i, lbl in enumerate(pos_cols)]),
        lambda x: x.isNotNull())
    triggers = F.filter(F.array(*[
        F.when(F.col(f"_p{i}") > 0, F.array(F.col(f"_p{i}"), F.col(f"_p{i}") + len(vocab.FIXTURE_WORDS[lbl])))
        for i, lbl in enumerate(pos_cols)]), lambda x: x.isNotNull())
    manip = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.size(techniques) > 0)
    if null_every:
        is_null = (F.col("doc_id") % null_every) == 0
        techniques = F.when(~is_null, techniques)
        triggers = F.when(~is_null, triggers)
        manip = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1),
                           F.coalesce(F.size(techniques) > 0, F.lit(False)))
    return df.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("text").alias("content"),
        "lang",
        manip.alias("manipulative"),
        techniques.alias("techniques"),
        triggers.alias("trigger_words"),
    )


def _locate(word: Column, low: Column) -> Column:
    """1-based position of ' word ' in the lowered text (0 when absent)."""
    return F.position(F.concat(F.lit(" "), word, F.lit(" ")), low)


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector store rows: posts inner join embeddings on doc_id = vec_id."""
    emb = tables.embeddings(spark, sf_dir).select(
        F.col("vec_id").cast("string").alias("id"), "embedding")
    p = posts(spark, sf_dir)
    return p.join(emb, "id", "inner").select(
        "id", "embedding", "techniques", "manipulative",
        F.col("content").alias("original_text"),
        F.col("trigger_words").alias("trigger_positions"))


def numpy_list_text(arr: Column) -> Column:
    """``['a' 'b']`` — how a numpy label array prints."""
    return F.concat(F.lit("["), F.array_join(F.transform(arr, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), " "), F.lit("]"))


def python_list_text(arr: Column) -> Column:
    """``['a', 'b']`` — how a Python list prints."""
    return F.concat(F.lit("["), F.array_join(F.transform(arr, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def label_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts whose label column arrives as text, in one of six forms by doc_id % 6.

    0 numpy form ``['a' 'b']``; 1 Python form ``['a', 'b']``; 2 glued ``ab``;
    3 comma list ``a, b``; 4 null; 5 upper-cased aliases plus an unknown name.
    """
    p = posts(spark, sf_dir)
    t = F.col("techniques")
    alias_back = {"fud": "fear_uncertainty_doubt", "bandwagon": "appeal_to_people",
                  "cliche": "thought_terminating_cliche"}
    aliased = F.transform(t, lambda x: F.upper(
        F.coalesce(*[F.when(x == F.lit(k), F.lit(v)) for k, v in alias_back.items()], x)))
    with_unknown = F.concat(aliased, F.array(F.lit("name_calling")))
    m = F.col("id").cast("bigint") % 6
    txt = (F.when(m == 0, numpy_list_text(t))
           .when(m == 1, python_list_text(t))
           .when(m == 2, F.array_join(t, ""))
           .when(m == 3, F.array_join(t, ", "))
           .when(m == 4, F.lit(None).cast("string"))
           .otherwise(numpy_list_text(with_unknown)))
    return p.select("id", "content", "lang", "manipulative", txt.alias("techniques_text"))


def raw_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model output text by doc_id % 7 (FIXTURES.md): comma list, numpy form, empty,
    null, a label inside a sentence, unknown words, generation error."""
    p = posts(spark, sf_dir)
    t = F.col("techniques")
    m = F.col("id").cast("bigint") % 7
    raw = (F.when(m == 0, F.array_join(t, ", "))
           .when(m == 1, numpy_list_text(t))
           .when(m == 2, F.lit(""))
           .when(m == 3, F.lit(None).cast("string"))
           .when(m == 4, F.concat(F.lit("The text uses "), F.array_join(t, " and "), F.lit(".")))
           .when(m == 5, F.concat_ws(", ", F.lit("name_calling"), F.array_join(t, ", ")))
           .otherwise(F.lit(vocab.GENERATION_ERROR)))
    return p.select("id", raw.alias("raw_prediction"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table (id, label, y, score, p): score = 0.55 y + 0.45 h and a weaker
    prediction p = [0.3 y + 0.7 h >= 0.5]; h = md5 bucket of id || label."""
    p = posts(spark, sf_dir).select("id", "techniques")
    lab = F.explode(F.array(*[F.lit(x) for x in vocab.CANONICAL_LABELS])).alias("label")
    long = p.select("id", "techniques", lab)
    y = F.array_contains("techniques", F.col("label")).cast("int")
    h = md5_unit(F.concat(F.col("id"), F.col("label")))
    return long.select(
        "id", "label", y.alias("y"),
        (F.lit(0.55) * y + F.lit(0.45) * h).alias("score"),
        ((F.lit(0.3) * y + F.lit(0.7) * h) >= F.lit(0.5)).cast("int").alias("p"),
    )


def score_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per post, in-row: techniques and logits in canonical order, where
    logit = (score - 0.5) * 8 and score = 0.55 y + 0.45 h (as in ``scores``)."""
    p = posts(spark, sf_dir).select("id", "techniques")
    logits = F.array(*[(
        F.lit(0.55) * F.array_contains("techniques", lbl).cast("int")
        + F.lit(0.45) * md5_unit(F.concat(F.col("id"), F.lit(lbl))) - F.lit(0.5)) * F.lit(8.0)
        for lbl in vocab.CANONICAL_LABELS])
    return p.select("id", "techniques", logits.alias("logits"))


def id_bucket(id_col: Column, seed: int = 42) -> Column:
    return seeded_bucket(id_col, seed)


def submitted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result log: posts whose bucket < 70 (about 30% are missing)."""
    p = posts(spark, sf_dir).select("id", "techniques")
    return p.where(id_bucket(F.col("id")) < 70)
