import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def make_texts(seed=7, n=60):
    """Random texts with exact and near copies, shared passages, odd spaces, nulls and a long text."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "Ünd", "É"]
    body = lambda k: [r.choice(vocab) for _ in range(k)]
    passage, out = body(60), []
    for i in range(n):
        w = body(r.choice([0, 1, 2, 5, 19, 20, 21, 40, 120]))
        if i % 5 == 1:
            w = w[:len(w) // 2] + passage[r.randrange(20):r.randrange(35, 60)] + w[len(w) // 2:]
        if i % 7 == 2 and out and out[-1]:
            w = out[-1].split()
            if i % 2 and len(w) > 30:
                w[len(w) // 2] = "changed"
        out.append(r.choice([" ", "  ", "\n", "\t"]).join(w))
    out += [None, "", "  \n", "a", "the the the " * 15, " ".join(body(3000)), out[3], out[3].upper()]
    return out


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, a repeated row, and columns with the operators' own names."""
    extra = ["id", "text", "n", "label", "key", "spans", "p", "tokens", "rate", "slot", "shard", "base", "component_id", "kept"]
    schema = T.StructType([*SCHEMA.fields, *[T.StructField(c, T.StringType()) for c in extra if c != "text"]])
    row = lambda *r: (*r, *["x"] * (len(extra) - 1))
    none = (None,) * len(schema)
    return spark.createDataFrame([row(1, "a b c d e f", "en", "s", 11), row(1, "a b c d e f", "en", "s", 11), row(2, None, None, None, None), row(None, "a b c d e f", "en", None, 3), none], schema)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
