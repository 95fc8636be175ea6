"""The cleaners give the same as the plain chains of the module's patterns."""

from pyspark.sql import functions as F

from tagwise.functions import text as T
from tagwise.llm import divergence


def test_cleaners_equal_their_patterns(spark):
    rows = ["".join(chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x3400, 64)]
    rows += [None, "", "a  b\t\tc d", "http https www. x@ @y #z ##", "https://a.b/c?d %20 e"]
    df = spark.createDataFrame([(x,) for x in rows], "t string")

    def chain(c, steps):
        for pattern, by in steps:
            c = F.lower(c) if pattern is None else F.regexp_replace(c, pattern, by)
        return F.trim(c)
    filled = F.coalesce("t", F.lit(""))
    for punct in (" ", ""):
        want = chain(filled, [(None, ""), (T.URL_ANY, ""), (T.MENTION_OR_HASH, ""), (T.NOT_WORD_SPACE_APOS, punct), (T.SPACE_RUN, " ")])
        assert df.where(T.clean_text(F.col("t"), punct) != want).count() == 0
    want = chain(F.col("t"), [(T.EMOJI, ""), (T.EMBED_URL, ""), (None, ""), (T.SPACE_RUN, " ")])
    assert df.where(~T.clean_for_embedding(F.col("t")).eqNullSafe(want)).count() == 0


def test_a_task_holds_few_counted_terms():
    assert 3 * divergence.HELD * 40 <= 32 << 20
