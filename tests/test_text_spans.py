"""Cleaning, language repair, spans and attention masks on literal fixtures."""

from pyspark.sql import functions as F

from tagwise.functions import text as T
from tagwise.operators import spans as SP


def _col(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("s"))).collect()]


def test_clean_text_space_and_drop(spark):
    src = ["Hello @user #Tag http://x.y/z  it's GREAT!!", None, "Ünïcode—dash\tTab", "a,b"]
    assert _col(spark, lambda c: T.clean_text(c, " "), src) == ["hello tag it's great", "", "ünïcode dash tab", "a b"]
    assert _col(spark, lambda c: T.clean_text(c, ""), src)[3] == "ab"


def test_clean_for_embedding_drops_emoji_and_urls(spark):
    out = _col(spark, T.clean_for_embedding, ["Wow 😀🎉 see https://ex.com/a?b=1  NOW", "a❤️b"])
    assert out == ["wow see now", "ab"]


def test_language_from_letters(spark):
    out = _col(spark, T.language_from_content, ["Їжак і ґанок", "Съешь этих мягких", "і ы", "abc"])
    assert out == ["uk", "ru", "ru", "ru"]
    df = spark.createDataFrame([("data_ru.csv", "Їжак")], "f string, t string")
    assert df.select(T.repaired_language(T.language_from_filename(F.col("f")), F.col("t"))).first()[0] == "uk"


def test_span_phrases_validation(spark):
    rows = [("Hello there, World!", [[0, 5], [-1, 3], [6, 100], [7, 7], [12, 13], [13, 19]]),
            ("abc", []), ("abc", None), (None, [[0, 1]])]
    df = spark.createDataFrame(rows, "content string, spans array<array<int>>")
    out = [r[0] for r in df.select(SP.span_phrases(F.col("content"), F.col("spans"))).collect()]
    assert out == [["hello", "world"], None, None, None]


def test_span_slices_python_rules(spark):
    df = spark.createDataFrame([("abcdef", [[-2, 100], [4, 2], [1, 3]])], "c string, s array<array<int>>")
    assert df.select(SP.span_slices(F.col("c"), F.col("s"))).first()[0] == ["ef", "", "bc"]


def test_attention_mask(spark):
    df = spark.createDataFrame([("abcde", [[1, 3]]), ("", [[0, 1]])], "c string, s array<array<int>>")
    out = [r[0] for r in df.select(SP.attention_mask(F.col("c"), F.col("s"))).collect()]
    assert out == [[0.5, 1.0, 1.0, 0.5, 0.5], []]


def test_trigger_presence_whole_words(spark):
    texts = spark.createDataFrame([("1", "we see the big cat"), ("2", "concatenate this"), ("3", "big  cat's")],
                                  "id string, cleaned string")
    d = spark.createDataFrame([("1", "fud", "big cat"), ("1", "cliche", "cat"), ("1", "euphoria", "x")],
                              "id string, label string, phrase string")
    out = {r.id: (r.trigger_present_fud, r.trigger_present_cliche, r.trigger_present_euphoria)
           for r in SP.trigger_presence(texts, d, ["fud", "cliche", "euphoria"]).collect()}
    assert out == {"1": (1, 1, 0), "2": (0, 0, 0), "3": (0, 1, 0)}


def test_trigger_presence_long_phrase_is_matched(spark):
    long_phrase = " ".join(f"w{i}" for i in range(12))
    texts = spark.createDataFrame([("1", "x " + long_phrase + " y"), ("2", long_phrase[3:])], "id string, cleaned string")
    d = spark.createDataFrame([("1", "fud", long_phrase)], "id string, label string, phrase string")
    out = {r.id: r.trigger_present_fud for r in SP.trigger_presence(texts, d, ["fud"]).collect()}
    assert out == {"1": 1, "2": 0}


def test_trigger_presence_equals_the_regex(spark):
    import re
    phrases = ["big cat", "cat's", "'s tail", "a, b", "b - c d", "the big cat sat", "x y'", "dog"]
    texts = ["the big cat sat on a, b - c d", "big cat's tail", "a,b", "the big  cat sat", "x y'z", "x y' z", "hotdog dog's", "", "cat 's tail", None]
    d = spark.createDataFrame([("1", f"l{i}", p) for i, p in enumerate(phrases)], "id string, label string, phrase string")
    t = spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "id string, cleaned string")
    labels = [f"l{i}" for i in range(len(phrases))]
    got = {r.id: [r[f"trigger_present_{x}"] for x in labels] for r in SP.trigger_presence(t, d, labels).collect()}
    assert got == {str(i): [int(bool(re.search(r"\b" + re.escape(p) + r"\b", x or ""))) for p in phrases] for i, x in enumerate(texts)}
