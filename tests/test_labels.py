"""Label repair and model-output parsing on literal fixtures."""

from pyspark.sql import functions as F

from tagwise import vocab
from tagwise.functions import labels as LF
from tagwise.operators import labels as LO


def _one(spark, col_fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(col_fn(F.col("s"))).collect()]


def test_bracket_split(spark):
    out = _one(spark, LF.labels_bracket_split, ["['a' 'b']", "['a', 'b']", None, "[]", "x"])
    assert out == [["a", "b"], ["a,", "b"], [], [], ["x"]]


def test_quoted_or_single(spark):
    out = _one(spark, LF.labels_quoted_or_single, ["['a' 'b']", "['a', 'b']", "fud", None, ""])
    assert out == [["a", "b"], ["a", "b"], ["fud"], [], [""]]


def test_canonical_substring_handles_glued_and_empty_forms(spark):
    vals = ["loaded_languagewhataboutism", "['fud' 'cliche']", "nan", "{}", None, "[]", "  ", "['unknown']"]
    out = _one(spark, LF.labels_canonical, vals)
    assert out == [["loaded_language", "whataboutism"], ["cliche", "fud"], [], [], [], [], [], []]


def test_quote_delimited_multi_hot(spark):
    toks = _one(spark, LF.quote_delimited_tokens, ["['fud' 'straw_man']", "['fud']", "[]", None, "['x'  'fud']"])
    assert toks == [["fud", "straw_man"], ["fud"], [], [], ["x", "fud"]]


def test_alias_map(spark):
    out = _one(spark, LF.labels_alias, ["['Fear_Uncertainty_Doubt' 'appeal_to_people' 'x']",
                                        "['thought_terminating_cliché']", None])
    assert out == [["bandwagon", "fud"], ["cliche"], []]


def test_strict_then_lenient_parse(spark):
    rows = [("1", "fud, cliche"), ("2", "['fud' 'euphoria']"), ("3", ""), ("4", None), ("5", "[]"),
            ("6", "The text uses fud."), ("7", "[GENERATION_ERROR]"), ("8", "name_calling, fud"), ("9", "FUD")]
    df = spark.createDataFrame(rows, "id string, raw_prediction string")
    s1 = {r.id: (r.is_exception, r.labels) for r in LO.parse_output_strict(df).collect()}
    assert s1["1"] == (False, ["cliche", "fud"])
    assert s1["2"] == (False, ["euphoria", "fud"])
    assert s1["3"] == (False, []) and s1["4"] == (False, [])
    assert s1["5"][0] is True                      # literal [] is an exception (Q18)
    assert s1["6"][0] and s1["7"][0] and s1["8"][0]
    assert s1["9"] == (False, ["fud"])
    final, exc = LO.two_stage_parse(df)
    got = {r.id: r.labels for r in final.collect()}
    assert got["6"] == ["fud"] and got["8"] == ["fud"] and got["1"] == ["cliche", "fud"]
    assert {r.id for r in exc.collect()} == {"5", "7"}


def test_wide_and_reorder(spark):
    df = spark.createDataFrame([("a", ["fud", "zzz"])], "id string, labels array<string>")
    w = LO.reorder_columns(LO.wide_labels(df), ["id"] + vocab.SUBMISSION_LABELS + ["extra"])
    r = w.first().asDict()
    assert r["fud"] == 1 and r["cliche"] == 0 and r["extra"] == 0 and list(r)[0] == "id"


def test_numbered_list(spark):
    df = spark.createDataFrame([(1, "1. first\n\n2.  second \n3.third\n")], "k int, text string")
    rows = LO.numbered_list_rows(df, "text", 2, ["k"]).orderBy("item").collect()
    assert [(r.item, r.example) for r in rows] == [(1, "first"), (2, "second")]


def test_json_or_raw(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("not json",), ("",)], "t string")
    r = LO.json_or_raw(df, "t").collect()
    assert [x.is_json for x in r] == [True, False, False]


def test_scores_to_labels_strict_vs_inclusive(spark):
    df = spark.createDataFrame([([0.0, 1.0, -1.0],)], "l array<double>")
    strict = LO.scores_to_labels(df, "l", ["a", "b", "c"], 0.5).first().labels
    assert strict == ["b"]
    incl = LO.scores_to_labels(df, "l", ["a", "b", "c"], 0.5, inclusive=True).first().labels
    assert incl == ["a", "b"]
