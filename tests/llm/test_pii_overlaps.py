import random
import time

from pyspark.sql import functions as F

from tagwise.llm import pii as P


def test_choice_among_overlaps_matches_brute_force(spark):
    """A span stays if no better span meets it, whichever cluster they are in."""
    r, rows = random.Random(6), []
    for i in range(60):
        spans = set()
        for _ in range(r.randrange(25)):
            s = r.randrange(80)
            spans.add((s, r.randrange(4), s + r.randrange(1, 12)))
        rows.append((i, [(s, k, e, r.choice([0.5, 1.0, 1.5])) for s, k, e in spans]))
    kind = "array<struct<s:int,k:int,e:int,m:double>>"
    df = spark.createDataFrame(rows, f"id int, items {kind}").withColumn("items", F.array_sort("items"))
    better = lambda a, b: a["m"] > b["m"]
    kept = P._by_cluster(F.col("items"), kind, kind, lambda held: F.filter(held, lambda c: ~F.exists(held, lambda o: P._meet(o, c) & better(o, c))))
    for got in df.select("id", kept.alias("kept")).collect():
        items = rows[got.id][1]
        want = [c for c in items if not any(o[0] < c[2] and c[0] < o[2] and o[3] > c[3] for o in items)]
        assert sorted(tuple(x) for x in got.kept) == sorted(want)


def test_candidates_that_meet_a_base_span_go(spark):
    r, rows = random.Random(7), []
    one = lambda: (a := r.randrange(90), a + r.randrange(1, 9))
    for i in range(50):
        rows.append((i, [(0, *one(), "v", "l", "r") for _ in range(r.randrange(20))], [(s, 1, e) for s, e in (one() for _ in range(r.randrange(6)))]))
    df = spark.createDataFrame(rows, "id int, candidates array<struct<k:int,s:int,e:int,v:string,l:string,r:string>>, base array<struct<s:int,k:int,e:int>>")
    for got in df.select("id", P._clear(df, F.col("base")).alias("c")).collect():
        want = [c for c in rows[got.id][1] if not any(b[0] < c[2] and c[1] < b[2] for b in rows[got.id][2])]
        assert sorted(tuple(x) for x in got.c) == sorted(want)


def test_columns_of_the_caller_stay(spark):
    names = ["candidates", "base_email", "row", "_t", "_clear", "_chosen", "_s", "_m", "a.b"]
    df = spark.createDataFrame([(1, "mail a@b.co", *["mine"] * len(names))], ["doc_id", "text", *names])
    got = P.find_pii(df, P.Boosted(0.0, [], [9.0] * len(P.KINDS))).first()
    assert [got[c] for c in names] == ["mine"] * len(names) and [tuple(x) for x in got.spans] == [(5, 0, 11)]


def test_many_candidates_in_one_text(spark):
    text = " ".join(f"call {i:05d} 555-01{i % 100:02d}" for i in range(4_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begin = time.time()
    got = P.find_pii(df, P.Boosted(0.0, [], [-1.0] * len(P.KINDS))).select(F.size("spans")).first()[0]
    assert got >= 4_000 and time.time() - begin < 90
