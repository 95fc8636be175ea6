import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tagwise.llm.mixing import mix
from tagwise.llm.sharding import fill_table, place, preference, slot_of


def test_rates_meet_the_targets_and_are_not_negative(spark):
    r = random.Random(9)
    vocab = {d: [f"{d}{i}" for i in range(40)] + ["both"] for d in "abc"}
    rows = []
    for i in range(400):
        d = "a" if i % 10 < 7 else "b" if i % 10 < 9 else "c"
        w = [r.choice(vocab[d]) for _ in range(r.randrange(1, 200))]
        if i % 9 == 0:
            w += [r.choice(vocab["b"]) for _ in range(64)]
        rows.append((i, " ".join(w), d))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fitted = mix(docs, docs.where("doc_id % 3 = 0").select("doc_id", "lang"), {"a": 2, "b": 1, "c": 1}, "lang")
    got = fitted.rates(docs).collect()
    assert fitted.report["residual"] < 1e-3 and min(x.rate for x in got) >= 0
    tokens = sum(x.tokens for x in got)
    shares = [sum(x.rate * x.tokens * x.p[k] for x in got) / tokens for k in range(3)]
    assert shares == pytest.approx([0.5, 0.25, 0.25], abs=2e-3)
    assert sum((x.p[{"a": 0, "b": 1, "c": 2}[rows[x.doc_id][2]]] > 0.5) for x in got) > 370
    many = Counter(x.doc_id for x in fitted.resample(docs).collect())
    assert many == {x.doc_id: x.copies for x in got if x.copies}
    assert sum(x.copies for x in got) == pytest.approx(sum(x.rate for x in got), rel=0.1)


def test_targets_that_are_out_of_reach_leave_a_residual(spark):
    docs = spark.createDataFrame([(1, "x y z", "a"), (2, "x y", "a")], "doc_id long, text string, lang string")
    fitted = mix(docs, docs.select("doc_id", "lang"), {"b": 1.0}, "lang")
    assert fitted.model.domains == ["a"] and all(r.rate >= 0 for r in fitted.rates(docs).collect())


def test_copies_are_made_in_one_python_task_and_texts_sent_once(spark):
    """A second Python worker beside each task, and texts sent twice, took the pipeline's executors over their memory."""
    docs = spark.createDataFrame([(i, f"a{i % 3} b", "a" if i % 2 else "b") for i in range(50)], "doc_id long, text string, lang string")
    fitted = mix(docs, docs.select("doc_id", "lang"), {"a": 3, "b": 1}, "lang")
    plan = fitted.resample(docs)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 1 and "_text" not in plan


def test_mixing_odd_rows(odd, empty):
    fitted = mix(odd, odd.select("doc_id", "lang"), {"en": 1}, "lang")
    assert fitted.rates(odd).count() == 5
    assert fitted.resample(odd).columns == odd.columns
    none = mix(empty, empty.select("doc_id", "lang"), {"en": 1}, "lang")
    assert none.rates(empty).count() == 0 and none.resample(odd).count() == 5


def test_table_is_filled_in_turns():
    names = [f"s{i}" for i in range(7)]
    table = fill_table(names, 1009)
    count = Counter(table)
    assert set(count) == set(range(7)) and max(count.values()) - min(count.values()) <= 1
    # Brute force: whole permutations, one claim a turn.
    orders = [[(o + j * s) % 1009 for j in range(1009)] for o, s in (preference(n, 1009) for n in names)]
    assert all(len(set(o)) == 1009 for o in orders)
    want, left = {}, 1009
    while left:
        for i, o in enumerate(orders):
            if left:
                want[next(x for x in o if x not in want)] = i
                left -= 1
    assert [want[i] for i in range(1009)] == table
    fewer = fill_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer, strict=True)) < 1009 * 0.35
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            fill_table(*bad)


def test_placement(spark, odd, empty):
    names = ["x", "y", "z"]
    df = spark.range(3000).selectExpr("id AS doc_id", "'k' AS shard")
    got = place(df, names, size=101).collect()
    table = fill_table(names, 101)
    import hashlib
    assert all(r.slot == int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % 101 and r.shard == names[table[r.slot]] for r in got)
    assert max(Counter(r.shard for r in got).values()) < 1300
    assert place(odd, names).count() == 5 and place(empty, names).count() == 0
    assert odd.select(slot_of(F.col("doc_id"))).where("`" + odd.select(slot_of(F.col("doc_id"))).columns[0] + "` IS NULL").count() == 0


def test_toxicity_stage_takes_out_the_labelled_toxic(spark):
    # Eleven toxic labels at sf0.001 teach too little; sf0.01 has 51.
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = corpus_pipeline.drop_toxic(spark, docs, sf)
    gone = {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in clean.select("doc_id").collect()}
    toxic = {i for i, t in labels.items() if t}
    assert clean.columns == docs.columns
    assert len(gone & toxic) >= 0.8 * len(toxic) and len([i for i in gone if labels.get(i) == 0]) <= 3


def test_stages_on_the_small_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, text = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    from .test_dedup import brute_near
    once = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    keep = sorted(text)
    want = {keep[i] for i, (_, _, kept) in brute_near([text[i] for i in keep], 5).items() if kept}
    assert once.columns == columns and {r.doc_id for r in once.collect()} == want
    assert once.unionByName(once).count() == 2 * len(want)

    free = corpus_pipeline.drop_leaks(spark, docs, sf)
    items = [" ".join(r.text.split()).lower() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaky = {i for i, t in text.items() if any(x in " ".join(t.split()).lower() for x in items)}
    left = {r.doc_id for r in free.collect()}
    assert free.columns == columns and not leaky & left and len(text) - len(left) <= len(leaky) + 2

    mixed = corpus_pipeline.mix_languages(spark, docs, sf)
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= set(text)
    assert corpus_pipeline.assign_shards(spark, docs, sf).columns == ["doc_id", "text", "lang", "source", "n_chars", "slot", "shard"]


def test_pipeline_keeps_no_duplicates_of_dropped_documents(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.where("shard IS NULL").count() == 0 and 0 < out.select("doc_id").distinct().count() <= 200
