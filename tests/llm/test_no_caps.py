"""Bounds that once cut results: long words, learned stems, the descent of the mixture."""

import itertools
import random

import numpy as np

from tagwise.llm import toxicity as TX
from tagwise.llm import url_filter as UF
from tagwise.llm.mixing import mix


def plain_split(lex, name):
    """All ends of every first word, without a limit."""
    best = {len(name): (0.0, [])}
    for a in range(len(name) - 1, -1, -1):
        best[a] = min((((lex.cost.get(name[a:b]) if name[a:b] in lex.cost else lex.unknown + 3.0 * (b - a)) + best[b][0], -b, [name[a:b], *best[b][1]])
                       for b in range(a + 1, len(name) + 1)), key=lambda x: (round(x[0], 9), x[1]))[::2]
    return best[0][1]


def test_split_equals_a_search_without_limits():
    r = random.Random(2)
    long = ["abc" * 11, "a" * 40, "ab" * 13]
    for _ in range(60):
        words = ["".join(r.choices("abc", k=r.randint(2, 6))) for _ in range(8)] + long
        lex = UF.Lexicon({w: r.randint(1, 500) for w in words})
        name = "".join(r.choice(words + ["".join(r.choices("abcd", k=r.randint(1, 50)))]) for _ in range(r.randint(1, 4)))
        got, want = lex.split(name), plain_split(lex, name)
        price = lambda ws: sum(lex.cost.get(w, lex.unknown + 3.0 * len(w)) for w in ws)
        assert "".join(got) == name and abs(price(got) - price(want)) < 1e-6
    assert lex.split("d" * 60) == ["d" * 60]                                  # an unknown string of any length


def test_long_words_of_the_texts_split_names(spark):
    word = "donaudampfschifffahrtsgesellschaft"
    counts = UF.word_counts(spark.createDataFrame([(f"die {word} und die stadt",), ("stadt und land",), (None,)], "text string"), "text")
    runs = spark.createDataFrame([(f"stadt{word}land",), (word[:24] + "stadt",), ("",)], "run string")
    got = {r.run: r.words for r in UF.split_runs(runs, counts).collect()}
    assert got[f"stadt{word}land"] == ["stadt", word, "land"] and got[word[:24] + "stadt"] == [word[:24], "stadt"] and got[""] == []


def test_all_stems_that_pass_the_bound_are_kept(spark):
    # 21,000 words that toxic texts alone use, more than were once kept
    words = ["".join(x) for x in itertools.product("abcdefghijklm", repeat=4)][:21_000]
    rows = [(" ".join(words[i % 4 * 5250:(i % 4 + 1) * 5250]), 1) for i in range(120)] + [("plain words only", 0)] * 120
    stems = TX._learn_stems(spark.createDataFrame(rows, "text string, y int"), 120, 120)
    passed = lambda w: any(w[:n] in stems for n in range(min(TX.PREFIXES), len(w) + 1))
    assert all(passed(w) for w in words)


def test_rates_reach_the_least_squares_optimum(spark):
    r = random.Random(4)
    vocab = {d: [f"{d}{i}" for i in range(12)] for d in "xyz"}
    docs = [(i, " ".join(r.choices(vocab[d] + (vocab["x"] if i % 3 else vocab["y"]), k=r.randint(3, 40))), d)
            for i in range(90) for d in [r.choice("xxxyz")]]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    targets, ridge = {"x": 0.2, "y": 0.3, "z": 0.5}, 1e-5
    fitted = mix(df, df.select("doc_id", "lang"), targets, "lang")
    rows = sorted(fitted.rates(df).collect(), key=lambda x: x.doc_id)
    t, p, x = np.array([a.tokens for a in rows], float), np.array([a.p for a in rows]), np.array([a.rate for a in rows])
    want = np.array([targets[d] for d in fitted.model.domains])
    inverse = np.linalg.inv((p * t[:, None]).T @ p / t.sum() + 1e-12 * np.eye(3))

    def value(x):
        gap = (t * x) @ p / t.sum() - want
        return gap @ inverse @ gap / 2 + ridge * (t @ (x - 1) ** 2) / t.sum() / 2

    z = np.ones(len(t))
    for _ in range(20_000):                                                   # plain projected gradient
        z = np.maximum(0, z - 0.7 * (p @ inverse @ ((t * z) @ p / t.sum() - want) + ridge * (z - 1)))
    assert (x >= 0).all() and value(x) < value(z) + 1e-6
    assert abs(abs((t * x) @ p / t.sum() - want).max() - fitted.report["residual"]) < 1e-9 and fitted.report["steps"] > 0
