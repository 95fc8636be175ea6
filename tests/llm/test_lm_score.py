import random
import re
import zlib
from collections import Counter, defaultdict
from math import exp, log, log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagwise.llm import lm_score as L
from tagwise.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
TOY = ["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "bab", "é", "aé"]


def toy(seed=1):
    p = np.random.default_rng(seed).random(len(TOY) + 257)
    return L.Pieces(tuple(TOY), np.log(p / p.sum()))


def segmentations(text, pieces):
    """Every list of piece numbers that spells ``text``; a mark inside comes from bytes only."""
    n = len(pieces.words)
    if not text:
        yield []
        return
    for i, w in enumerate(pieces.words):
        if text[0].startswith(w[0]) and "".join(text[:len(w)]) == w:
            for rest in segmentations(text[len(w):], pieces):
                yield [i, *rest]
    for rest in segmentations(text[1:], pieces):
        yield [n + b for b in text[0].strip("!").encode()] + rest


def spelled(word):
    return [L.MARK] + [c if c != L.MARK else "!" + c for c in word]


def brute_word(word, pieces):
    ways = [(exp(sum(pieces.logs[i] for i in s)), s) for s in segmentations(spelled(word), pieces)]
    total, want = sum(p for p, _ in ways), np.zeros(len(pieces.logs))
    for p, s in ways:
        for i in s:
            want[i] += p / total
    return log(total), want


@pytest.mark.parametrize("word", ["a", "ab", "abab", "bébaé", "x", "▁x", "a▁b▁", "日b", "babab" * 2])
def test_forward_sum_is_over_all_segmentations(word):
    pieces = toy()
    lattice = L.Lattice(pieces)
    total, counts = brute_word(word, pieces)
    for got in (lattice.score(word), lattice.scores([word, "ab"])[0], lattice.scores(["q", word, ""])[1]):
        assert got == pytest.approx(total, abs=1e-9)
    one, many = np.zeros(len(pieces.logs)), np.zeros(len(pieces.logs))
    lattice.expect(word, 3.0, one)
    lattice.expect_all([word], np.array([3.0]), many)
    assert one == pytest.approx(3 * counts, abs=1e-9) and many == pytest.approx(3 * counts, abs=1e-9)


def test_long_words_are_scored_whole():
    lattice = L.Lattice(toy())
    word = "".join(random.Random(2).choice("abé日") for _ in range(40_000))
    ahead = [0.0]
    text = L.MARK + word
    for j in range(1, len(text) + 1):
        ways = [ahead[j - 1] + lattice.spelled(text[j - 1])] + [ahead[j - len(w)] + lattice.logs[i] for i, w in enumerate(TOY) if j >= len(w) and text[j - len(w):j] == w]
        top = max(ways)
        ahead.append(top + log(sum(exp(x - top) for x in ways)))
    assert lattice.score(word) == pytest.approx(ahead[-1], rel=1e-9)
    assert lattice.scores([word, "a"])[0] == pytest.approx(ahead[-1], rel=1e-9)


def brute(rows, pieces, rounds):
    """rows: (key, text, held out) -> {key: (held, tokens, known, N, base, score)}"""
    train = Counter()
    for _, t, held in rows:
        if not held:
            train.update([*words_of(t), ""])
    total, distinct = sum(train.values()), len(train)
    for _ in range(rounds if total else 0):
        counts = np.full(len(pieces.logs), L.ADDED)
        lattice = L.Lattice(pieces)
        for w, n in train.items():
            if w:
                lattice.expect(w, n, counts)
        counts[-1] += train[""]
        pieces = L.Pieces(pieces.words, np.log(counts / counts.sum()))
    lattice, memo, out = L.Lattice(pieces), {}, defaultdict(list)
    for key, t, held in rows:
        tokens = [*words_of(t), ""]
        for w in tokens:
            memo.setdefault(w, lattice.score(w) if w else pieces.end)
        out[key].append((bool(held), len(tokens), sum(train[w] > 0 for w in tokens), total, sum(log10((train[w] + 1) / (total + distinct + 1)) for w in tokens),
                         sum(memo[w] for w in tokens) / log(10)))
    return out


def check(got, want):
    assert len(got) == sum(map(len, want.values()))
    left = {k: sorted(v) for k, v in want.items()}
    for r in sorted(got, key=lambda r: (str(r[0]), tuple(r[1:]))):
        w = left[r[0]].pop(0)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert (r.base_score, r.score) == pytest.approx(w[4:], rel=1e-9)


@pytest.mark.parametrize("head", [L.HEAD, 0.02])
def test_rows_match_brute_force_with_and_without_a_tail(spark, texts, monkeypatch, head):
    """A share of 2 % sends most words through the join."""
    monkeypatch.setattr(L, "HEAD", head)
    rows = [(i, t, i % 3 == 1) for i, t in enumerate(texts)] + [(7, "again", None), (None, "a b", False), (900, None, True), (901, "A▁B " * 9, False)]
    rows = [(k, t, h) for k, t, h in rows if k != 7 or t == "again"]
    df = spark.createDataFrame(rows, "id bigint, text string, held boolean").repartition(4)
    check(L.score_texts(df, "id", "text", F.col("held"), toy(), rounds=2).collect(), brute(rows, toy(), 2))


def test_odd_empty_and_untaught_tables(spark, odd, empty):
    rows = [(r.doc_id, r.text, False) for r in odd.collect()]
    check(L.score_texts(odd, "doc_id", "text", F.lit(False), toy(), 1).collect(), brute(rows, toy(), 1))
    assert L.score_texts(empty, "doc_id", "text", F.lit(False), toy()).count() == 0
    rows = [(r[0], r[1], True) for r in rows]
    check(L.score_texts(odd, "doc_id", "text", F.lit(True), toy()).collect(), brute(rows, toy(), 0))


def test_query_matches_brute_force_and_learning_helps(spark, sf):
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op11_subword_lattice_lm"](spark, sf).collect()
    pieces = L.load_pieces()
    check(got, brute(rows, pieces, L.ROUNDS))
    untaught = brute(rows, pieces, 0)
    assert sum(r.score for r in got if r.held_out) > 0.8 * sum(untaught[r.doc_id][0][5] for r in got if r.held_out)
