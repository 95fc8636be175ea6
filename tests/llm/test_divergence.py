import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tagwise.llm import divergence as D
from tagwise.llm.tokens import TERMS, WORDS, row_words, split
from tagwise.llm.words import PIECE

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
S = 10**9


def brute(rows, top=200, min_docs=3):
    """rows: (lang, source, text) -> sorted result."""
    use, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        use[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        mine = {s: c for (x, s), c in use.items() if x == lang}
        every, v = Counter(), len(kept)
        for c in mine.values():
            every.update(c)
        n = lambda c: sum(c[t] for t in kept)
        shares = lambda c, total: [1 + S * (c[t] + 1) // (total + v) for t in kept]
        p = {s: shares(c, n(c)) for s, c in mine.items()}
        q = shares(every, n(every))
        for s in mine:
            pairs = [(sum((a - b) ** 2 // b for a, b in zip(p[s], p[o], strict=True)), o) for o in mine if o != s]
            terms = [((a - b) ** 2 // b, t) for t, a, b in zip(kept, p[s], q, strict=True) if mine[s][t] and a > b]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(items[:most], 1)]
    return sorted(out)


def make(spark, rows, parts=4):
    return spark.createDataFrame(rows, "lang string, source string, text string").repartition(parts)


def random_rows(seed, n, sources, words=60):
    r = random.Random(seed)
    vocab = ["The", "É", "ßa", "a1b", "x-y", "ÉA", "日本"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(words)]
    return [(r.choice(["en", "de", None, ""]), f"s{min(r.randrange(sources), r.randrange(sources))}", " ".join(r.choice(vocab) for _ in range(r.randrange(40)))) for _ in range(n)]


@pytest.mark.parametrize("blocks", [(16, 1 << 14), (3, 8)])
def test_all_cells_add_up(spark, monkeypatch, blocks):
    """Small blocks give many cells along all three axes."""
    monkeypatch.setattr(D, "GROUP_BLOCK", blocks[0])
    monkeypatch.setattr(D, "TERM_BLOCK", blocks[1])
    monkeypatch.setattr(D, "HELD", 50)
    rows = random_rows(1, 400, 11) + [("en", None, None), ("fr", "empty", None), ("fr", "other", "12 !"), ("it", "lone", "uno uno due")]
    assert sorted(tuple(r) for r in D.audit(make(spark, rows)).collect()) == brute(rows)


def test_top_terms_ties_and_repeated_rows(spark):
    rows = [("en", s, t) for s, t in (("a", "x y z"), ("a", "x y z"), ("b", "x y"), ("b", "q x"), ("c", "x"))] * 2
    assert sorted(tuple(r) for r in D.audit(make(spark, rows), top=2).collect()) == brute(rows, top=2)


def test_odd_and_empty_tables(spark, odd, empty):
    rows = [tuple(r) for r in odd.select("lang", "source", "text").collect()]
    assert sorted(tuple(r) for r in D.audit(odd).collect()) == brute(rows)
    assert D.audit(empty).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    r = random.Random(3)
    c, extra = [r.randrange(10**13) for _ in range(200)], [r.randrange(1, 10**15) for _ in range(200)]
    want = [1 + S * (a + 1) // (a + b + 7) for a, b in zip(c, extra, strict=True)]
    df = spark.createDataFrame([(a, a + b) for a, b in zip(c, extra, strict=True)], "c bigint, n bigint").selectExpr("c", "n", "CAST(7 AS BIGINT) v")
    assert [x[0] for x in df.select(D.share("c", "n", "v")).collect()] == want
    assert D._shares(np.array(c), np.array(c) + np.array(extra) + 7).tolist() == want


def test_long_texts_are_cut_between_words():
    text = ("Ab cÉ9d " * (PIECE // 5)).encode() + b"x" * (2 * PIECE + 5) + b" End"
    assert sum(split(text, WORDS), []) == text.translate(WORDS).split()
    assert sum(split(text, TERMS), []) == text.translate(TERMS).split() and sum(split(None, TERMS), []) == []


def test_row_words_equal_a_plain_split():
    import pyarrow as pa
    texts = [None, "", " x", "ab", "cd Ef\tef\x0bÉ É", "é1é-Z " * 700, "  ", "y" * (2 * PIECE + 9) + " z", "Ab c " * PIECE]
    column = pa.array([t and t.encode() for t in texts], pa.binary())
    for table, pattern in ((WORDS, r"[^\x20\x09-\x0D]+"), (TERMS, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")):
        got = {}
        for rows, words, n in row_words(column, table):
            for row, word, k in zip(rows.tolist(), words.to_pylist(), n.tolist(), strict=True):
                assert (row, word) not in got
                got[row, word.decode()] = k
        want = {(i, w): k for i, t in enumerate(texts) for w, k in Counter(re.findall(pattern, (t or "").translate(LOWER))).items()}
        assert got == want
