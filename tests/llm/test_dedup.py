import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tagwise.llm.exact_dedup import build_index, directory, exact_groups
from tagwise.llm.graph import components
from tagwise.llm.near_dedup import near_duplicates, sketch_limit
from tagwise.llm.substring_dedup import _blocks, remove_repeats
from tagwise.llm.words import hash_words, text_buffer, window_hashes

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    return [w for w in SPACE.split(t or "") if w]


def brute_near(texts, k, percent=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = words((t or "").translate(low))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


def test_near_duplicates_match_brute_force(docs, texts):
    for k in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, shingle_words=k).collect()}
        assert got == brute_near(texts, k)


def test_near_duplicate_chain_beyond_the_pivot(spark):
    # Neighbours share 90 %, the ends do not: the whole chain is one component.
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([f"x{j}" for j in range(6 * i)] + base[6 * i:])) for i in range(10)] + [(50, "quite another text")]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect()}
    want = {i: c for i, (_, c, _) in zip([*range(10), 50], brute_near([t for _, t in rows], 2).values(), strict=True)}
    assert {i: want_i if i < 50 else 50 for i, want_i in want.items()} == got
    assert len(set(got.values())) == 2


def test_near_duplicates_odd_rows(odd, empty):
    rows = sorted(near_duplicates(odd, shingle_words=2).collect(), key=str)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert by == {1: [(5, 1, True)] * 2, 2: [(0, 2, True)], None: [(0, None, True), (5, None, True)]}
    assert near_duplicates(empty).count() == 0


def test_sketch_limit_lets_pairs_at_the_threshold_pass():
    assert 512 * 0.1 < sketch_limit(0.8) < 512 * 0.25


def test_components_of_path_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def brute_repeats(texts, length=20):
    first, gone = {}, [set() for _ in texts]
    for d, t in enumerate(texts):
        w = words(t)
        for p in range(len(w) - length + 1):
            g = tuple(w[p:p + length])
            if g in first:
                gone[d].update(range(p, p + length))
            else:
                first[g] = (d, p)
    out = {}
    for d, t in enumerate(texts):
        w = words(t)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone[d])
        out[d] = (len(w), len(gone[d]), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_dedup_matches_brute_force(docs, texts):
    for length in (20, 4):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(docs, length=length).collect()}
        assert got == brute_repeats(texts, length)


def test_substring_dedup_odd_rows(odd, empty):
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in remove_repeats(odd, length=3).collect())
    assert got == [("1", 6, 0), ("1", 6, 0), ("2", 0, 0), ("None", 0, 0), ("None", 6, 0)]
    assert remove_repeats(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té\x0b", max_size=60)), max_size=8), st.integers(1, 6))
def test_words_and_blocks(rows, length):
    buf, offs = text_buffer(pa.array(rows, pa.string()))
    h, first = hash_words(buf, offs)
    parts = [words(t) for t in rows]
    assert np.diff(first).tolist() == [len(p) for p in parts]
    flat = [w for p in parts for w in p]
    assert len({*zip(flat, h.tolist(), strict=True)}) == len(set(flat)) == len(set(h.tolist()))
    starts, counts, seed, w = _blocks(h, first, length)
    covered = sorted(p for s, c in zip(starts, counts, strict=True) for p in range(s, s + c))
    assert covered == [int(first[i]) + p for i, x in enumerate(parts) for p in range(len(x) - length + 1)]
    # equal windows lie under equal seeds
    under = defaultdict(set)
    for s, c, g in zip(starts, counts, seed, strict=True):
        for p in range(s, s + c):
            under[tuple(flat[p:p + length])].add(int(g))
    assert all(len(v) == 1 for v in under.values())


def test_words_longer_than_a_piece():
    import tagwise.llm.words as m
    text = ("x" * 70 + " ") * 50 + "y" * 900 + " end"
    old, m.PIECE = m.PIECE, 256
    try:
        buf, offs = text_buffer(pa.array([text, text[:-4]]))
        a, first = hash_words(buf, offs)
    finally:
        m.PIECE = old
    b, first_b = hash_words(buf, offs)
    assert (a == b).all() and first.tolist() == first_b.tolist() == [0, 52, 103]
    assert len(window_hashes(a, 200)) == 0


def test_exact_groups_match_brute_force(docs, texts):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(docs, capacity=4).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[SPACE.sub("", t or "")].append(i)
    want = {}
    for norm, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        for i in ids:
            want[i] = (keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    assert got == want


def test_exact_groups_odd_rows(odd, empty):
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_groups(odd).collect())
    assert got == [("1", "1", 3, True), ("1", "1", 3, True), ("2", "2", 2, True), ("None", "1", 3, False), ("None", "2", 2, False)]
    assert exact_groups(empty).count() == 0


def test_directory_doubles_until_buckets_fit(spark, docs):
    keys = spark.range(5000).selectExpr("xxhash64(id) AS key")
    cells = directory(keys, 300)
    n = keys.selectExpr("shiftrightunsigned(key, 48) AS cell").groupBy("cell").count().join(cells, "cell").groupBy("bucket", "depth").sum("count").collect()
    assert max(r[2] for r in n) <= 300 and sum(r[2] for r in n) == 5000
    assert all(r.bucket % (1 << (16 - r.depth)) == 0 for r in n)
    index = build_index(docs, capacity=4).collect()
    assert len({(r.key, r.link) for r in index}) == len(index) and {r.link for r in index} == {0}
