import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tagwise.llm import merkle as M
from tagwise.llm.queries import QUERIES

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
enc = lambda *vs: H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in vs))


def climb(nodes, fanout):
    """Root of a list of digests and the siblings (left to right) of each."""
    proofs, spans = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + fanout, len(nodes))) for a in range(0, len(nodes), fanout)]
        for run in runs:
            for k in run:
                for leaf in spans[k]:
                    proofs[leaf].append(([nodes[x] for x in run if x < k], [nodes[x] for x in run if x > k]))
        nodes, spans = [H("".join(nodes[k] for k in run)) for run in runs], [sum((spans[k] for k in run), []) for run in runs]
    return nodes[0], proofs


def brute(rows, fanout=16):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted result tuples."""
    first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    trees, order = {}, sorted(groups, key=first)
    for g in order:
        groups[g].sort(key=lambda r: (first(r[0]), enc(r[0], r[1], r[2], r[3], r[4])))
        trees[g] = climb([enc(r[0], r[1], r[2], r[3], r[4]) for r in groups[g]], fanout)
    root, tops = climb([trees[g][0] for g in order], fanout)
    out = []
    for g, top in zip(order, tops, strict=True):
        sub, proofs = trees[g]
        for r, proof in zip(groups[g], proofs, strict=True):
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            d = enc(r[0], r[1], r[2], r[3], text)
            for left, right in proof + top:
                d = H("".join(left) + d + "".join(right))
            out.append((r[0], enc(r[0], r[1], r[2], r[3], r[4]), sub, root, H("".join(x for a, b in proof + top for x in a + b)), d, d == root))
    return sorted(out, key=str)


FIELDS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def result(df, **kw):
    args = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, M.leaf(*args, M.tampered_text(F.col("text"))))
    return sorted([tuple(r[c] for c in FIELDS) for r in M.manifest(df, "doc_id", "source", M.leaf(*args, F.col("text")), tampered, **kw).collect()], key=str)


@pytest.mark.parametrize("sizes", [[1], [2], [4], [5, 1], [9, 17, 3, 1], [70, 33, 16, 65], [259]])
def test_small_fanout_reaches_many_rounds(spark, sizes):
    """A fanout of 2 gives up to eight levels and short last runs of every kind."""
    r, rows = random.Random(sum(sizes)), []
    for k, n in enumerate(sizes):
        rows += [(1000 * k + i, f"s{k}" if k else None, "en", i, r.choice(["Ab", "c", None, "É A", ""])) for i in range(n)]
    r.shuffle(rows)
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(3), fanout=2) == brute(rows, 2)


def test_fanout_sixteen_over_several_blocks_and_many_groups(spark):
    rows = [(i, "big" if i % 3 else f"g{i % 41}é", None if i % 7 == 0 else "de", i * i, f"Text {i} A") for i in range(1300)]
    rows += [(5000 + i, f"only{i}", "en", 1, "X") for i in range(20)]
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None, None)] * 20 + [(1, "a", "en", 3, "ABC")] * 3 + [(1, "a", "en", 3, "abd"), (2, "", "x", None, "")]
    got, want = result(spark.createDataFrame(rows, SCHEMA)), brute(rows)
    assert [g[:4] for g in got] == [w[:4] for w in want] and sorted(g[4] for g in got) == sorted(w[4] for w in want)
    assert all(g[6] for g in got if g[0] is None)


def test_empty_table_and_clashing_columns(spark, empty, odd):
    assert M.manifest(empty, "doc_id", "source", M.leaf(F.col("text"))).count() == 0
    names = odd.withColumnsRenamed({"key": "tree", "label": "at", "n": "node"})
    assert M.manifest(names, "doc_id", "source", M.leaf(F.col("text"))).count() == odd.count()


def test_long_text_is_hashed_whole(spark):
    rows = [(5, "a", "en", 1, "Ab " * 700_000), (6, "a", "en", 1, "Ab " * 699_999 + "Ac ")]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_query_finds_every_tampered_row(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = QUERIES["op12_butterfly_merkle_manifest"](spark, sf).collect()
    assert sorted([tuple(r[c] for c in FIELDS) for r in got], key=str) == brute(rows)
    assert {r.verified for r in got} == {True, False}
