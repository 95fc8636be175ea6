"""Divergence audit of sources by three-dimensional cube partitioning.

Within each language the sources are the groups, and the language's kept terms are dealt to
blocks. A cell of the cube is (group block, group block, term block): its task holds the two
groups' slices of the term block, replicated to every cell that needs them, and sums the
divergences of all pairs between them over its terms. One aggregate along the term axis then
adds the cells up. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import stored
from .tokens import TERMS, Sums, row_words

SCALE = 1_000_000_000
#: Groups and terms along a side of a cell: at most 32 slices of 16,384 counts meet in a task.
GROUP_BLOCK = 16
TERM_BLOCK = 1 << 14
#: Rows of the languages' totals are copied so often for a join that a large language may spread.
SALTS = 64
#: A task gives out its counts when it holds so many (some 40 bytes a row, three times as many rows before
#: they are summed and as much again while they are).
HELD = 250_000


def count_terms(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, tf, df)`` of ``docs (lang, source, text)``: how often a term occurs
    and in how many rows. Each group also has one row of the empty term. Counts are summed in
    the task first, so a frequent term costs one row a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, groups = Sums(["group", "term"], ["tf", "df"], HELD), {}
        for batch in batches:
            group = np.array([groups.setdefault(g, len(groups)) for g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
            marks = np.unique(group)
            yield from named(sums.add(entries(marks, pa.array([b""] * len(marks), pa.binary()), np.zeros(len(marks), np.int64), 0)), groups)
            for rows, terms, n in row_words(batch.column(2), TERMS):
                yield from named(sums.add(entries(group[rows], terms, n, 1)), groups)
        yield from named(sums.take(), groups)

    def entries(group, terms, n, df):
        return pa.table({"group": group, "term": terms, "tf": n.astype(np.int64), "df": np.full(len(n), df, np.int64)})

    def named(tables, groups):
        lang, source = (pa.array([g[k] for g in groups], pa.string()) for k in (0, 1))
        for table in tables:
            names = pa.table([lang.take(table["group"].combine_chunks()), source.take(table["group"].combine_chunks()), table["term"].cast(pa.string()), table["tf"], table["df"]],
                             ["lang", "source", "term", "tf", "df"])
            yield from names.to_batches(max_chunksize=50_000)

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows_in = docs.select(blank("lang").alias("lang"), blank("source").alias("source"), blank("text").cast("binary").alias("text"))
    parts = rows_in.mapInArrow(run, "lang string, source string, term string, tf bigint, df bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact at any size: in 64 bits while the
    product fits, else in decimals."""
    return F.expr(f"1 + CASE WHEN {count} < 9000000000 THEN ({count} + 1) * {SCALE} div ({total} + {terms}) ELSE "
                  f"(CAST({count} + 1 AS DECIMAL(28, 0)) * CAST({SCALE} AS DECIMAL(10, 0))) div CAST({total} + {terms} AS DECIMAL(20, 0)) END")


def _shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same in 64 bits, three digits at a time; ``total`` already includes the terms (below 9e15)."""
    whole, rest = np.divmod(count + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def _divergences(p: list, q: list, width: int) -> np.ndarray:
    """Sum over the block's terms of (p - q)^2 / q for every group of ``p`` against every one of
    ``q``. A group is (share of an absent term, places of the present ones, dense shares)."""
    dense = np.stack([g[2] for g in q])
    empty = np.array([g[0] for g in q])
    out = np.zeros((len(p), len(q)), np.int64)
    for i, (none, places, shares) in enumerate(p):
        absent = (none - empty) ** 2 // empty                  # a term that neither group has
        here = dense[:, places]
        out[i] = width * absent + ((shares[places] - here) ** 2 // here).sum(axis=1) - len(places) * absent
        own = np.zeros(width, bool)
        own[places] = True
        for j, (_, others, theirs) in enumerate(q):
            other = theirs[others[~own[others]]]               # terms of the other group alone
            out[i, j] += ((none - other) ** 2 // other).sum() - len(other) * absent[j]
    return out


def _cell(table: pa.Table) -> pa.Table:
    """All pairs between the two group blocks of a cell."""
    row = table.select(["lang", "source", "at", "total", "width", "side"]).to_pylist()
    counts = table.column("counts").combine_chunks()
    ends, flat = counts.offsets.to_numpy(), counts.values
    term, tf = flat.field("tid").to_numpy(zero_copy_only=False), flat.field("tf").to_numpy(zero_copy_only=False)
    sides = {}
    for n, r in enumerate(row):
        width, a, b = r["width"], ends[n], ends[n + 1]
        total = np.int64(max(r["total"], 1))
        none = _shares(np.zeros(1, np.int64), total)[0]
        dense = np.full(width, none)
        dense[term[a:b]] = _shares(tf[a:b].astype(np.int64), total)
        sides.setdefault(r["side"], []).append((r["source"], (none, term[a:b], dense)))
    blocks = list(sides.values())
    lang, out = row[0]["lang"], []
    for x, y in ([(0, 0)] if len(blocks) == 1 else [(0, 1), (1, 0)]):
        sums = _divergences([g for _, g in blocks[x]], [g for _, g in blocks[y]], width)
        out += [(s, t, int(sums[i, j])) for i, (s, _) in enumerate(blocks[x]) for j, (t, _) in enumerate(blocks[y]) if s != t]
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array([o[0] for o in out], pa.string()),
                     "item": pa.array([o[1] for o in out], pa.string()), "value": pa.array([o[2] for o in out], pa.int64())})


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of ``docs (lang, source, text)``.

    A language keeps the terms of at least ``min_docs`` of its rows; a null lang, source or text
    counts as empty. Part ``pair`` holds the divergence of a source from each other one of its
    language (0 where no term is kept), part ``term`` the ``top`` kept terms that the source has
    more of than its language. Ranks start at 1, by value downwards, then item. Repeated rows
    count each time; other columns are ignored; no rows give none.

    Every cell holds at most 2 * GROUP_BLOCK slices of TERM_BLOCK counts, however many
    documents, terms or sources there are; a large source is only more cells."""
    counted = stored(count_terms(docs), "counted")
    words = (counted.where("term <> ''").groupBy("lang", "term").agg(F.sum("tf").alias("lang_tf"), F.sum("df").alias("docs"))
             .where(F.col("docs") >= min_docs))
    words = stored(words, "words")
    langs = words.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_tf").alias("lang_total"))
    spread = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    blocks = F.ceil(F.col("terms") / TERM_BLOCK)
    words = (words.withColumn("salt", F.pmod(F.hash("term"), F.lit(SALTS))).join(spread, ["lang", "salt"])
             .withColumn("block", F.pmod(F.xxhash64("term"), blocks)))
    words = stored(words.select("lang", "term", share("lang_tf", "lang_total", "terms").alias("q"), "block", (F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1).alias("tid")), "terms")
    widths = words.groupBy("lang", "block").agg((F.max("tid") + 1).alias("width"))
    counts = stored(counted.where("term <> ''").join(words, ["lang", "term"]).select("lang", "source", "term", "tf", "q", "block", "tid"), "counts")

    groups = (counted.where("term = ''").select("lang", "source").distinct()
              .join(counts.groupBy("lang", "source").agg(F.sum("tf").alias("n")), ["lang", "source"], "left").join(langs.select("lang", "terms"), "lang", "left")
              .na.fill(0, ["n", "terms"]))
    groups = stored(groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
                    .withColumn("groups", F.count(F.lit(1)).over(Window.partitionBy("lang"))), "groups")
    grid = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(blocks, F.lit(1)) - 1)))

    packed = counts.groupBy("lang", "source", "block").agg(F.collect_list(F.struct("tid", "tf")).alias("counts"))
    none = F.array().cast("array<struct<tid:int,tf:bigint>>")
    slices = grid.join(packed, ["lang", "source", "block"], "left").join(widths, ["lang", "block"], "left").select(
        "lang", "source", "at", "block", (F.col("n") + F.col("terms")).alias("total"), F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("counts", none).alias("counts"),
        F.floor(F.col("at") / GROUP_BLOCK).alias("side"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("groups") - 1) / GROUP_BLOCK))).alias("other"))
    cells = slices.groupBy("lang", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "block")
    pairs = cells.applyInArrow(_cell, "lang string, source string, item string, value bigint").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    each = counts.join(grid.select("lang", "source", "block", "n", "terms"), ["lang", "source", "block"])
    each = each.withColumn("p", share("tf", "n", "terms")).where("p > q")
    each = each.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", rank.alias("rank"))
    return part(pairs, "pair").unionByName(part(each, "term").where(F.col("rank") <= top))
