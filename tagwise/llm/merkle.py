"""A Merkle manifest of a table by butterfly exchange of subtree roots.

Every row is a leaf; the leaves of a group, in order, form a tree of a fixed fanout, and the
groups' roots form the tree above. A partition is an aligned block of ``fanout ** 2`` leaves
that reduces its own subtree. Then, in round r, the partitions whose numbers differ in their
r-th digit alone swap the roots they hold; each of them hashes the common ancestor itself and
keeps the others' roots as its part of the proofs. After the last round every partition holds
the root and all upper siblings, with no way back down. The last subtree of a level may hold
too few partitions to serve every partner; each of them then sends to several.

Digests are lower-case hexadecimal text, and an inner node is the SHA-256 of its children's
texts. A level is built while it has more than one node, so a lone leaf is its own root and a
last run may hold a single node, which is hashed all the same.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import stored
from .ranking import SALTS, numbered

FANOUT = 16


def leaf(*values: Column) -> Column:
    """Hash of the values: ``-`` for a null, else the count of UTF-8 bytes, ``:`` and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def _levels(n: Column, fanout: int, most: int) -> Column:
    """Levels above ``n`` leaves, at most ``most``, by comparing with powers of the fanout."""
    return sum(((n > fanout ** k).cast("int") for k in range(1, most)), (n > 1).cast("int"))


def _depth(n: int, fanout: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def butterfly(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``nodes (tree, at, n, node)``, the partitions ``at`` from 0 to n - 1 of each tree, to
    ``(tree, at, n, root, proof)``: the siblings of each level from below, as texts ``left`` and
    ``right`` of the partition's own ancestor. One shuffle a round; a message holds a partition's
    number, root and proof, and a group at most ``fanout`` of them."""
    rounds = _depth(nodes.agg(F.max("n")).first()[0] or 0, fanout)
    none = F.array().cast("array<struct<left:string,right:string>>")
    held = nodes.select("tree", "at", "n", "node", none.alias("proof"))
    for r in range(rounds):
        held = stored(_swap(held, fanout ** r, fanout), f"round{r}")
    return held.withColumnRenamed("node", "root")


def _swap(held: DataFrame, span: int, fanout: int) -> DataFrame:
    """One round among subtrees of ``span`` partitions; trees that are one such subtree have ended."""
    at, n = F.col("at"), F.col("n")
    first = at - at % span                                     # first partition of the own subtree
    size = F.least(F.lit(span), n - first)                     # partitions in it
    digit = F.floor(at / span) % fanout
    # a short subtree is the last one of its level: it also serves the partners beyond its size
    serves = F.when(digit > 0, F.sequence(at % span, F.lit(span - 1).cast("bigint"), size)).otherwise(F.array(at % span))
    own = F.struct("at", "proof")
    sent = held.where(n > span).withColumn("low", F.explode(serves)).select(
        "tree", "n", F.floor(at / (span * fanout)).alias("group"), "low",
        F.struct(digit.alias("digit"), "node", F.when(F.col("low") == at % span, own).alias("own")).alias("m"))
    met = sent.groupBy("tree", "n", "group", "low").agg(F.array_sort(F.collect_list("m")).alias("m"))
    out = (met.select("tree", "n", F.col("m.node").alias("nodes"), F.posexplode("m").alias("i", "e")).where("e.own IS NOT NULL")
           .select("tree", F.col("e.own.at").alias("at"), "n", F.sha2(F.array_join("nodes", ""), 256).alias("node"),
                   F.concat("e.own.proof", F.array(_siblings(F.col("nodes"), F.col("i")))).alias("proof")))
    return out.unionByName(held.where(n <= span))


def _siblings(nodes: Column, i: Column) -> Column:
    """The digests before and after place ``i`` of a run, each side as one text."""
    return F.struct(F.array_join(F.slice(nodes, F.lit(1), i), "").alias("left"),
                    F.array_join(F.slice(nodes, i + 2, F.size(nodes)), "").alias("right"))


def fold(digest: Column, proof: Column) -> Column:
    """The root that follows from a digest and its siblings, level by level."""
    return F.aggregate(proof, digest, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def tampered_text(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def manifest(df: DataFrame, key: str, group: str, original: Column, changed: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """``(key, group, leaf, subroot, root, proof, proof_sha256, folded_root, verified)`` for every
    row of ``df``. ``original`` is the leaf's digest; ``changed`` the digest of what is there now
    (null where nothing changed), which is folded with the original siblings.

    Leaves ascend by key within a group, groups by name; a null comes first in both, and rows
    of one key ascend by digest. ``proof`` is the array of siblings, leaf level first, through the
    group's root up to the root of all. A table without rows gives none. Only keys and digests
    are shuffled, never the rows themselves; a group of any size is spread by blocks."""
    leaves = numbered(df.select(F.col(key).alias("key"), F.col(group).alias("tree"), original.alias("leaf"),
                                (F.lit(None).cast("string") if changed is None else changed).alias("changed")), "tree", ["key", "leaf"])
    width = fanout ** 2
    block = (leaves.groupBy("tree", F.floor(F.col("at") / width).alias("block"), "n")
             .agg(F.array_sort(F.collect_list(F.struct("at", "key", "leaf", "changed"))).alias("rows")))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / fanout).cast("int")),
                       lambda i: F.array_join(F.slice(F.col("rows.leaf"), i * fanout + 1, fanout), ""))
    block = block.withColumn("runs", runs).withColumn("level", F.transform("runs", lambda s: F.sha2(s, 256)))
    local = _levels(F.col("n"), fanout, 2)
    node = (F.when(local == 0, F.element_at("rows", 1)["leaf"]).when(local == 1, F.element_at("level", 1))
            .otherwise(F.sha2(F.array_join("level", ""), 256)))
    block = stored(block.withColumn("node", node), "blocks")

    upper = butterfly(block.select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / width).alias("n"), "node"), fanout)
    tops = numbered(upper.where("at = 0").select(F.col("tree").alias("name"), "root", F.col("n").alias("blocks"), F.lit(0).alias("all")), "all", ["name"])
    tops = stored(tops, "tops")
    trees = butterfly(tops.select(F.lit(0).alias("tree"), "at", "n", F.col("root").alias("node")), fanout)
    trees = trees.select("at", F.col("root").alias("whole"), F.col("proof").alias("above")).join(tops, "at")
    # a group's proof meets its blocks under as many salts as the group has blocks, at most SALTS
    salts = F.sequence(F.lit(0), F.least(F.col("blocks"), F.lit(SALTS)).cast("int") - 1)
    trees = trees.select("name", "whole", "above", F.explode(salts).alias("salt"))
    upper = upper.join(trees, F.col("tree").eqNullSafe(F.col("name")) & (F.col("at") % SALTS == F.col("salt"))).select(
        F.col("tree").alias("t"), F.col("at").alias("b"), F.col("root").alias("subroot"), F.col("whole").alias("root"),
        F.concat("proof", "above").alias("upper"))

    each = block.join(upper, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("b"))).select(
        "tree", "n", "runs", "level", "subroot", "root", "upper", F.posexplode("rows").alias("i", "row"))
    run = F.col("runs")[F.floor(F.col("i") / fanout).cast("int")]
    o, u = F.col("i") % fanout, F.floor(F.col("i") / fanout).cast("int")
    own = F.struct(F.substring(run, F.lit(1), o * 64).alias("left"), F.substring(run, o * 64 + 65, F.length(run)).alias("right"))
    over = _siblings(F.col("level"), u)
    proof = F.concat(F.when(local == 0, F.array().cast("array<struct<left:string,right:string>>")).when(local == 1, F.array(own))
                     .otherwise(F.array(own, over)), F.col("upper"))
    each = each.select(F.col("row.key").alias(key), F.col("tree").alias(group), F.col("row.leaf").alias("leaf"), F.col("row.changed").alias("changed"),
                       "subroot", "root", proof.alias("proof"))
    text = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    folded = fold(F.coalesce("changed", "leaf"), F.col("proof"))
    return (each.select(key, group, "leaf", "subroot", "root", "proof", F.sha2(text, 256).alias("proof_sha256"), folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))

