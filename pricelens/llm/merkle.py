"""Merkle manifest of a dataset by cogrouped subtree exchange.

Every row is a leaf; a group's leaves form a tree of ``ARITY`` wide runs, the groups'
subroots form a tree above them.  A superblock is ``ARITY ** LEVELS`` consecutive
nodes, so three levels of hashing happen in one task and one exchange climbs three
levels.  Going up, each superblock is reduced to its top; the tops are the nodes of the
next exchange, a few thousand times fewer.  Going down, the nodes of an exchange are
cogrouped by superblock with the outer nodes their superblock needs (the siblings on
its way to the root), and the task that reduces the block again joins its own part of
every proof with them.  In the last exchange the nodes are the leaves: proofs are
hashed and folded there.

Positions are exact ranks without one task per group: rows are dealt by range, counted
per range, and numbered inside it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.common import written
from pricelens.session import discard

ARITY, LEVELS = 16, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEX = 64


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def runs(nodes: list[str], arity: int) -> list[str]:
    """Each run of nodes as one text; the last run may be short."""
    return ["".join(nodes[i:i + arity]) for i in range(0, len(nodes), arity)]


def climb(nodes: list[str], arity: int, levels: int, whole: bool) -> list[list[str]]:
    """The block's runs level by level, then its top.  A block that is a whole tree
    stops at one node; a part of a larger one climbs all levels, over runs of one too."""
    out, level = [], 0
    while level < levels and not (whole and len(nodes) == 1):
        joined = runs(nodes, arity)
        out.append(joined)
        nodes = [digest(j) for j in joined]
        level += 1
    return [*out, nodes]


def siblings(joined: str, place: int) -> tuple[str, str]:
    """What stands before and behind a node in its run."""
    return joined[:place * _HEX], joined[(place + 1) * _HEX:]


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for before, behind in path:
        node = digest(before + node + behind)
    return node


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    plain = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def numbered(rows: DataFrame, tree: str, order: list[str]) -> tuple[DataFrame, str]:
    """(rows with pos, from 0 in the tree by ``order``, and total, the tree's rows; folder).
    Rows alike in all these columns are interchangeable."""
    dealt, path = written(rows.repartitionByRange(tree, *order).withColumn("range", F.spark_partition_id()))
    counts = dealt.groupBy(tree, "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy(tree).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        tree, "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy(tree)).alias("total"))
    inside = Window.partitionBy("range", tree).orderBy(*order)
    placed = dealt.withColumn("i", F.row_number().over(inside)).join(starts, [tree, "range"])
    return placed.withColumn("pos", (F.col("start") + F.col("i") - 1).cast("long")).drop("range", "start", "i"), path


def _node_columns(nodes: DataFrame, block: int, *more: str) -> DataFrame:
    return nodes.select("tree", F.expr(f"pos div {block}").alias("block"), "pos", "node", "total", *more)


def tops(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """One row per superblock: tree, pos (the block), node (its top), total (the tree's blocks)."""
    block = arity ** levels

    def reduce(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        total = int(part["total"].iat[0])
        top = climb(part["node"].tolist(), arity, levels, total <= block)[-1][0]
        return pd.DataFrame({"tree": [part["tree"].iat[0]], "pos": [int(part["block"].iat[0])], "node": [top],
                             "total": [-(-total // block)]})

    return _node_columns(nodes, block).groupBy("tree", "block").applyInPandas(reduce, "tree string, pos long, node string, total long")


def exchange(nodes: DataFrame, outer: DataFrame, arity: int, levels: int) -> DataFrame:
    """tree, pos and path of every node.  A path is the tree's root, the manifest's
    root, then what stands before and behind, level by level up to the root.
    ``outer`` has the path of every superblock (tree, block, path)."""
    def join_up(part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = [(t, p, [*heads, *(x for pair in path for x in pair)]) for t, p, heads, path in block_paths(part, above, arity, levels)]
        return pd.DataFrame(rows, columns=["tree", "pos", "path"])

    return _by_block(_node_columns(nodes, arity ** levels), outer).applyInPandas(join_up, "tree string, pos long, path array<string>")


def prove(leaves: DataFrame, outer: DataFrame, arity: int, levels: int) -> DataFrame:
    """The last exchange: id (as text), leaf, subroot, root, proof_sha256 and folded_root
    of every leaf; ``leaves`` has id and ``seen``, the leaf as a verifier sees it, too."""
    def join_up(part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        part, rows = part.sort_values("pos"), []
        for of, leaf, seen, (_, _, heads, path) in zip(part["id"], part["node"], part["seen"], block_paths(part, above, arity, levels)):
            rows.append((of, leaf, *heads, digest("".join(before + behind for before, behind in path)), fold(seen, path)))
        return pd.DataFrame(rows, columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"], dtype=object)

    nodes = _node_columns(leaves, arity ** levels, "id", "seen")
    return _by_block(nodes, outer).applyInPandas(
        join_up, "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def _by_block(nodes: DataFrame, outer: DataFrame):
    return nodes.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))


def block_paths(
    part: pd.DataFrame, above: pd.DataFrame, arity: int, levels: int,
) -> Iterator[tuple[str, int, list[str], list[tuple[str, str]]]]:
    """tree, pos, both roots and the siblings on the way up, of every node of one superblock in order."""
    if not len(part):
        return
    part = part.sort_values("pos")
    climbed = climb(part["node"].tolist(), arity, levels, int(part["total"].iat[0]) <= arity ** levels)[:-1]
    first = list(above["path"].iat[0])
    heads, outer = first[:2], list(zip(first[2::2], first[3::2]))
    tail: list[tuple[str, str]] = []
    tree = part["tree"].iat[0]
    for k, pos in enumerate(part["pos"].tolist()):
        if k % arity == 0:  # the nodes of a run share all but their own level
            tail, at = [], k // arity
            for joined in climbed[1:]:
                tail.append(siblings(joined[at // arity], at % arity))
                at //= arity
            tail += outer
        own = [siblings(climbed[0][k // arity], k % arity)] if climbed else []
        yield tree, pos, heads, own + tail


class Climb:
    """All trees of ``leaves`` (tree, pos, node, total) climbed to their roots, one
    written table of tops per exchange."""

    def __init__(self, leaves: DataFrame, arity: int, levels: int):
        self.arity, self.levels, self.tiers, self.folders = arity, levels, [leaves], []
        while True:
            up, folder = written(tops(self.tiers[-1], arity, levels))
            self.folders.append(folder)
            if not up.where("total > 1").limit(1).count():
                self.roots = up.select("tree", "node")
                return
            self.tiers.append(up)

    def outer(self, root_paths: DataFrame) -> DataFrame:
        """The path of every superblock of the lowest exchange (tree, block, path), from
        the paths of the trees' roots (tree, path)."""
        outer = root_paths.select("tree", F.lit(0).cast("long").alias("block"), "path")
        for nodes in reversed(self.tiers[1:]):
            outer, folder = written(exchange(nodes, outer, self.arity, self.levels).withColumnRenamed("pos", "block"))
            self.folders.append(folder)
        return outer


def manifest(
    docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id",
    group_col: str = "source", seen: dict[str, Column] | None = None, seen_where: Column | None = None,
    arity: int = ARITY, levels: int = LEVELS,
) -> DataFrame:
    """One row per input row: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the SHA-256 of the row's ``columns``, each ``-`` if null, else byte count,
    colon, value.  Per ``group_col`` the leaves ascend by id (null first, equal ids by
    leaf), and runs of ``arity`` nodes become the hash of their joined hex digests until
    one is left, the subroot.  Subroots ascend by group (null first, then bytewise) and
    give the root likewise.  ``proof_sha256`` is the hash of all siblings from the leaf
    up.  ``folded_root`` folds the leaf with them; the leaf is computed from the columns
    as a verifier sees them where ``seen`` gives other values and ``seen_where`` holds.
    ``verified`` says whether that is the root.

    Repeated rows are leaves each.  Ids and columns are atomic values; columns besides
    those named are ignored.  An empty table gives an empty result.  Results do not
    depend on ``levels`` nor on how the input is partitioned.
    """
    spark, seen = docs.sparkSession, seen or {}
    leaf = leaf_hash([F.col(c) for c in columns])
    other = leaf_hash([seen.get(c, F.col(c)) for c in columns])
    rows, first = written(docs.select(
        F.col(id_col).alias("doc"), F.when(F.col(group_col).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(group_col).cast("string"))).alias("tree"),
        leaf.alias("node"), (F.when(F.lit(True) if seen_where is None else seen_where, other).otherwise(leaf) if seen else leaf).alias("seen"),
    ))
    ranked, second = numbered(rows, "tree", ["doc", "node", "seen"])
    leaves, third = written(ranked.withColumn("id", F.col("doc").cast("string")).drop("doc"))
    discard(spark, first)
    discard(spark, second)

    groups = Climb(leaves, arity, levels)
    ranked, fourth = numbered(groups.roots.withColumnRenamed("tree", "of").withColumn("tree", F.lit("*")), "tree", ["of"])
    subroots, fifth = written(ranked)
    over = Climb(subroots, arity, levels)
    top = over.outer(over.roots.select("tree", F.array("node", "node").alias("path")))
    lifted = exchange(subroots, top, arity, levels).join(subroots.select("pos", "of", "node"), "pos")
    paths = lifted.select(F.col("of").alias("tree"), F.concat(F.array("node"), F.slice("path", 2, F.size("path"))).alias("path"))
    outer, sixth = written(groups.outer(paths))
    for folder in [*groups.folders, *over.folders, fourth, fifth]:
        discard(spark, folder)
    return prove(leaves, outer, arity, levels).select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def ascii_lowered(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, UPPER, LOWER)
