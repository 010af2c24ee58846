"""SimHash near-duplicates with pigeonring candidate filtering.

A 64-bit fingerprint is a ring of four 16-bit segments.  If two fingerprints
differ in at most three bits, then from some segment on, the differences summed
over one, two, three and four consecutive segments stay within 0, 1, 2 and 3 (the
proportional budgets).  The first two conditions are an index key: segment i as it
is, and segment i+1 as it is or with one bit turned.  The third is tested on the
members of a bucket before the whole difference is counted.

Equal fingerprints are one node.  A bucket emits a spanning forest of its links
instead of all pairs: a member that has been reached is not compared again.
Buckets hold different fingerprints that agree in about 32 bits, 8 bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.common import row_key
from pricelens.plans.components import connected_components
from pricelens.session import cut_lineage

SEED = 42
_BLOCK = 1 << 16


def simhash(text: bytes, width: int = 3, seed: int = SEED) -> int:
    """Fingerprint of a UTF-8 text: A-Z lower-cased, words between ASCII white
    space, shingles of ``width`` words with repeats; fewer words are one shingle,
    no words give 0.  A bit is set if more than half of the shingles' hashes set it."""
    w = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    grams = zip(*(w[i:] for i in range(width))) if len(w) >= width else [w]
    hashes = np.fromiter((digest(b" ".join(g), seed) for g in grams), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at:at + _BLOCK].view("u1").reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc, row_key, fp (the fingerprint as a signed long), one row per input row.
    Null texts count as empty: fingerprint 0."""
    keyed = docs.select(
        F.col(id_col).alias("doc"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"),
    )
    kind = keyed.select("doc", "row_key").schema.simpleString()[len("struct<"):-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((simhash(t, width) for t in b.column(2).to_pylist()), dtype="u8", count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found.view("i8"))], ["doc", "row_key", "fp"])

    return keyed.mapInArrow(run, kind + ",fp:bigint")


def bucket_forest(fps: np.ndarray, exact: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Edges that span the links among one bucket's fingerprints (unsigned).

    ``exact`` marks members whose own segments are the key; links need one such
    end.  Tests the ring's budget over three segments from ``start`` on, then the
    whole difference.  Reached members leave the set, so a dense bucket takes far
    fewer than all pairs.
    """
    mask = np.uint64(0)
    for k in range(3):
        mask |= np.uint64(0xFFFF << (16 * ((start + k) % 4)))

    def near(x: np.uint64, others: np.ndarray) -> np.ndarray:
        diff = others ^ x
        ok = np.bitwise_count(diff & mask) <= 2
        return ok & (np.bitwise_count(diff) <= 3)

    left, turned, edges = fps[exact], fps[~exact], []
    while left.size:
        root, left = left[0], left[1:]
        open_ends = [(root, True)]
        while open_ends:
            x, own = open_ends.pop()
            hit = near(x, left)
            if hit.any():
                found, left = left[hit], left[~hit]
                edges += [(int(root), int(y)) for y in found]
                open_ends += [(y, True) for y in found]
            if own and turned.size:
                hit = near(x, turned)
                if hit.any():
                    found, turned = turned[hit], turned[~hit]
                    edges += [(int(root), int(y)) for y in found]
                    open_ends += [(y, False) for y in found]
    return edges


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key: link each bucket, carrying an unfinished one on."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []

    def linked(keys: np.ndarray, fps: np.ndarray) -> set[tuple[int, int]]:
        edges: set[tuple[int, int]] = set()
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        size = np.diff(cuts)
        for at, n in zip(cuts[:-1][size > 1], size[size > 1]):
            start, head = int(keys[at]) >> 32, np.uint64(int(keys[at]) & 0xFFFFFFFF)
            f = fps[at:at + n]
            own = (_head(f, start) == head)
            if own.any():
                edges.update(bucket_forest(f, own, start))
        return edges

    def batch(edges: set[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(sorted(edges), dtype="u8").reshape(-1, 2).view("i8")
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        keys, fps = b.column(0).to_numpy(), b.column(1).to_numpy().view("u8")
        if keys[0] != keys[-1]:
            last = int(np.searchsorted(keys, keys[-1]))  # the batch's last bucket may go on
            kept.append((keys[:last], fps[:last]))
            yield batch(linked(*(np.concatenate(x) for x in zip(*kept))))
            kept = []
            keys, fps = keys[last:], fps[last:]
        elif kept and kept[0][0][0] != keys[0]:
            yield batch(linked(*(np.concatenate(x) for x in zip(*kept))))
            kept = []
        kept.append((keys, fps))
    if kept:
        yield batch(linked(*(np.concatenate(x) for x in zip(*kept))))


def _head(fps: np.ndarray, start: int) -> np.ndarray:
    """Segments ``start`` (low half) and ``start + 1`` (high half)."""
    turn = np.uint64(16 * start)
    ring = fps if start == 0 else (fps >> turn) | (fps << (np.uint64(64) - turn))
    return ring & np.uint64(0xFFFFFFFF)


def link_forest(nodes: DataFrame) -> DataFrame:
    """Edges a, b that connect exactly the fingerprints (column fp, distinct) that
    are linked directly or through others at three differing bits or fewer."""
    keys = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(4 * 17 - 1))).alias("j")).selectExpr(
        "fp", "j div 17 AS i", "j % 17 AS bit",
    ).selectExpr(
        "fp", "i", "bit",
        "CASE WHEN i = 0 THEN fp ELSE shiftrightunsigned(fp, cast(16 * i AS int)) | shiftleft(fp, cast(64 - 16 * i AS int)) END AS ring",
    ).selectExpr(
        "shiftleft(cast(i AS bigint), 32) | ((ring & 4294967295L)"
        " ^ (CASE WHEN bit = 16 THEN 0L ELSE shiftleft(1L, cast(16 + bit AS int)) END)) AS key", "fp",
    )
    sorted_keys = keys.repartition("key").sortWithinPartitions("key")
    return sorted_keys.mapInArrow(_bucket_edges, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per input row: id, row_key, fp, fingerprint (16 hex digits),
    component_id and representative.

    ``component_id`` is the smallest id among all rows reachable over fingerprints
    that differ in three bits or fewer; null ids count only where a component has
    no other.  ``representative`` is true for the rows that share the component's
    smallest id and, among those, the smallest row_key: one row a component unless
    the row itself is repeated.  Null and empty texts have fingerprint 0, which
    links like any other.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col, width))
    nodes = first_rows(rows)
    return place(rows, nodes, link_forest(nodes.select("fp"))).select(
        F.col("doc").alias(id_col), "row_key", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("first.doc").alias("component_id"), "representative",
    )


def first_rows(rows: DataFrame) -> DataFrame:
    """fp and ``least``, the first of its rows (doc, row_key); null ids come last."""
    return cut_lineage(rows.groupBy("fp").agg(
        F.min(F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("doc"), F.col("row_key").alias("row_key"))).alias("least")
    ))


def place(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows with ``first``, their component's first row, and ``representative``;
    ``nodes`` are their ``first_rows``, edges a, b connect values of fp."""
    hung = connected_components(edges)
    rooted = nodes.join(hung, nodes["fp"] == hung["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least").alias("first"))
    placed = cut_lineage(rooted.join(first, "root").select("fp", "first"))
    return rows.join(placed, "fp").withColumn(
        "representative", F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("row_key") == F.col("first.row_key")))


def keep_rows(
    docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: str = "left_semi", once: bool = False,
) -> DataFrame:
    """The rows of ``docs`` whose (id, row_key) is in ``chosen`` (or is not: ``left_anti``),
    columns unchanged; with ``once`` a repeated row is kept once.  Texts are dealt by row_key, one shuffle."""
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("doc"),
        row_key(F.col(id_col), F.col(text_col)).alias("row_key"),
    )
    only = chosen.select(F.col(id_col).alias("other"), F.col("row_key").alias("other_key")).distinct()
    # not an equality Spark would deal by: the key alone spreads the rows
    alike = F.coalesce(keyed["doc"] == only["other"], keyed["doc"].isNull() & only["other"].isNull())
    kept = keyed.join(only, (keyed["row_key"] == only["other_key"]) & alike, how)
    if once:
        copies = Window.partitionBy("row_key", "doc").orderBy("row_key")
        kept = kept.withColumn("nth", F.row_number().over(copies)).where("nth = 1")
    return kept.select("row.*")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row of each component, columns unchanged; a repeated row is kept once."""
    chosen = near_duplicates(docs, id_col, text_col, width).where("representative")
    return keep_rows(docs, chosen, id_col, text_col, once=True)
