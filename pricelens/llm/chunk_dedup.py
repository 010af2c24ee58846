"""Substring deduplication by content-defined chunking.

A gear rolling hash over the UTF-8 bytes cuts each text where the hash's upper bits
are zero, so cuts depend on the last sixteen bytes only and meet again soon after an
insertion.  Chunks are counted by a 128-bit digest; runs of neighbouring chunks that
other documents hold too are the repeated passages.

The digests are aggregated before the shuffle and joined back with the chunks; a
digest that a third of all rows share is a skewed join key, which is split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.common import row_key

#: cut after a byte where these bits of the rolling hash are zero: one in 32
MASK = np.uint16(0xF800)
LEAST, MOST = 16, 256
#: the gear: a 16-bit number for every byte, from a seeded rule
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)], dtype=np.uint16)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + gear[byte i], kept in 16 bits, hence over 16 bytes.
    Built by doubling the window: 1, 2, 4, 8, 16 bytes."""
    h = GEAR[data]
    for width in (1, 2, 4, 8):
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint16(width)
        h = wider
    return h


def cuts(text: bytes, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks, the last one the text's end; a chunk has ``least`` to
    ``most`` bytes (the last may be shorter; up to three more bytes, not to split a
    character).  An empty text has none."""
    n = len(text)
    if not n:
        return []
    data = np.frombuffer(text, dtype=np.uint8)
    starts = np.append((data[1:] & 0xC0) != 0x80, True)  # byte i may end a chunk
    marks = (np.flatnonzero(((gear_hash(data) & MASK) == 0) & starts) + 1).tolist()
    ends, at = [], 0
    for m in [*marks, n]:
        while m - at > most:
            stop = at + most
            while not starts[stop - 1]:
                stop += 1
            if stop >= m:
                break
            ends.append(stop)
            at = stop
        if m - at >= least or m == n and m > at:
            ends.append(m)
            at = m
    return ends


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, most: int = MOST) -> DataFrame:
    """doc, row_key, nth, start, stop (code points), d1, d2 (digest): all chunks of all texts."""
    keyed = docs.select(
        F.col(id_col).alias("doc"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"),
    )
    kind = keyed.select("doc", "row_key").schema.simpleString()[len("struct<"):-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):  # a few texts at a time bound the chunks held
                part = b.slice(at, 200)
                which, nth, start, stop, digests = [], [], [], [], bytearray()
                for i, text in enumerate(part.column(2).to_pylist()):
                    ends = cuts(text, least, most)
                    if not ends:
                        continue
                    begins = [0, *ends[:-1]]
                    for s, e in zip(begins, ends):
                        digests += xxhash.xxh3_128_digest(text[s:e])
                    places = np.append(0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
                    which.append(np.full(len(ends), i))
                    nth.append(np.arange(len(ends)))
                    start.append(places[begins])
                    stop.append(places[ends])
                if not which:
                    continue
                rows = pa.array(np.concatenate(which))
                halves = np.frombuffer(bytes(digests), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array(np.concatenate(nth).astype("i4")),
                     pa.array(np.concatenate(start).astype("i8")), pa.array(np.concatenate(stop).astype("i8")),
                     pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                    ["doc", "row_key", "nth", "start", "stop", "d1", "d2"],
                )

    return keyed.mapInArrow(run, kind + ", nth int, start bigint, stop bigint, d1 bigint, d2 bigint")


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 80, least: int = LEAST, most: int = MOST,
) -> DataFrame:
    """One row per passage that consists of neighbouring chunks which other
    documents hold too: id, row_key, start, stop (code points, end exclusive),
    n_chars, n_chunks, n_places (of its most frequent chunk), first (no smaller
    row of the corpus holds it, so a deduplication keeps this one).

    Passages shorter than ``min_chars`` are common phrases and lines, not copies.
    Null and empty texts have no passages; a repeated row (same id and text) is no
    other document.  Columns besides the two named are ignored.
    """
    # texts are cut once for the counts and once for the places: cheaper than keeping all chunks on disk
    all_chunks = chunks(docs, id_col, text_col, least, most)
    row = F.struct("doc", "row_key")
    shared = all_chunks.groupBy("d1", "d2").agg(
        F.count("*").alias("n_places"), F.min(row).alias("low"), F.max(row).alias("high"),
    ).where("low.row_key <> high.row_key").select("d1", "d2", "n_places", F.col("low.row_key").alias("owner"))
    found = all_chunks.join(shared, ["d1", "d2"]).select(
        "doc", "row_key", "nth", "start", "stop", "n_places", (F.col("owner") == F.col("row_key")).alias("first"),
    ).dropDuplicates(["doc", "row_key", "nth"])
    line = Window.partitionBy("doc", "row_key").orderBy("nth")
    runs = found.withColumn("run", F.col("nth") - F.row_number().over(line)).groupBy("doc", "row_key", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n_chunks"),
        F.max("n_places").alias("n_places"), F.min("first").alias("first"),
    )
    return runs.withColumn("n_chars", F.col("stop") - F.col("start")).where(F.col("n_chars") >= min_chars).select(
        F.col("doc").alias(id_col), "row_key", "start", "stop", "n_chars", "n_chunks", "n_places", "first")
