"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

A suffix matters through its first ``width`` bytes only: two suffixes that agree so far
start equal windows, and deeper bytes are never looked at.  The sort goes from the most
significant digit on, and after each pass a group of one leaves.  Digits are chosen so
that neighbouring suffixes travel together as long as nothing tells them apart:

1. *Anchor.*  Among the ``gram``-byte strings of a window the one with the least hash is
   its anchor.  Equal windows have equal anchors at equal offsets, and neighbouring
   windows mostly share one, so about one row per 30 windows stands for a whole stretch
   of them.  Anchor strings that occur once in the corpus end all their windows' search.
2. *Stretch.*  Rows of one anchor whose stretches agree as a whole, byte for byte, are
   equal in all their windows: every one but the first is settled.
3. *Core.*  What is left (the first of each kind, where an anchor has several) is cut
   into blocks of ``block`` neighbouring offsets.  The digit is the core, the bytes that
   all windows of a block share; then whole blocks are settled as stretches were.
4. *Window.*  The last blocks are cut into single windows, whose digit is all of them.

Equal groups of the last digit are exactly the repeated windows; the first of each in
the order of documents and places stays.  Strings are compared by 128-bit digests.

A pass counts and finds firsts with partial aggregates, and joins them back by an
equality Spark can split, so a digit that a third of all rows share does not meet in
one task.  Texts move three times, each time dealt by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import row_key, written
from pricelens.session import discard

#: bytes of a window and of its anchor, offsets in a block
WIDTH, GRAM, BLOCK = 100, 40, 8
#: bytes hashed at a time; a longer text is cut into overlapping pieces
PIECE = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)
_BASE = 0x9E3779B97F4A7C15
#: a 64-bit number for every byte, from a seeded rule
_BYTES = np.array([xxhash.xxh3_64_intdigest(bytes([b]), 11) for b in range(256)], dtype=np.uint64)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` bytes: a polynomial, built from runs of 1, 2, 4, ...
    bytes, then mixed so that its order says nothing about the text."""
    one, power, length = _BYTES[data], _BASE, 1
    whole, have = None, 0
    while True:
        if size & length:
            if whole is None:
                whole, have = one, length
            else:
                n = len(data) - have - length + 1
                whole = whole[:n] * np.uint64(power) + one[have:have + n]
                have += length
        if 2 * length > size:
            break
        n = len(one) - length
        one = one[:n] * np.uint64(power) + one[length:]
        power, length = power * power % (1 << 64), 2 * length
    whole = whole ^ (whole >> np.uint64(31))
    whole *= np.uint64(0xD6E8FEB86659FD93)
    whole ^= whole >> np.uint64(32)
    return whole


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """Least of every ``size`` neighbours."""
    length, least = 1, values
    while 2 * length <= size:
        least = np.minimum(least[:-length], least[length:])
        length *= 2
    n, rest = len(values) - size + 1, size - length
    return np.minimum(least[:n], least[rest:rest + n]) if rest else least


def stretches(data: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end (``ends`` their ends): anchor hash, first window, windows and
    offset (anchor minus first window) of every stretch of windows that share an anchor."""
    if len(data) < width:
        return (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 3
    hashes = gram_hashes(data, gram)
    # the upper bits decide, ties go to the leftmost: both follow from the window's bytes
    least = sliding_least((hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), width - gram + 1)
    anchor = (least & _PLACE).astype(np.int64)
    new = np.empty(len(anchor), dtype=bool)
    new[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
    starts = np.concatenate([[0], ends[:-1]])
    new[starts[starts < len(new)]] = True  # a stretch stays in its text
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1
    last = np.minimum(last, ends[np.searchsorted(ends, first, side="right")] - width)
    kept = last >= first
    first, last = first[kept], last[kept]
    anchor = anchor[first]
    return hashes[anchor], first, last - first + 1, anchor - first


def pieces(offsets: np.ndarray, width: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, texts, start, stop): groups of whole texts, or overlapping parts of a long one."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1
        if j > i:
            yield i, j - i, int(offsets[i]), int(offsets[j])
            i = j
            continue
        start, stop = int(offsets[i]), int(offsets[i + 1])
        while True:
            end = min(stop, start + PIECE)
            yield i, 1, start, end
            if end == stop:
                break
            start = end - width + 1  # the first window the part before has not seen
        i += 1


def _bodies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"),
    )


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where each value begins and the last one ends."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def anchors(docs: DataFrame, id_col: str, text_col: str, width: int, gram: int) -> DataFrame:
    """anchor: the anchor hashes of all stretches."""
    bodies = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = _buffer(b.column(0))
            for i, n, start, stop in pieces(offsets, width):
                ends = np.minimum(offsets[i + 1:i + n + 1], stop) - start
                found = stretches(data[start:stop], ends, width, gram)[0]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["anchor"])

    return bodies.mapInArrow(run, "anchor bigint")


def all_stretches(docs: DataFrame, id_col: str, text_col: str, width: int, gram: int) -> DataFrame:
    """key1 (the anchor's hash), class1, class2 (digest of the stretch), doc, row_key,
    start (first window), n (windows), at (offset of the first window) of every stretch."""
    bodies = _bodies(docs, id_col, text_col)
    kind = bodies.select("doc", "row_key").schema.simpleString()[len("struct<"):-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            data, offsets = _buffer(b.column(2))
            for i, n, start, stop in pieces(offsets, width):
                ends = np.minimum(offsets[i + 1:i + n + 1], stop) - start
                part = data[start:stop]
                key, first, windows, at = stretches(part, ends, width, gram)
                if not len(first):
                    continue
                raw = part.tobytes()
                # the offset is the seed: equal bytes at other offsets are another class
                halves = np.frombuffer(b"".join(
                    [digest(raw[s:e], o) for s, e, o in zip(first.tolist(), (first + windows + width - 1).tolist(), at.tolist())]
                ), dtype="<i8").reshape(-1, 2)
                text = i + np.searchsorted(ends, first, side="right")
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(halves[:, 0]), pa.array(halves[:, 1]), b.column(0).take(rows), b.column(1).take(rows),
                     pa.array(start + first - offsets[text]), pa.array(windows.astype("i4")), pa.array(at.astype("i4"))],
                    ["key1", "class1", "class2", "doc", "row_key", "start", "n", "at"],
                )

    return bodies.mapInArrow(run, f"key1 bigint, class1 bigint, class2 bigint, {kind}, start bigint, n int, at int")


#: where a stretch stands; null ids come last
def _place() -> Column:
    return F.struct(F.col("doc").isNull().alias("none"), "doc", "row_key", "start")


def settle(rows: DataFrame, keys: list[str], classes: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """One pass over rows (keys, classes, doc, row_key, start, n, at): the stretches whose
    windows all stand earlier, too (doc, row_key, start, n), the first of each class where
    a key has several (with at), and the folders behind them."""
    first, a = written(rows.groupBy(*keys, *classes).agg(
        F.min(F.struct(_place().alias("place"), "n", "at")).alias("first"), F.count("*").alias("times")))
    again = first.where("times > 1").select(*keys, *classes, F.col("first.place").alias("least"))
    settled, b = written(rows.join(again, [*keys, *classes]).where(_place() != F.col("least")).select("doc", "row_key", "start", "n"))
    # written, because a join splits a hot key only where both sides come from plain exchanges
    several, c = written(first.groupBy(*keys).count().where("count > 1").select(*keys))
    open_rows, d = written(first.join(several, keys, "left_semi").select("first.place.doc", "first.place.row_key", "first.place.start", "first.n", "first.at"))
    discard(rows.sparkSession, a)
    discard(rows.sparkSession, c)
    return settled, open_rows, [b, d]


def _by_row(rows: DataFrame, columns: list[str]) -> DataFrame:
    """doc, row_key, and all its rows' ``columns`` in one array, bounded by the text's length."""
    return rows.groupBy("doc", "row_key").agg(F.collect_set(F.struct(*columns)).alias("parts")).withColumnsRenamed(
        {"doc": "of", "row_key": "of_key"})


def _with_texts(docs: DataFrame, parts: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    bodies = _bodies(docs, id_col, text_col)
    # not an equality Spark would deal by: the key alone spreads the rows
    alike = F.coalesce(F.col("doc") == F.col("of"), F.col("doc").isNull() & F.col("of").isNull())
    return bodies.join(parts, (F.col("row_key") == F.col("of_key")) & alike, how).drop("of", "of_key")


def blocks(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, width: int, block: int) -> DataFrame:
    """The stretches ``rows`` cut at multiples of ``block`` offsets: key1, key2 (digest of
    the core that all windows of a whole block share), class1, class2 (digest of the
    part), doc, row_key, start, n, at."""
    texts = _with_texts(docs, _by_row(rows, ["start", "n", "at"]), id_col, text_col, "inner").select(
        "doc", "row_key", "body", "parts.start", "parts.n", "parts.at")
    kind = texts.select("doc", "row_key").schema.simpleString()[len("struct<"):-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            which, place, digests = [], [], []
            starts, counts, ats = (b.column(c).to_pylist() for c in (3, 4, 5))
            for row in range(b.num_rows):
                body = b.column(2)[row].as_py()
                for start, n, at in zip(starts[row], counts[row], ats[row]):
                    anchor, low = start + at, at - n + 1  # offsets from the anchor back: at, at - 1, ..., low
                    while at >= low:
                        base = at // block * block
                        m = at - max(base, low) + 1
                        s = anchor - at
                        # windows at offsets base .. base + block - 1 share these bytes
                        digests.append(digest(body[anchor - base:anchor - base - block + 1 + width], base))
                        digests.append(digest(body[s:s + m - 1 + width], at))
                        place.append((s, m, at))
                        which.append(row)
                        at -= m
                if len(which) > 100_000 or row + 1 == b.num_rows and which:
                    halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 4)
                    where, of = np.array(place), pa.array(which)
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(halves[:, k]) for k in range(4)), b.column(0).take(of), b.column(1).take(of),
                         pa.array(where[:, 0]), pa.array(where[:, 1].astype("i4")), pa.array(where[:, 2].astype("i4"))],
                        ["key1", "key2", "class1", "class2", "doc", "row_key", "start", "n", "at"],
                    )
                    which, place, digests = [], [], []

    return texts.mapInArrow(run, f"key1 bigint, key2 bigint, class1 bigint, class2 bigint, {kind}, start bigint, n int, at int")


def covered(parts: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under the windows ``n`` from ``start`` on."""
    out: list[tuple[int, int]] = []
    for start, n in sorted(parts):
        stop = start + n - 1 + width
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, block: int = BLOCK,
) -> DataFrame:
    """One row per input row: id, row_key, n_bytes, n_removed, spans (maximal removed runs,
    bytes, end exclusive) and kept (the remaining bytes, joined).

    Removed is every byte under a string of ``width`` bytes of the text that also starts
    earlier: in a row with a smaller id, or before in the same text.  Strings are judged on
    the input and do not cross texts; cuts may fall inside a character, so ``kept`` is
    binary.  Null ids come last, rows with equal ids are ordered by a hash of their text,
    rows alike in id and text count as one and get the same result each.  Null counts as
    empty.  Other columns are ignored.  ``gram`` and ``block`` change the work, not the
    result; 1 <= gram <= width, 1 <= block <= width.
    """
    if not (1 <= gram <= width and 1 <= block <= width and width < PIECE):
        raise ValueError("gram and block must be at least 1 and at most width")
    spark, folders = docs.sparkSession, []

    def keep(*found: str) -> None:
        folders.extend(found)

    common, common_path = written(
        anchors(docs, id_col, text_col, width, gram).groupBy("anchor").count().where("count > 1").select(F.col("anchor").alias("key1")))
    shared, path = written(all_stretches(docs, id_col, text_col, width, gram).join(common, "key1", "left_semi"))
    discard(spark, common_path)
    settled, rest, found = settle(shared, ["key1"], ["class1", "class2"])
    keep(*found)
    discard(spark, path)
    parts = [settled]
    for size in dict.fromkeys((block, 1)):
        cut, path = written(blocks(docs, rest, id_col, text_col, width, size))
        settled, rest, found = settle(cut, ["key1", "key2"], ["class1", "class2"])
        keep(*found)
        discard(spark, path)
        parts.append(settled)
    removed = parts[0]
    for p in parts[1:]:
        removed = removed.unionAll(p)
    removed, path = written(_by_row(removed, ["start", "n"]))
    for f in folders:
        discard(spark, f)
    joined = _with_texts(docs, removed, id_col, text_col, "left").select("doc", "row_key", "body", "parts.start", "parts.n")
    kind = joined.select("doc", "row_key").schema.simpleString()[len("struct<"):-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                lengths, gone, spans, kept = [], [], [], []
                for body, starts, counts in zip(*(part.column(c).to_pylist() for c in (2, 3, 4))):
                    runs = covered(list(zip(starts, counts)), width) if starts else []
                    pieces_left, end = [], 0
                    for s, e in runs:
                        pieces_left.append(body[end:s])
                        end = e
                    lengths.append(len(body))
                    gone.append(sum(e - s for s, e in runs))
                    spans.append([{"start": s, "stop": e} for s, e in runs])
                    kept.append(b"".join([*pieces_left, body[end:]]))
                span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(lengths, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span),
                     pa.array(kept, pa.binary())],
                    ["doc", "row_key", "n_bytes", "n_removed", "spans", "kept"],
                )

    out = joined.mapInArrow(run, kind + ", n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")
    return out.select(F.col("doc").alias(id_col), "row_key", "n_bytes", "n_removed", "spans", "kept")
