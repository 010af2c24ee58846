"""Sequence packing as a cutting-stock problem.

Token counts are rounded up to a grid of classes and counted: the histogram, of
bounded size, is all that the plan needs.  The linear program "fewest sequences
whose patterns cover the histogram" is solved by column generation: the simplex
method keeps one pattern a class, a knapsack dynamic program over the prices finds
the pattern to enter.  Patterns are taken as often as the solution says, rounded
down; the remainder, less than one sequence a pattern, is packed greedily.

Pieces are ranked within their class and look their place up in the plan.  Ranks are
counted per hash bucket, so a class that holds a third of the pieces is not ordered
in one task.  Each text is tokenized once; what is shuffled is one narrow row a piece.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.common import row_key
from pricelens.llm.word_ids import WordTokenizer, worker_state
from pricelens.session import cut_lineage

#: tokens a class step; classes are 1 .. capacity / GRAIN
GRAIN = 8
BUCKETS = 256

Pattern = tuple[tuple[int, int], ...]  # (class, copies), largest class first


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc, row_key, start, length, ids_crc32, doc_tokens: each document's ids with
    ``end_id`` behind them, cut every ``capacity`` ids."""
    keyed = docs.select(
        F.col(id_col).alias("doc"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("body"),
    )
    kind = keyed.select("doc", "row_key").schema.simpleString()[len("struct<"):-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_state(f"words:{tokenizer_path}", lambda: WordTokenizer(tokenizer_path))
        for b in batches:
            which, rows = [], []
            for i, text in enumerate(b.column(2)):
                ids = np.append(words.ids(text.as_py()), np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    part = ids[at:at + capacity]
                    which.append(i)
                    rows.append((at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            if not rows:
                continue
            take, columns = pa.array(which), [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), *columns],
                ["doc", "row_key", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return keyed.mapInArrow(run, kind + ", start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def best_pattern(prices: np.ndarray, classes: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """Unbounded knapsack: the most valuable pattern of ``capacity`` units; value and {class index: copies}."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fit = int(np.searchsorted(classes, c, side="right"))
        value[c], choice[c] = value[c - 1], -1
        if fit:
            total = prices[:fit] + value[c - classes[:fit]]
            k = int(total.argmax())
            if total[k] > value[c] + 1e-12:
                value[c], choice[c] = total[k], k
    found: Counter[int] = Counter()
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            found[int(choice[c])] += 1
            c -= int(classes[choice[c]])
    return float(value[capacity]), dict(found)


def solve(demand: dict[int, int], capacity: int, gap: float = 1e-3) -> list[tuple[float, dict[int, int]]]:
    """Column generation: (times, {class: copies}) of the linear program's last
    basis.  Stops when the knapsack's value proves the solution within ``gap`` of
    the optimum."""
    classes = np.array(sorted(demand), dtype=np.int64)
    need = np.array([demand[int(c)] for c in classes], dtype=float)
    m = len(classes)
    fit = (capacity // classes).astype(float)
    inverse, times = np.diag(1 / fit), need / fit
    columns: list[dict[int, int]] = [{i: int(fit[i])} for i in range(m)]
    for _ in range(40 * m + 100):
        prices = inverse.sum(axis=0)  # every pattern costs one sequence
        value, pattern = best_pattern(np.maximum(prices, 0), classes, capacity)
        if value <= 1 + gap:
            break
        entering = sum(inverse[:, i] * n for i, n in pattern.items())
        positive = entering > 1e-9
        if not positive.any():
            break
        ratio = np.where(positive, times / np.where(positive, entering, 1), np.inf)
        r = int(ratio.argmin())
        times = np.maximum(times - ratio[r] * entering, 0)
        times[r] = ratio[r]
        pivot = inverse[r] / entering[r]
        inverse -= np.outer(entering, pivot)
        inverse[r] = pivot
        columns[r] = pattern
    return [(float(t), {int(classes[i]): n for i, n in p.items()}) for t, p in zip(times, columns)]


def plan(demand: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """(times, pattern) that hold every piece of the histogram exactly once.
    ``demand`` counts pieces per class (1 .. capacity units)."""
    rest = Counter({c: n for c, n in demand.items() if n})
    out: list[tuple[int, Pattern]] = []

    def add(times: int, pattern: dict[int, int]) -> None:
        out.append((times, tuple(sorted(pattern.items(), reverse=True))))
        for c, n in pattern.items():
            rest[c] -= times * n

    if rest:
        for times, pattern in solve(dict(rest), capacity):
            if whole := int(min([times + 1e-6, *(rest[c] // n for c, n in pattern.items())])):
                add(whole, pattern)
    left = sorted((c for c in rest if rest[c] > 0), reverse=True)
    while left:
        room, pattern = capacity, {}
        for c in left:
            if n := min(room // c, rest[c]):
                pattern[c] = n
                room -= n * c
        add(min(rest[c] // n for c, n in pattern.items()), pattern)
        left = [c for c in left if rest[c] > 0]
    return out


def pack(pieces: DataFrame, capacity: int = 4096, grain: int = GRAIN, buckets: int = BUCKETS) -> DataFrame:
    """Add sequence_id and offset to rows that have row_key, start and length (1 to ``capacity``).

    Sequences hold at most ``capacity`` tokens; their ids count from 0, offsets in a
    sequence are gapless from 0.  Which of the pieces of one class goes where follows
    from hash, start and row_key, so repeated rows tie and are told apart only by their place.
    """
    spark, units = pieces.sparkSession, capacity // grain
    staged = cut_lineage(
        pieces.withColumn("class", F.ceil(F.col("length") / grain).cast("int"))
        .withColumn("h", F.xxhash64("row_key", "start"))
        .withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    )
    per_bucket = cut_lineage(staged.groupBy("class", "bucket").agg(F.count("*").alias("n")))
    histogram = {r["class"]: r["n"] for r in per_bucket.groupBy("class").agg(F.sum("n").alias("n")).collect()}

    rows, ranked, sequence = [], Counter(), 0
    for times, pattern in plan(histogram, units):
        for order, (c, copies) in enumerate(pattern):
            rows.append((c, ranked[c], ranked[c] + times * copies, sequence, copies, order))
            ranked[c] += times * copies
        sequence += times
    # one row per pattern and class: bounded by the grid, not by the pieces
    places = spark.createDataFrame(rows, "class int, low long, high long, first long, copies long, nth int")

    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select("class", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("class", "bucket").orderBy("h", "start", "row_key")
    numbered = staged.withColumn("i", F.row_number().over(inside)).join(starts, ["class", "bucket"]).withColumn(
        "rank", F.col("base") + F.col("i") - 1)
    placed = numbered.join(
        F.broadcast(places),
        (numbered["class"] == places["class"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")),
    ).drop(places["class"]).withColumn("sequence_id", F.expr("first + (rank - low) div copies"))
    line = Window.partitionBy("sequence_id").orderBy("nth", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(line), F.lit(0))).select(
        *pieces.columns, "sequence_id", "offset")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, row_key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece that holds ``end_id`` only; a repeated row is
    packed as often as it comes.  An empty table gives no rows.
    """
    pieces = token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col)
    return pack(pieces, capacity).withColumnRenamed("doc", id_col)
