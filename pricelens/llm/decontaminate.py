"""Benchmark decontamination by greedy string tiling.

Word runs of ``min_match`` words of the benchmark are joined with those of all
documents (seeds).  For each pair of document and item that shares a seed, greedy
string tiling covers the item: running Karp-Rabin hashes find the longest matches
among words not covered yet, these are marked, and the search goes on with shorter
ones.  Tiles may stand in any order, so reordered passages are found; the item's
covered share decides.

A match of ``min_match`` words or more consists of seeds, so the seeds of a pair are
all that tiling needs of the document: its words are rebuilt from the item's.  An item
of fewer words has one seed, its whole word sequence, and must be held whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import ALNUM, ascii_lower, row_key, words
from pricelens.llm.near_dup import keep_rows
from pricelens.session import cut_lineage

#: benchmarks with more seeds than this are joined by shuffle
BROADCAST_SEEDS = 200_000
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def _windows(tokens: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(start, rolling hash) of every window of ``size`` free tokens."""
    top = pow(_BASE, size - 1, _MOD)
    value = run = 0
    for i, (t, ok) in enumerate(zip(tokens, free)):
        if not ok:
            value = run = 0
            continue
        if run >= size:
            value = (value - tokens[i - size] * top) % _MOD
        value = (value * _BASE + t) % _MOD
        run += 1
        if run >= size:
            yield i - size + 1, value


def greedy_tiles(doc: list[int], item: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (doc start, item start, length), longest first, not overlapping on
    either side; token 0 matches nothing.  Ties go to the earliest place."""
    free_doc, free_item = [t != 0 for t in doc], [t != 0 for t in item]
    tiles: list[tuple[int, int, int]] = []
    size = max(min_match, min(len(item), 32))
    while True:
        table: dict[int, list[int]] = defaultdict(list)
        for j, h in _windows(item, free_item, size):
            table[h].append(j)
        matches, longest = [], 0
        if table:
            for i, h in _windows(doc, free_doc, size):
                for j in table.get(h, ()):
                    n = 0
                    while (i + n < len(doc) and j + n < len(item) and free_doc[i + n] and free_item[j + n]
                           and doc[i + n] == item[j + n]):
                        n += 1
                    if n >= size:
                        matches.append((-n, i, j))
                        longest = max(longest, n)
        if longest > 2 * size:
            size = longest
            continue
        again = False
        for n, i, j in sorted(matches):
            n = -n
            if all(free_doc[i:i + n]) and all(free_item[j:j + n]):
                free_doc[i:i + n] = [False] * n
                free_item[j:j + n] = [False] * n
                tiles.append((i, j, n))
            else:
                again = True  # what is left of it may still hold a match of this size
        if again:
            continue
        if size == min_match:
            return tiles
        size = max(min_match, size // 2)


def _rebuilt(seeds: list[tuple[int, int]], item: list[int], min_match: int) -> tuple[list[int], list[int]]:
    """The document's words where seeds lie, and each one's place; a 0 between stretches."""
    at: dict[int, int] = {}
    for pos, ipos in seeds:
        for k in range(min_match):
            at[pos + k] = item[ipos + k]
    tokens, places, last = [], [], None
    for p in sorted(at):
        if last is not None and p > last + 1:
            tokens.append(0)
            places.append(-1)
        tokens.append(at[p])
        places.append(p)
        last = p
    return tokens, places


def seed_table(benchmark: DataFrame, item_col: str, text_col: str, min_match: int) -> DataFrame:
    """item, item_words, ipos, size, gram, seed_words: every run of ``min_match`` words
    of each item, or its whole word sequence where that is shorter."""
    tokens = benchmark.select(F.col(item_col).alias("item"), words(ascii_lower(F.col(text_col)), ALNUM).alias("w")).select(
        "item", "w", F.least(F.size("w"), F.lit(min_match)).alias("size"), F.posexplode("w").alias("ipos", "word"))
    return tokens.where(F.col("ipos") + F.col("size") <= F.size("w")).select(
        "item", F.col("w").alias("item_words"), "ipos", "size", _gram(min_match).alias("gram"),
        F.slice("w", F.col("ipos") + 1, F.col("size")).alias("seed_words"),
    )


def _gram(min_match: int, place: str = "ipos") -> Column:
    """Hash of the ``size`` words from ``place`` on; a run's hash depends on its size, too."""
    runs = [F.xxhash64(*(F.get("w", F.col(place) + k) for k in range(n))) for n in range(1, min_match + 1)]
    return F.coalesce(*(F.when(F.col("size") == n, run) for n, run in enumerate(runs, 1)))


def seed_hits(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, min_match: int) -> DataFrame:
    """One row per document and item that share a seed: doc, row_key, item, item_words, seeds.

    Documents are cut into runs of the sizes the items have: ``min_match``, and a
    shorter one only if an item is that short.
    """
    seeds = cut_lineage(seed_table(benchmark, item_col, item_text_col, min_match))
    told = seeds.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("size")).alias("sizes")).first()
    small, sizes = told["n"] <= BROADCAST_SEEDS, told["sizes"] or [min_match]
    tokens = docs.select(
        F.col(id_col).alias("doc"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"),
        words(ascii_lower(F.col(text_col)), ALNUM).alias("w"),
    ).select("doc", "row_key", "w", F.posexplode("w").alias("pos", "word"))
    if len(sizes) == 1:
        sized, gram = tokens.withColumn("size", F.lit(sizes[0])), F.xxhash64(*(F.get("w", F.col("pos") + k) for k in range(sizes[0])))
    else:
        sized, gram = tokens.withColumn("size", F.explode(F.array(*(F.lit(n) for n in sizes)))), _gram(min_match, "pos")

    def word(k: int, held: Column) -> Column:  # no word is empty, so this stands for none
        return held if k < sizes[0] else F.when(F.col("size") > k, held).otherwise("")

    span = range(sizes[-1])
    runs = sized.where(F.col("pos") + F.col("size") <= F.size("w")).select(
        "doc", "row_key", "pos", gram.alias("gram"), *(word(k, F.get("w", F.col("pos") + k)).alias(f"w{k}") for k in span))
    probe = seeds.select(
        "item", "ipos", "size", F.col("gram").alias("seed"), *(word(k, F.get("seed_words", F.lit(k))).alias(f"s{k}") for k in span))
    same_words = runs["gram"] == probe["seed"]
    for k in span:
        same_words = same_words & (runs[f"w{k}"] == probe[f"s{k}"])
    hits = runs.join(F.broadcast(probe) if small else probe.hint("merge"), same_words)
    # a repeated row meets its own copies here, hence the set; of a short item the first place tells all
    pairs = hits.groupBy("doc", "row_key", "item").agg(
        F.collect_set(F.when(F.col("size") == min_match, F.struct("pos", "ipos"))).alias("runs"),
        F.array(F.struct(F.min("pos").alias("pos"), F.min("ipos").alias("ipos"))).alias("first"),
    ).select("doc", "row_key", "item", F.when(F.size("runs") > 0, F.col("runs")).otherwise(F.col("first")).alias("seeds"))
    items = seeds.groupBy("item").agg(F.first("item_words").alias("item_words"))
    return pairs.join(F.broadcast(items) if small else items, pairs["item"].eqNullSafe(items["item"])).drop(items["item"])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", min_match: int = 5, min_coverage: float = 0.6,
) -> DataFrame:
    """One row per document and benchmark item of which tiles cover ``min_coverage``
    or more: id, row_key, item id, n_words (the item's), n_covered, n_tiles, coverage,
    first_word and last_word (the tiles' extent in the document, words from 0).

    Words are ASCII-lower-cased runs of letters, digits and characters beyond ASCII.
    An item of fewer than ``min_match`` words is found where a document holds all its
    words in a row.  Null and empty texts and items match nothing.  Items with equal texts are reported each; repeated document rows once.  Columns
    besides those named are ignored.
    """
    pairs = seed_hits(docs, benchmark, id_col, text_col, item_col, item_text_col, min_match)
    kind = (f"doc {pairs.schema['doc'].dataType.simpleString()}, row_key bigint, item {pairs.schema['item'].dataType.simpleString()},"
            " n_words bigint, n_covered bigint, n_tiles bigint, first_word bigint, last_word bigint")

    names = ["n_words", "n_covered", "n_tiles", "first_word", "last_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, ...]] = []
            for seeds, item_words in zip(b.column(3), b.column(4)):
                code: dict[str, int] = {}
                item = [code.setdefault(w, len(code) + 1) for w in item_words.as_py()]
                least = min(min_match, len(item))
                tokens, places = _rebuilt([(s["pos"], s["ipos"]) for s in seeds.as_py()], item, least)
                tiles = greedy_tiles(tokens, item, least)
                out.append((len(item), sum(t[2] for t in tiles), len(tiles),
                            min(places[t[0]] for t in tiles), max(places[t[0] + t[2] - 1] for t in tiles)))
            counts = [pa.array([row[k] for row in out], pa.int64()) for k in range(len(names))]
            # ids pass as they came, so a null beside them changes none
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *counts], ["doc", "row_key", "item", *names])

    covered = pairs.select("doc", "row_key", "item", "seeds", "item_words").mapInArrow(run, kind)
    return covered.withColumn("coverage", F.col("n_covered") / F.col("n_words")).where(F.col("coverage") >= min_coverage).select(
        F.col("doc").alias(id_col), "row_key", F.col("item").alias(item_col), "n_words", "n_covered", "n_tiles", "coverage",
        "first_word", "last_word",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Rows without a covered benchmark item, columns unchanged."""
    found = cut_lineage(contaminated(docs, benchmark, id_col, text_col, **how).select(id_col, "row_key"))
    return keep_rows(docs, found, id_col, text_col, how="left_anti")
