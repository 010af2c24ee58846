import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from pricelens.llm.queries import QUERIES
from pricelens.llm.shards import interleave

SF = "/root/testdata/sf0.001"


def by_shard(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["shard"]].append(r)
    return out


def test_counts_slots_and_mixture(spark, texts):
    rows = QUERIES["op7_interleaved_shards"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    shards = by_shard(rows)
    sizes = [len(x) for x in shards.values()]
    assert sorted(shards) == list(range(24)) and max(sizes) - min(sizes) <= 1
    whole = Counter(r["source"] for r in rows)
    for x in shards.values():
        assert sorted(r["slot"] for r in x) == list(range(len(x)))
        held = Counter(r["source"] for r in x)
        assert all(abs(held[s] - n * len(x) / len(rows)) < 2 for s, n in whole.items())
    for r in rows:
        body = texts[r["doc_id"]].encode()
        assert r["size"] == len(body) + 8 and r["text_crc32"] == zlib.crc32(body) and r["law"] == "rows"


def chained(*values):
    """Spark's hash of several columns: each value hashed with the hash before it as the seed."""
    h = 42
    for v in values:
        body = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little")
        h = xxhash.xxh64_intdigest(body, h)
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def brute(rows, shards, seed=17):
    """doc_id -> (shard, slot), all rows ranked in one list; ids are unique and no column is null."""
    sources = defaultdict(list)
    for doc, source, text in rows:
        h = chained((seed, 4), (doc, 8))
        sources[source].append((h >> 33, signed(h), doc, len(text.encode()) + 8, zlib.crc32(text.encode())))
    line = []
    for source, members in sources.items():
        phase = signed(chained((seed + 1, 4), source, (0, 4))) % (1 << 30) / float(1 << 30)
        for i, (_, h, *row) in enumerate(sorted(members)):
            line.append(((i + phase) / len(members), source, h, *row))
    out, counts = {}, Counter()
    for k, (_, _, _, doc, *_) in enumerate(sorted(line)):
        shard = k * shards // len(line)
        out[doc] = (shard, counts[shard])
        counts[shard] += 1
    return out


def test_shards_and_slots_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(
        "doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    want = brute([tuple(r) for r in docs.collect()], 24)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in interleave(docs, 24).collect()} == want
    skewed = [(i, "hot" if i % 3 else f"s{i % 60}", "é" * (i % 7)) for i in range(2000)]
    got = interleave(spark.createDataFrame(skewed, "doc_id long, source string, text string"), 7).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == brute(skewed, 7)


def test_independent_of_partitions_and_buckets(spark):
    docs = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 300).cast("string"))).alias("source"),
        F.lit("same text").alias("text"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(interleave(docs.repartition(7), 5)) == key(interleave(docs.repartition(2), 5, buckets=16))


def test_a_hot_source_is_not_ranked_in_one_group(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.lit("t").alias("text"))
    rows = by_shard(interleave(docs, 4).collect())
    assert [len(rows[s]) for s in range(4)] == [5000] * 4


def test_odd_rows(odd_docs, no_docs):
    rows = interleave(odd_docs, 3).collect()
    assert sorted(len(x) for x in by_shard(rows).values()) == [3, 4, 4]
    assert [r["size"] for r in rows if r["doc_id"] == 3] == [8] and interleave(no_docs).count() == 0
    assert sum(r["source"] is None for r in rows) == 2
