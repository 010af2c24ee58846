"""Plans and hot groups: what must hold at any size."""

import re

import pytest
from pyspark.sql import functions as F

from pricelens.llm import chunk_dedup, decontaminate, license_scan, near_dup, packing, queries, quality_rules, shards

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op1_license_scan", "op2_quality_rules", "op7_interleaved_shards"])
def test_native_queries_run_no_python(spark, name):
    assert not re.search(r"Python|Arrow|Pandas|CartesianProduct|NestedLoop|ExistingRDD", plan(queries.QUERIES[name](spark, SF)))


@pytest.mark.parametrize("name", ["op4_packing", "op5_string_tiling", "op6_chunk_dedup", "op10_simhash_ring"])
def test_no_cross_joins(spark, name):
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan(queries.QUERIES[name](spark, SF)))


def test_only_needed_columns_are_read(spark):
    for name in ("op3_token_count", "op6_chunk_dedup", "op8_personal_data"):
        read = set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan(queries.QUERIES[name](spark, SF))))
        assert read == {"struct<doc_id:bigint,text:string>"}


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows are one text, a third differ from it in their last word, one source."""
    base = " ".join(f"w{i}" for i in range(60))
    return spark.range(1500).select(
        F.col("id").alias("doc_id"), F.lit("hot").alias("source"),
        F.when(F.col("id") % 3 == 0, F.lit(base + " mit license."))
        .when(F.col("id") % 3 == 1, F.concat(F.lit(base + " x"), F.col("id").cast("string")))
        .otherwise(F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.hex(F.xxhash64(F.col("id"), i))))).alias("text"),
    ).repartition(6)


def test_hot_groups_give_whole_results(spark, hot):
    assert license_scan.scan_licenses(hot).where("n_base = 1 and first_word = 60").count() == 500
    assert shards.interleave(hot, 5).groupBy("shard").count().where("count = 300").count() == 5
    found = near_dup.near_duplicates(hot).groupBy("component_id").count().collect()
    assert max(r["count"] for r in found) >= 500 and sum(r["count"] for r in found) == 1500
    shared = chunk_dedup.repeated_passages(hot)
    assert {r["doc_id"] for r in shared.select("doc_id").distinct().collect()} == {i for i in range(1500) if i % 3 < 2}
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(10, 40)))], "item_id long, text string")
    assert decontaminate.contaminated(hot, items).count() == 1000
    assert quality_rules.assess(hot).where("q_n_words >= 60").count() == 1500


def test_copies_are_compared_once(spark, hot):
    nodes = near_dup.fingerprints(hot).select("fp").distinct()
    n, edges = nodes.count(), near_dup.link_forest(nodes).count()
    assert n < 1500 and edges < 68 * n


def test_packing_does_not_depend_on_partitions(spark):
    pieces = spark.range(4000).select(
        F.col("id").alias("row_key"), F.lit(0).cast("long").alias("start"), (F.pmod(F.xxhash64("id"), F.lit(900)) + 1).alias("length"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(packing.pack(pieces.repartition(3))) == key(packing.pack(pieces.repartition(8)))
