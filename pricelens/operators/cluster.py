"""Near-duplicate product names and the archive clean-up built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.text import name_tokens
from pricelens.plans.blocking import overlap_links
from pricelens.plans.components import connected_components
from pricelens.session import cut_lineage


def name_clusters(names: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(name, n, cluster) for counted names ``(name, n)``.

    Names are linked by at least two shared tokens and a Jaccard similarity of
    ``threshold``; clusters are the connected groups.  Names with equal token
    sets collapse to one set before any pair is built.  A name with fewer than
    two tokens stays alone.
    """
    tokened = cut_lineage(
        names.withColumn("tokens", F.array_sort(name_tokens(F.col("name"))))
        .withColumn("key", F.when(F.size("tokens") >= 2, F.array_join("tokens", " ")))
    )
    sets = tokened.where("key is not null").select(F.col("key").alias("id"), "tokens").distinct()
    edges = overlap_links(sets, sets, threshold, min_shared=2, mirrored=True)
    roots = connected_components(edges, "l_id", "r_id").withColumnRenamed("node", "key")
    joined = tokened.join(roots, "key", "left")
    # a lone name gets a label no token set can have
    lone = F.concat(F.lit("\t"), F.col("name"))
    return joined.select("name", "n", F.coalesce("root", "key", lone).alias("cluster"))


def canonical_names(names: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(name, canonical): the most frequent name of each cluster, first by text on ties."""
    clusters = cut_lineage(name_clusters(names, threshold))
    best = clusters.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("f"), F.col("name").alias("c"))).alias("b"))
    return clusters.join(best, "cluster").select("name", F.col("b.c").alias("canonical"))


def latest_value(df: DataFrame, key: str, column: str, day: str = "obs_date") -> DataFrame:
    """(key, column): latest non-null value per key; the smallest on a shared day."""
    known = df.where(F.col(column).isNotNull() & F.col(day).isNotNull())
    age = (-F.unix_date(day)).alias("age")
    return known.groupBy(key).agg(F.min(F.struct(age, F.col(column).alias("v"))).alias("_b")).select(
        key, F.col("_b.v").alias(column)
    )


def standardize(df: DataFrame, key: str, columns: Sequence[str], day: str = "obs_date") -> DataFrame:
    """Give all rows of a key the latest known value of each column."""
    age = (-F.unix_date(day)).alias("age")

    def newest(c: str) -> Column:
        return F.min(F.when(F.col(c).isNotNull() & F.col(day).isNotNull(), F.struct(age, F.col(c).alias("v"))))

    # all columns in one pass
    known = df.groupBy(key).agg(*[newest(c).alias(f"_new_{c}") for c in columns])
    joined = df.join(known, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_new_{c}.v"), F.col(c)) for c in columns}).select(*df.columns)


def normalize_archive(archive: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Archive with one name, category and subcategory per item and merged names."""
    columns = [c for c in ("norm_name", "category", "sub_category") if c in archive.columns]
    even = cut_lineage(standardize(archive, "item", columns))
    names = even.where("norm_name is not null").groupBy(F.col("norm_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    mapping = canonical_names(names, threshold).withColumnRenamed("name", "norm_name")
    return (
        even.join(mapping, "norm_name", "left")
        .withColumn("norm_name", F.coalesce("canonical", "norm_name"))
        .select(*archive.columns)
    )
