"""Reading and publishing result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pricelens.operators.dedupe import archive_keys, both_counts, concat_tables, dedupe
from pricelens.session import cut_lineage

_VERSION = "version="


def read_observations(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """Table with an explicit schema; a path that does not exist is an empty table."""
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    try:
        return reader.load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def first_available(spark: SparkSession, paths: Sequence[str], schema: StructType, fmt: str = "parquet") -> DataFrame:
    """The first path that exists, else an empty table."""
    found = next((p for p in paths if _exists(spark, p)), paths[-1])
    return read_observations(spark, found, schema, fmt)


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Completely written versions of a published table, oldest first."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    found = [int(n[len(_VERSION):]) for n in names if n.startswith(_VERSION) and n[len(_VERSION):].isdigit()]
    done = [v for v in found if _exists(spark, f"{path}/{_VERSION}{v}/_SUCCESS")]
    return sorted(done)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """Latest complete version; readers never see a half-written one."""
    return spark.read.parquet(f"{path}/{_VERSION}{versions(spark, path)[-1]}")


def publish(df: DataFrame, path: str, expected_rows: int | None = None) -> int:
    """Write a new version of a table and return its number.

    An empty table does not replace one with rows, and a stated row count must
    be met; the earlier version stays as the backup.  The written files are
    counted, so what readers get is what was checked.
    """
    spark = df.sparkSession
    old = versions(spark, path)
    number = old[-1] + 1 if old else 1
    target = f"{path}/{_VERSION}{number}"
    # written once, without the mark that makes a version visible; the count comes from the files' footers
    df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(target)
    rows = spark.read.schema(df.schema).parquet(target).count()
    if rows == 0 and old and not read_published(spark, path).isEmpty():
        raise ValueError(f"refusing to replace {path} by an empty table")
    if expected_rows is not None and rows != expected_rows:
        raise ValueError(f"{path}: {rows} rows instead of {expected_rows}")
    fs, done = _fs(spark, f"{target}/_SUCCESS")
    fs.create(done, True).close()
    return number


def same_row_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: both counts and whether an in-place correction kept them equal."""
    counts = both_counts(before, after, ("rows_before", "rows_after"))
    return counts.withColumn("unchanged", F.col("rows_before") == F.col("rows_after"))


def held_months(spark: SparkSession, path: str, months: Sequence[str]) -> DataFrame:
    """The named months of an archive table.  Months are literals in the filter, so
    other partitions are not listed for the scan."""
    held = spark.read.schema(_month_schema(spark, path)).parquet(path)
    return held.where(F.col("obs_month").isin(list(months)))


def _month_schema(spark: SparkSession, path: str) -> StructType:
    """The table's schema with months as text, whatever their form suggests."""
    found = spark.read.parquet(path).schema
    return StructType([StructField(f.name, StringType() if f.name == "obs_month" else f.dataType) for f in found])


def append_archive_table(
    spark: SparkSession, path: str, batch: DataFrame, arrival: Sequence[Column], day: str = "obs_date",
    file_rows: int = 2_000_000,
) -> None:
    """Take a batch into a month-partitioned archive table.

    The dedup key holds the day, so only the months of the batch are read and
    rewritten.  The merged months are staged first and then replace their
    partitions; taking in the same batch again changes nothing.  Partitions are
    dealt by size (``file_rows`` rows a file at most, adaptive execution splits and joins them).
    """
    month = F.date_format(day, "yyyy-MM").alias("obs_month")
    fresh = cut_lineage(batch.select("*", month))
    merged = fresh.withColumn("_arrival", F.lit(1))
    if _exists(spark, path):
        # calendar months of four-digit years: at most 120,000 short texts, few in practice
        months = [r[0] for r in fresh.select("obs_month").distinct().collect()]
        merged = concat_tables(held_months(spark, path, months).withColumn("_arrival", F.lit(0)), merged)
    kept = cut_lineage(dedupe(merged, archive_keys(), [F.col("_arrival"), *arrival], keep="last").drop("_arrival"))
    (
        kept.hint("rebalance", "obs_month")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", file_rows)
        .partitionBy("obs_month").parquet(path)
    )


def extract(df: DataFrame, flag: str, columns: Sequence[str], path: str) -> None:
    """Write the flagged rows as a table of their own."""
    df.where(F.col(flag)).select(*columns).write.mode("overwrite").parquet(path)


def price_reports(df: DataFrame) -> DataFrame:
    """Three-column projection for a relational price table."""
    return df.where(F.col("price").isNotNull()).select(
        F.col("item").alias("product_name"), "price", F.col("obs_date").alias("recorded_at")
    )


def write_jdbc(df: DataFrame, url: str, name: str, properties: dict[str, str]) -> None:
    """Append price reports to a database table the caller names."""
    price_reports(df).write.jdbc(url, name, mode="append", properties=properties)


def write_lines(df: DataFrame, path: str, order: Sequence[str], text: str = "text") -> None:
    """Report lines as text files, in order across the files."""
    df.orderBy(*order).select(text).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
