"""Continuous versions of the archive and statistics jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pricelens.functions.numbers import MONEY_STEPS, as_steps, exact_avg, half_up
from pricelens.operators.dedupe import dedupe
from pricelens.session import discard, new_path, staged
from pricelens.sources.tables import append_archive_table

def read_stream(
    spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    """Parquet files of a folder as a stream, at most ``files_per_batch`` a micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_available(stream: DataFrame, mode: str, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what has arrived and stop; a rerun continues from the checkpoint."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(handle).start()
    )
    query.awaitTermination()
    return query


def _numbered(out: str) -> Callable[[DataFrame, int], None]:
    """Write each batch to its own folder, so a repeated batch replaces itself."""

    def handle(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return handle


def ingest(
    stream: DataFrame, archive: str, arrival: Sequence[Column], checkpoint: str | None = None
) -> DataFrame:
    """Append arriving observations to the archive table; repeats are harmless."""
    spark = stream.sparkSession

    def handle(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            append_archive_table(df.sparkSession, archive, df, arrival)

    run_available(stream, "append", handle, checkpoint or new_path(spark, "checkpoint"))
    return spark.read.parquet(archive)


def _marked(stream: DataFrame, time: str, lateness: str | None) -> DataFrame:
    return stream if lateness is None else stream.withWatermark(time, lateness)


def deduplicated(stream: DataFrame, keys: Sequence[str], lateness: str | None, time: str = "ts") -> DataFrame:
    """First arrival per key.  With ``lateness`` None rows of any age are taken and
    every key is remembered.  Else rows later than that are dropped and counted by
    ``late_rows``, and state older than it goes; the key should hold the day."""
    if lateness is None:
        return stream.dropDuplicates(list(keys))
    return _marked(stream, time, lateness).dropDuplicatesWithinWatermark(list(keys))


def late_rows(query: StreamingQuery) -> int:
    """Rows that a finished or running query dropped as too late."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


def window_stats(
    stream: DataFrame, keys: Sequence[str], length: str, lateness: str | None, slide: str | None = None, time: str = "ts"
) -> DataFrame:
    """Price statistics per key and time window; ``lateness`` as in ``deduplicated``."""
    span = F.window(time, length, slide) if slide else F.window(time, length)
    return (
        _marked(stream, time, lateness)
        .groupBy(*keys, span.alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("price").alias("min_price"), F.max("price").alias("max_price"),
            half_up(exact_avg(F.col("price")), 2).alias("avg_price"),
        )
        .select(*keys, F.col("w.start").alias("window_start"), "n", "min_price", "max_price", "avg_price")
    )


def pane_stats(
    stream: DataFrame, keys: Sequence[str], length_days: int, slide_days: int, lateness: str | None, time: str = "ts"
) -> DataFrame:
    """Mergeable partial statistics for windows of ``length_days`` every ``slide_days``.

    A slide is cut where windows end in it, so every window is a whole number of
    panes and a row belongs to exactly one: (keys, slide_start, tail), the tail being
    the part behind the cut.  ``lateness`` as in ``deduplicated``.
    """
    marked = _marked(stream, time, lateness).withColumn("_w", F.window(time, f"{slide_days} days"))
    cut = F.col("_w.start") + F.make_interval(days=F.lit(length_days % slide_days))
    return (
        marked.groupBy(*keys, "_w", (F.col(time) >= cut).alias("tail"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("price").alias("low"), F.max("price").alias("high"),
            F.sum(as_steps(F.col("price"))).alias("steps"), F.count("price").alias("priced"),
        )
        .select(*keys, F.col("_w.start").alias("slide_start"), "tail", "n", "low", "high", "steps", "priced")
    )


def merge_panes(panes: DataFrame, keys: Sequence[str], length_days: int, slide_days: int) -> DataFrame:
    """The sliding windows' statistics, as ``window_stats`` gives them, from finished panes.

    Panes are spread over the windows that hold them, rows never are: what is
    spread has at most two entries per key and slide, whatever the number of rows.
    """
    whole = length_days // slide_days
    # with a remainder, the part before the cut also closes the window that starts one slide earlier
    reach = F.when(F.lit(length_days % slide_days > 0) & ~F.col("tail"), whole).otherwise(whole - 1)
    spread = panes.withColumn("_back", F.explode(F.sequence(F.lit(0), reach)))
    start = F.col("slide_start") - F.make_interval(days=F.col("_back") * slide_days)
    return spread.groupBy(*keys, start.alias("window_start")).agg(
        F.sum("n").alias("n"), F.min("low").alias("min_price"), F.max("high").alias("max_price"),
        half_up(F.sum("steps") / F.nullif(F.sum("priced"), F.lit(0)) / F.lit(float(MONEY_STEPS)), 2).alias("avg_price"),
    )


def latest_price(stream: DataFrame, keys: Sequence[str], time: str = "ts") -> DataFrame:
    """Last price, its time and the number of sightings per key."""
    last = F.max(F.struct(F.col(time), F.col("price"))).alias("s")
    return stream.groupBy(*keys).agg(last, F.count(F.lit(1)).alias("n_seen")).select(
        *keys, F.col("s.price").alias("last_price"), F.col(f"s.{time}").alias("last_seen"), "n_seen"
    )


def _price_kind(stream: DataFrame, keys: Sequence[str], time: str) -> StructType:
    """Columns of the price state: the keys, (time, price) of the last sighting,
    sightings, and the folders' names."""
    last = F.struct(F.col(time).alias("at"), F.col("price")).alias("last")
    folders = [F.lit(0).alias("v"), F.lit(False).alias("old"), F.lit(0).alias("bucket")]
    return stream.select(*keys, last, F.lit(0).cast("long").alias("n_seen"), *folders).schema


def _merged_prices(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(F.max("last").alias("last"), F.sum("n_seen").alias("n_seen"))


def _version_map(spark: SparkSession, path: str, batch: int) -> dict[int, int]:
    """Bucket -> the batch that wrote it last, as of ``batch``: at most one entry a bucket."""
    if batch < 0:
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{path}/log/v={batch}").where("version >= 0").collect()}


def keep_latest_prices(
    stream: DataFrame, path: str, keys: Sequence[str], max_age: str, time: str = "ts", buckets: int = 64,
) -> StreamingQuery:
    """Last price per key in a table under ``path`` that micro-batches merge into.

    State lies in ``buckets`` groups of files by the keys' hash.  A batch is reduced to
    one row per key first; it reads and rewrites only the buckets its keys fall into.
    Keys not seen for ``max_age`` (an interval such as ``90 days``) before the newest
    row so far move out of the live state when their bucket is next rewritten; they
    stay readable and are never lost, see ``latest_prices``.

    Each batch writes new folders and then its version map, so a batch repeated after
    a failure starts from the map before it and replaces what it wrote.  What the last
    two maps do not name is deleted.  The stream's checkpoint lies under ``path``, too:
    a rerun continues.  Rows with a null time or price count as sightings; null keys
    are a key.
    """
    kind = _price_kind(stream, keys, time)

    def handle(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        before = _version_map(spark, path, batch - 1)
        for b, v in _version_map(spark, path, batch - 2).items():
            if before.get(b) != v:
                discard(spark, f"{path}/live/v={v}/old=false/bucket={b}")
        discard(spark, f"{path}/log/v={batch - 3}")
        reduced = df.groupBy(*keys).agg(
            F.max(F.struct(F.col(time).alias("at"), F.col("price"))).alias("last"), F.count(F.lit(1)).alias("n_seen"),
        ).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        fresh, folder = staged(reduced)
        newest = fresh.agg(F.unix_micros(F.max(F.col("last.at").cast("timestamp")))).first()[0]
        if batch:
            seen = [newest, spark.read.parquet(f"{path}/log/v={batch - 1}").agg(F.max("newest")).first()[0]]
            newest = max((x for x in seen if x is not None), default=None)
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
        known = [f"{path}/live/v={before[b]}/old=false/bucket={b}" for b in touched if b in before]
        parts = fresh
        if known:
            live = spark.read.schema(kind).option("basePath", f"{path}/live").parquet(*known)
            parts = parts.unionByName(live.select(parts.columns))
        merged = _merged_prices(parts, [*keys, "bucket"])
        bound = F.timestamp_micros(F.lit(newest).cast("long")) - F.expr(f"interval {max_age}")
        aged = merged.withColumn("old", F.coalesce(F.col("last.at") < bound, F.lit(False)))
        aged.write.mode("overwrite").partitionBy("old", "bucket").parquet(f"{path}/live/v={batch}")
        filled = set()
        if touched:
            written = spark.read.schema(kind).option("basePath", f"{path}/live").parquet(f"{path}/live/v={batch}")
            filled = {r["bucket"] for r in written.where("not old").select("bucket").distinct().collect()}
        after = {b: v for b, v in before.items() if b not in touched} | {b: batch for b in filled}
        # a row without a bucket carries the newest time even when no bucket is left
        entries = spark.createDataFrame([(k, v, newest) for k, v in [*after.items(), (-1, -1)]], "bucket int, version int, newest long")
        entries.coalesce(1).write.mode("overwrite").parquet(f"{path}/log/v={batch}")
        discard(spark, folder)

    return run_available(stream, "append", handle, f"{path}/checkpoint")


def latest_prices(spark: SparkSession, path: str, keys: Sequence[str], stream: DataFrame, live_only: bool = False, time: str = "ts") -> DataFrame:
    """Keys, last_price, last_seen and n_seen from the table ``keep_latest_prices``
    maintains; ``live_only`` leaves out what has moved out for its age."""
    last = spark.read.parquet(f"{path}/log").agg(F.max("v")).first()[0]
    table = spark.read.schema(_price_kind(stream, keys, time)).parquet(f"{path}/live")
    versions = spark.read.parquet(f"{path}/log/v={last}").select("bucket", F.col("version").alias("v"))
    live = table.where("not old").join(F.broadcast(versions), ["bucket", "v"])  # one row a bucket
    rows = live if live_only else live.unionByName(table.where("old").select(live.columns))
    return _merged_prices(rows, keys).select(
        *keys, F.col("last.price").alias("last_price"), F.col("last.at").alias("last_seen"), "n_seen")


def against_history(stream: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Arriving observations joined with static statistics of their item."""
    joined = stream.join(stats, key, "left")
    pct = (F.col("avg_price") - F.col("price")) / F.nullif(F.col("avg_price"), F.lit(0.0)) * 100
    return joined.withColumns(
        {
            "pct_below_avg": half_up(pct, 1),
            "is_lowest": F.coalesce(F.col("price") <= F.col("min_price"), F.lit(False)),
        }
    )


def appended_rows(stream: DataFrame) -> DataFrame:
    """Run an append-mode stream to its end and read what it wrote."""
    spark = stream.sparkSession
    out = new_path(spark, "stream")
    run_available(stream, "append", _numbered(out), new_path(spark, "checkpoint"))
    return spark.read.schema(stream.schema).parquet(f"{out}/batch=*")


def upserted_rows(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Run an update-mode stream to its end; the last update of each key counts."""
    spark = stream.sparkSession
    out = new_path(spark, "stream")
    run_available(stream, "update", _numbered(out), new_path(spark, "checkpoint"))
    updates = spark.read.parquet(out)
    return dedupe(updates, keys, [F.col("batch")], keep="last").drop("batch")
