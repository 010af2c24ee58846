"""Streams over several files give the same rows as one batch."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pricelens.session import new_path
from pricelens.streaming import jobs as ST

SCHEMA = "event_id long, ts timestamp, store string, item string, price double, obs_date date"
START = datetime(2026, 1, 1)


def batches(n=3, size=40):
    """Overlapping batches whose rows are at most a few days late."""
    out = []
    for b in range(n):
        rows = []
        for i in range(size):
            at = START + timedelta(days=2 * b, hours=2 * i)
            rows.append((b * size + i, at, "s%d" % (i % 3), "i%d" % (i % 5), float(i % 4), at.date()))
        out.append(rows)
    return out


def landed(spark, tmp_path):
    folder = str(tmp_path / "in")
    for rows in batches():
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder, spark.createDataFrame([r for b in batches() for r in b], SCHEMA)


def stream(spark, folder, batch):
    return ST.read_stream(spark, folder, batch.schema, files_per_batch=1)


def test_ingest_matches_batch_and_continues(spark, tmp_path):
    folder, batch = landed(spark, tmp_path)
    archive, checkpoint = new_path(spark, "archive"), new_path(spark, "checkpoint")
    keys = ["obs_date", "store", "item", "price"]
    got = ST.ingest(stream(spark, folder, batch), archive, [F.col("event_id")], checkpoint)
    assert got.count() == batch.select(*keys).distinct().count()
    # the same rows landing again change nothing; a new row is added
    extra = [(999, START, "s9", "i9", 1.0, START.date())]
    batch.unionByName(spark.createDataFrame(extra, SCHEMA)).coalesce(1).write.mode("append").parquet(folder)
    again = ST.ingest(stream(spark, folder, batch), archive, [F.col("event_id")], checkpoint)
    assert again.count() == batch.select(*keys).distinct().count() + 1


def test_dedup_windows_and_latest(spark, tmp_path):
    folder, batch = landed(spark, tmp_path)
    keys = ["obs_date", "store", "item"]
    kept = ST.appended_rows(ST.deduplicated(stream(spark, folder, batch), keys, "7 days").select(*keys))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, batch.select(*keys).distinct().collect()))
    weekly = ST.upserted_rows(ST.window_stats(stream(spark, folder, batch), ["store"], "7 days", "7 days"), ["store", "window_start"])
    want = batch.groupBy("store", F.window("ts", "7 days").start.alias("w")).count()
    assert sorted((r.store, r.window_start, r.n) for r in weekly.collect()) == sorted(map(tuple, want.collect()))
    last = ST.upserted_rows(ST.latest_price(stream(spark, folder, batch), ["store", "item"]), ["store", "item"])
    assert sum(r.n_seen for r in last.collect()) == batch.count()


def test_rows_beyond_the_lateness_bound_are_dropped(spark, tmp_path):
    folder, batch = landed(spark, tmp_path)
    now = START + timedelta(days=60)
    late = [(500, now, "s0", "i0", 1.0, now.date()), (501, START, "s9", "i9", 1.0, START.date())]
    for row in late:
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    keys = ["obs_date", "store", "item"]
    kept = ST.appended_rows(ST.deduplicated(stream(spark, folder, batch), keys, "7 days").select(*keys)).collect()
    assert any(r.store == "s0" and r.obs_date == now.date() for r in kept)
    assert not any(r.store == "s9" for r in kept)


def test_panes_merge_to_the_sliding_windows(spark, tmp_path):
    folder, batch = landed(spark, tmp_path)
    batch = batch.unionByName(spark.createDataFrame([(900, START + timedelta(days=40), "s0", "i0", None, START.date())], SCHEMA))
    folder = str(tmp_path / "more")
    batch.repartition(5, "event_id").write.parquet(folder)
    for length, slide in ((17, 7), (14, 7), (5, 5), (180, 7)):
        panes = ST.pane_stats(stream(spark, folder, batch), ["store"], length, slide, None)
        got = ST.merge_panes(ST.upserted_rows(panes, ["store", "slide_start", "tail"]), ["store"], length, slide)
        want = ST.window_stats(batch, ["store"], f"{length} days", None, f"{slide} days")
        key = lambda df: sorted(map(repr, df.select("store", "window_start", "n", "min_price", "max_price", "avg_price").collect()))
        assert key(got) == key(want)


def test_a_row_touches_one_pane(spark):
    batch = spark.createDataFrame([r for b in batches() for r in b], SCHEMA)
    panes = ST.pane_stats(batch, ["store"], 180, 7, None)
    assert panes.agg(F.sum("n")).first()[0] == batch.count()
    assert "Expand" not in panes._jdf.queryExecution().executedPlan().toString()
    assert "Expand" in ST.window_stats(batch, ["store"], "180 days", None, "7 days")._jdf.queryExecution().executedPlan().toString()


def prices(spark, path, frame, **how):
    rows = ST.latest_prices(spark, path, ["store", "item"], frame, **how).collect()
    return {(r.store, r.item): (r.last_price, r.last_seen, r.n_seen) for r in rows}


def test_price_table_follows_batches_and_restarts(spark, tmp_path):
    folder, batch = landed(spark, tmp_path)
    keys, path = ["store", "item"], new_path(spark, "state")
    want = lambda df: {(r.store, r.item): (r.last_price, r.last_seen, r.n_seen) for r in ST.latest_price(df, keys).collect()}
    ST.keep_latest_prices(stream(spark, folder, batch), path, keys, "90 days", buckets=4)
    assert prices(spark, path, batch) == want(batch) == prices(spark, path, batch, live_only=True)
    more = [(700, START + timedelta(days=9), "s0", "i0", 7.5, START.date()), (701, START, None, "i9", None, START.date())]
    extra = spark.createDataFrame(more, SCHEMA)
    extra.coalesce(1).write.mode("append").parquet(folder)
    ST.keep_latest_prices(stream(spark, folder, batch), path, keys, "90 days", buckets=4)
    assert prices(spark, path, batch) == want(batch.unionByName(extra))


def test_price_table_rewrites_touched_buckets_only_and_lets_old_keys_go(spark, tmp_path):
    import glob

    folder, batch = landed(spark, tmp_path)
    keys, path = ["store", "item"], new_path(spark, "state")
    ST.keep_latest_prices(stream(spark, folder, batch), path, keys, "30 days", buckets=4)
    late = spark.createDataFrame([(800, START + timedelta(days=100), "s0", "i0", 2.0, START.date())], SCHEMA)
    late.coalesce(1).write.mode("append").parquet(folder)
    ST.keep_latest_prices(stream(spark, folder, batch), path, keys, "30 days", buckets=4)
    last = max(int(f.rsplit("=", 1)[1]) for f in glob.glob(f"{path}/live/v=*"))
    rewritten = {f.rsplit("=", 1)[1] for f in glob.glob(f"{path}/live/v={last}/old=*/bucket=*")}
    assert len(rewritten) == 1
    everything = ST.latest_price(batch.unionByName(late), keys)
    whole = {(r.store, r.item): (r.last_price, r.last_seen, r.n_seen) for r in everything.collect()}
    assert prices(spark, path, batch) == whole
    live = prices(spark, path, batch, live_only=True)
    assert live.keys() < whole.keys() and ("s0", "i0") in live
    # a key that comes back counts on from what had moved out
    back = next(iter(whole.keys() - live.keys()))
    again = spark.createDataFrame([(801, START + timedelta(days=101), *back, 3.0, START.date())], SCHEMA)
    again.coalesce(1).write.mode("append").parquet(folder)
    ST.keep_latest_prices(stream(spark, folder, batch), path, keys, "30 days", buckets=4)
    assert prices(spark, path, batch)[back] == (3.0, START + timedelta(days=101), whole[back][2] + 1)
    assert prices(spark, path, batch, live_only=True)[back] == (3.0, START + timedelta(days=101), 1)


def test_price_table_repeats_a_failed_batch(spark, tmp_path):
    import glob
    import os

    folder, batch = landed(spark, tmp_path)
    keys, path = ["store", "item"], new_path(spark, "state")
    ST.keep_latest_prices(stream(spark, folder, batch), path, keys, "90 days", buckets=4)
    once = prices(spark, path, batch)
    # the last batch's commit is gone, as after a failure just before it
    commits = [f for f in glob.glob(f"{path}/checkpoint/commits/*") if os.path.basename(f).isdigit()]
    newest = max(commits, key=lambda f: int(os.path.basename(f)))
    os.remove(newest)
    os.remove(os.path.join(os.path.dirname(newest), f".{os.path.basename(newest)}.crc"))
    ST.keep_latest_prices(stream(spark, folder, batch), path, keys, "90 days", buckets=4)
    assert prices(spark, path, batch) == once
