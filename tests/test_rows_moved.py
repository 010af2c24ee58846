"""Rows a query writes and moves: only the columns it reads, and no row once more than needed."""

from glob import glob

from pyspark.sql import functions as F

from pricelens.catalog import tables as T
from pricelens.operators import market as M
from pricelens.plans import ranking
from pricelens.session import work_dir

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def landed_by(spark, monkeypatch, name):
    """Columns that a query lands when nothing is landed yet."""
    import __spark_entry__ as entry

    held = {}
    monkeypatch.setattr(T, "_landed", held)
    entry.queries()[name](spark, SF)
    return {c for tables in held.values() for columns in tables for c in columns}


def test_cross_store_rank_lands_only_what_it_ranks(spark, monkeypatch):
    assert landed_by(spark, monkeypatch, "cross_store_rank") == {
        "order_no", "line_no", "part_no", "supp_no", "store", "norm_name", "unit_price", "unit_type", "price",
    }


def test_store_report_lands_only_what_it_reads(spark, monkeypatch):
    assert landed_by(spark, monkeypatch, "store_report") == {
        "order_no", "line_no", "part_no", "supp_no", "status", "store", "item", "category", "deal_score", "price",
        "price_basis", "unit_price", "unit_type", "obs_date",
    }


def test_price_percentile_share_lands_only_what_it_reads(spark, monkeypatch):
    assert landed_by(spark, monkeypatch, "price_percentile_share") == {
        "order_no", "line_no", "part_no", "supp_no", "status", "item", "norm_name", "price", "unit_price", "unit_type",
    }


def test_feed_files_are_packed_and_read_back_whole(spark):
    import __spark_entry__ as entry

    before = set(glob(f"{work_dir(spark)}/**/feeds-*/part-*", recursive=True))
    rows = entry.queries()["feed_json_files"](spark, SF).collect()
    made = set(glob(f"{work_dir(spark)}/**/feeds-*/part-*", recursive=True)) - before
    assert made and all(f.endswith(".json.gz") for f in made)
    assert sum(r.n for r in rows) == T.observations(spark, SF, ["order_no"]).count()


def test_a_part_text_is_not_moved_to_meet_the_store(spark):
    """The last join is that with the parts, whose texts are long."""
    joins = [line for line in optimized(T.derive_observations(spark, SF)).split("\n") if "Join Inner" in line]
    assert "l_partkey" in joins[0] and "l_suppkey" in joins[1]


def test_positions_are_numbered_without_a_join_or_copied_levels(spark):
    rows = [("a", 1.0, "s"), ("a", 1.0, "s"), ("a", None, "t"), (None, 2.0, "s"), (None, 1.5, None), ("b", 3.0, "u")]
    df = spark.createDataFrame(rows, "k string, v double, store string")
    got = ranking.positions(df, ["k"], [("slice", F.floor("v")), ("value", F.col("v")), ("store", F.col("store"))])
    assert got.columns == ["k", "v", "store", "pos"]
    assert sorted(got.collect(), key=lambda r: (r.k or "", r.pos)) == [
        (None, 1.5, None, 1), (None, 2.0, "s", 2), ("a", None, "t", 1), ("a", 1.0, "s", 2), ("a", 1.0, "s", 3), ("b", 3.0, "u", 1),
    ]
    plan = optimized(got)
    assert "Join" not in plan and "_l0" in plan and "_l1" not in plan


def test_best_of_a_name_is_that_of_its_ranked_rows(spark):
    df = spark.createDataFrame(
        [("A", "X", 5.0, 2.0, "$/kg"), ("B", "X", 1.0, 2.0, "$/kg"), ("C", "X", 0.5, None, None), ("D", "X", 0.1, 1.0, None),
         ("B", "Y", None, None, None), ("A", "Y", 2.0, 9.0, "$/L"), ("C", "Y", 2.0, None, "$/L"), ("A", "Z", None, None, None),
         ("B", "Z", None, None, None), (None, "V", 1.0, None, None), ("B", "V", 1.0, None, None), ("A", None, 1.0, None, None)],
        "store string, norm_name string, price double, unit_price double, unit_type string",
    )
    got = {(r.norm_name, r.store): tuple(r[c] for c in ("cross_store_rank", "cross_store_count", "cross_store_best_price", "cross_store_best_store"))
           for r in M.cross_store_rank(df).collect()}
    none = (None, 1, None, None)
    assert got == {
        ("X", "A"): (1, 2, 2.0, "A"), ("X", "B"): (2, 2, 2.0, "A"), ("X", "C"): none, ("X", "D"): none,
        ("Y", "A"): (1, 3, 2.0, "A"), ("Y", "C"): (2, 3, 2.0, "A"), ("Y", "B"): none, ("Z", "A"): none, ("Z", "B"): none,
        ("V", None): none, ("V", "B"): none, (None, "A"): none,
    }


def test_weekly_run_from_feeds_lands_one_table(spark, monkeypatch):
    import __spark_entry__ as entry
    from pricelens.plans import weekly

    held, seen = {}, []
    monkeypatch.setattr(T, "_landed", held)
    monkeypatch.setattr(weekly, "run_from_feeds", lambda feeds, archive, day: seen.extend([feeds, archive]) or (None, archive))
    entry.queries()["weekly_run_from_feeds"](spark, SF)
    assert [len(tables) for tables in held.values()] == [1]
    assert seen[0].columns == ["id", "merchant", "name", "valid_from", "valid_to", "items", "spread_items", "products"]
    assert "status" not in seen[1].columns and "price_text" not in seen[1].columns
