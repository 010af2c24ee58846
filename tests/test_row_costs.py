"""Work a row costs: no expression is evaluated more often than it has to be."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from pricelens.catalog import tables as T
from pricelens.functions.price import PER_100G, first_filled, number_in
from pricelens.operators.dedupe import archive_keys, dedupe
from pricelens.plans import blocking
from pricelens.schema import FEED
from pricelens.session import configure
from pricelens.sources import feeds


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_landed_observations_equal_the_spelled_out_view(spark, tmp_path):
    day = datetime.datetime(1999, 3, 1, 12, 30)
    keys = [
        (1, 1, 1, 1, "A", "F"), (1, 2, 2, 2, "N", "O"), (2, 3, 1, 3, "R", "F"), (2, 4, 3, 4, "A", "O"), (3, 5, 2, 5, "R", "F"),
        (3, 5, 2, 5, "R", "F"), (4, None, 2, 1, "A", "F"), (5, 99, 2, 1, "A", "F"), (6, 6, 1, None, None, None), (7, 7, 4, 3, "N", "O"),
    ]
    lines = [(o, p, s, n, 7.0, 0.05, 0.03, flag, status, day + datetime.timedelta(days=o)) for o, p, s, n, flag, status in keys]
    parts = [
        (k, name, f"Brand#{k}", kind, k, 9.5) for k, name, kind in [
            (1, "red widget", "PROMO"), (2, "old rod", "SMALL"), (3, "cold bolt", "LARGE"), (4, "new anvil", "MEDIUM"),
            (5, "hot gear", "SMALL"), (5, "blue ring", "LARGE"), (6, None, "SMALL"), (7, "plain", None),
        ]
    ]
    made = {
        "lineitem": (lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
                     " l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "part": (parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "supplier": ([(1, 1), (2, 2), (2, 7), (3, None), (4, 5)], "s_suppkey bigint, s_nationkey int"),
        "nation": ([(1, "a"), (2, "b"), (5, "c"), (7, "d")], "n_nationkey int, n_name string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        spark.read.parquet(f"{tmp_path}/{name}.parquet").createOrReplaceTempView(name)
    got = T.derive_observations(spark, str(tmp_path))
    want = spark.sql("SELECT " + ", ".join(f"{e} AS {n}" for n, e in T.OBS.items()) + " " + T.FROM_SQL)
    assert got.dtypes == want.dtypes
    assert got.count() == want.count() > 8
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    # the cents most price columns start from are computed once a line
    assert len(re.findall(r"l_discount#\d+L? \* ", optimized(got))) == 1


def test_only_the_named_columns_are_landed(spark, tmp_path):
    made = {
        "lineitem": ([(1, 1, 1, 1, 7.0, 0.05, 0.03, "A", "F", datetime.datetime(1999, 3, 1))],
                     "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
                     " l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "part": ([(1, "red widget", "Brand#1", "PROMO", 1, 9.5)],
                 "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "supplier": ([(1, 1)], "s_suppkey bigint, s_nationkey int"),
        "nation": ([(1, "a")], "n_nationkey int, n_name string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    here = str(tmp_path)

    def landed(df):
        return spark.read.parquet(df.inputFiles()[0]).columns

    narrow = T.observations(spark, here, ["item", "part_no"])
    assert narrow.columns == landed(narrow) == ["part_no", "item"]
    assert landed(T.observations(spark, here, ["item"])) == ["part_no", "item"]  # held already
    assert T.observations(spark, here).columns == list(T.OBS)
    wide = T.current_and_history(spark, here, ["price"])[1]
    assert wide.columns == ["price", "status"] and landed(wide) == list(T.OBS) and wide.count() == 1
    with pytest.raises(ValueError):
        T.observations(spark, here, ["item", "no_such"])


def test_tasks_read_less_at_once_unless_the_caller_says_how_much(spark):
    other = spark.newSession()
    key = "spark.sql.files.maxPartitionBytes"
    assert configure(other).conf.get(key) == "32m"
    other.conf.set(key, "7m")
    assert configure(other).conf.get(key) == "7m"


def test_methods_too_long_for_the_jit_are_not_generated(spark):
    assert configure(spark).conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_a_filter_on_the_parsed_price_does_not_parse_again(spark):
    none = None
    item = lambda name, price: (name, price, none, none, none, none, none, none)
    docs = [
        (1, "A", "w", "2024-01-01", "2024-01-08", [item(" Milk ", "$3.99/lb"), item("Eggs", "2 for $5"), item("Air", "free")], [], none),
        (2, "B", "w", "2024-01-02", none, none, none, [item("Salt", "$1.50/100g"), item(" ", "$1"), item("Zero", "$0.00"), item("Rye", none)]),
        (none, none, none, none, none, [item("Oat", "$2")], none, none),
    ]
    rows = feeds.offers(spark.createDataFrame(docs, FEED))
    got = {(r.feed_id, r.item): (r.price, r.price_text, r.price_basis) for r in rows.collect()}
    assert got == {
        (1, "Milk"): (3.99, "$3.99/lb", "per_lb"), (1, "Eggs"): (2.5, "2 for $5", "multi_buy"),
        (2, "Salt"): (1.5, "$1.50/100g", "per_100g"), (None, "Oat"): (2.0, "$2", "each"),
    }
    assert optimized(rows.select("store", "price")).count(PER_100G) == 1


def test_dedupe_sorts_no_copies_of_its_keys(spark):
    rows = spark.createDataFrame(
        [("s", "Tea ", 1.0, "2024-01-01", 1), ("s", "TEA", 1.0, "2024-01-01", 2), (None, None, None, None, 3), (None, None, None, None, 4)],
        "store string, item string, price double, obs_date string, n int",
    )
    plain = dedupe(rows, ["store", "item", "price"], [F.col("n")])
    assert plain.columns == rows.columns
    assert sorted(r.n for r in plain.collect()) == [1, 2, 3]
    last = dedupe(rows, archive_keys(), [F.col("n")], keep="last")
    assert last.columns == rows.columns
    assert sorted(r.n for r in last.collect()) == [2, 4]
    spec = re.search(r"windowspecdefinition\(([^)]*?) ASC", optimized(plain)).group(1)
    assert [re.sub(r"#.*", "", c) for c in spec.split(", ")][:3] == ["store", "item", "price"]


@pytest.mark.parametrize("split", [20_000, 2])
@pytest.mark.parametrize("threshold, min_shared", [(0.75, 2), (0.75, 1), (0.5, 1), (0.6, 3), (0.8, 1), (1.0, 1)])
def test_overlap_links_pair_only_places_that_can_suffice(spark, monkeypatch, split, threshold, min_shared):
    monkeypatch.setattr(blocking, "SPLIT", split)
    rng = random.Random(7)
    words = "a b c d e f g h i".split()
    sets = [sorted(rng.sample(words, rng.randint(1, 7))) for _ in range(70)]
    left = [(f"l{i:02}", t) for i, t in enumerate(sets[:40])] + [("none", [])]
    right = [(f"r{i:02}", t) for i, t in enumerate(sets[20:])] + [("r20copy", sets[40])]
    schema = "id string, tokens array<string>"
    got = blocking.overlap_links(
        spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), threshold, min_shared=min_shared
    ).collect()
    share = lambda a, b: len(set(a) & set(b))
    want = {
        (x, y) for x, a in left for y, b in right
        if share(a, b) >= min_shared and share(a, b) / (len(a) + len(b) - share(a, b)) >= threshold
    }
    assert len(got) == len(want) and {(r.l_id, r.r_id) for r in got} == want


def test_overlap_links_join_on_sizes_and_places(spark):
    sets = spark.createDataFrame([("x", ["a", "b", "c", "d"]), ("y", ["a", "b", "c", "e"])], "id string, tokens array<string>")
    plan = optimized(blocking.overlap_links(sets, sets, 0.75, mirrored=True))
    assert re.search(r"Join Inner, .*r_n#\d+ = r_n#\d+.*r_at#\d+ = r_at#\d+", plan)


def test_texts_without_a_number_are_not_cast(spark):
    texts = ["", "free", "$3.99/lb", "2 for $5", "-.5 off", "12", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select(number_in(F.col("t"), r"([-+]?(?:\d*\.\d+|\d+))").alias("n"))
    assert [r.n for r in found.collect()] == [None, None, 3.99, 2.0, -0.5, 12.0, None]
    assert "regexp_extract(" not in optimized(spark.range(1).select(number_in(F.col("id").cast("string"), "(x)")))


def test_only_texts_that_can_be_a_zero_are_cast(spark):
    zeros = ["0", " 0.0 ", "-0", "+.0", "0e3", "0d", "0F", "\t0.00\n", "0x0p0", "", None]
    filled = ["$0.00", "0/lb", "NaN", "Infinity", "free", "1", "0 kg", "zero", "-", "0¢", "2 for $5"]
    df = spark.createDataFrame([(t,) for t in zeros + filled], "t string")
    got = [r.c for r in df.select(first_filled(F.col("t")).alias("c")).collect()]
    assert got == [None] * len(zeros) + filled
    assert "RLIKE" in optimized(df.select(first_filled(F.col("t")))).upper()
