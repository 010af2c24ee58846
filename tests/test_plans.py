"""Plan shapes against brute force, also when keys are hot and must be split."""

import random

import pytest
from pyspark.sql import functions as F

from pricelens.functions.text import needed_hits
from pricelens.plans import blocking, ranking
from pricelens.plans.components import connected_components

WORDS = "red blue green apple bread milk salt corn rice bean oat rye fig".split()


def texts(n, seed, k=3):
    rng = random.Random(seed)
    return sorted({" ".join(rng.choices(WORDS, k=rng.randint(1, k))) for _ in range(n)})


@pytest.fixture(params=[20_000, 2])
def split(request, monkeypatch):
    """Normal threshold, and one so low that nearly every key is salted."""
    monkeypatch.setattr(blocking, "SPLIT", request.param)
    return request.param


def test_substring_links(spark, split):
    patterns = texts(25, 1, 2) + ["a", "ed", "e b", "zz"]
    rows = texts(60, 2, 4)
    p = spark.createDataFrame([(x,) for x in patterns], "p string")
    t = spark.createDataFrame([(x,) for x in rows], "t string")
    got = {tuple(r) for r in blocking.substring_links(p, "p", t, "t").collect()}
    links = blocking.substring_links(p, "p", t, "t")
    assert links.count() == len(got)
    assert got == {(a, b) for a in patterns for b in rows if a in b}


def test_substring_links_stay_within_their_group(spark, split):
    patterns = [(f"s{i % 3}", x) for i, x in enumerate(texts(25, 1, 2) + ["a", "ed", "e b", "zz"] * 3)] + [(None, "a")]
    rows = [(f"s{i % 3}", x) for i, x in enumerate(texts(60, 2, 4))] + [(None, "a b")]
    p = spark.createDataFrame(patterns, "store string, p string")
    t = spark.createDataFrame(rows, "store string, t string")
    links = blocking.substring_links(p, "p", t, "t", within=["store"]).collect()
    got = {tuple(r) for r in links}
    assert len(links) == len(got)
    assert got == {(s, a, b) for s, a in patterns for u, b in rows if s is not None and s == u and a in b}


def test_keyword_links(spark, split):
    sets = [sorted(set(x.split())) for x in texts(30, 3, 5)]
    rows = texts(60, 4, 4) + ["redapple bluebread", "milkrice"]
    k = spark.createDataFrame([(s,) for s in sets], "k array<string>")
    t = spark.createDataFrame([(x,) for x in rows], "t string")
    hits = blocking.keyword_hits(k, "k", t, "t")
    pairs = blocking.keyword_links(k, "k", hits, needed_hits).join(hits, "hits").select("k", "t").collect()
    got = [(tuple(r.k), r.t) for r in pairs]
    want = {
        (tuple(s), x) for s in sets for x in rows if sum(w in x for w in s) >= max(2, int(len(s) * 0.6))
    }
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("threshold", [0.5, 0.75, 1.0])
def test_overlap_links(spark, split, threshold):
    sets = sorted({tuple(sorted(set(x.split()))) for x in texts(60, 5, 5)})
    df = spark.createDataFrame([(" ".join(s), list(s)) for s in sets], "id string, tokens array<string>")
    got = blocking.overlap_links(df, df, threshold, mirrored=True).collect()
    want = {
        (" ".join(a), " ".join(b)) for a in sets for b in sets
        if " ".join(a) < " ".join(b) and len({*a} & {*b}) / len({*a} | {*b}) >= threshold
    }
    assert len(got) == len(want) and {(r.l_id, r.r_id) for r in got} == want


@pytest.mark.parametrize("parts", [1, 7])
def test_components(spark, parts):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40) if i not in (9, 30)]
    star = [("hub", f"leaf{i}") for i in range(15)]
    edges = spark.createDataFrame(chain + star, "a string, b string").repartition(parts)
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    assert {roots[n] for n in roots if n.startswith("n")} == {"n000", "n010", "n031"}
    assert {roots[n] for n in roots if not n.startswith("n")} == {"hub"}
    assert roots["n010"] == roots["n030"] == "n010"


def skewed(spark, n=3000, seed=6):
    """One key with most rows, many ties and copies of whole rows."""
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 5)}", rng.choice([1.0, 1.5, 2.25, 7.0, 40.0]),
             rng.choice("abc")) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "k string, v double, s string")


def test_positions_are_a_permutation_in_order(spark, monkeypatch):
    monkeypatch.setattr(ranking, "CHUNK", 7)
    rows, df = skewed(spark)
    got = ranking.positions(df, ["k"], [("slice", F.floor("v")), ("value", F.col("v"))]).collect()
    for key in {r[0] for r in rows}:
        mine = sorted((r.pos, r.v, r.s) for r in got if r.k == key)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        assert [m[1:] for m in mine] == sorted((v, s) for k, v, s in rows if k == key)


def test_one_name_price_and_store_spreads_over_many_stretches(spark):
    """A third of the rows agree in key, price and store; no stretch holds more than its share."""
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(24_000).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("n"), F.col("id") % 500)).alias("name"),
            F.when(F.col("id") % 3 == 0, 2.5).otherwise(F.col("id") % 90 / 10).alias("price"),
            F.when(F.col("id") % 3 == 0, "s").otherwise((F.col("id") % 7).cast("string")).alias("store"), F.col("id").alias("line"),
        )
        order = ["name", "price", "store", "line"]
        sizes = [r["count"] for r in ranking.dealt_by_range(rows, order).groupBy("_range").count().collect()]
        assert sum(sizes) == 24_000 and len(sizes) >= 20 and max(sizes) <= 3 * 24_000 / 24
        got = ranking.positions(rows, ["name"], [("price", F.col("price")), ("store", F.col("store"))]).where("name = 'hot'").collect()
        assert sorted((r["line"], r["pos"]) for r in got) == [(3 * i, i + 1) for i in range(8000)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_positions_of_null_keys_and_values(spark):
    df = spark.createDataFrame([(None, 1.0, "a"), (None, None, "b"), (None, 1.0, "a"), ("k", 2.0, None)], "k string, v double, w string")
    got = sorted((r["k"] or "", r["pos"], r["w"]) for r in ranking.positions(df, ["k"], [("value", F.col("v"))]).collect())
    assert got == [("", 1, "b"), ("", 2, "a"), ("", 3, "a"), ("k", 1, None)]


def test_rank_probes_and_running_counts(spark):
    rows, df = skewed(spark)
    counted = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    probes = [(k, v) for k in {r[0] for r in rows} for v in (0.5, 1.0, 1.6, 2.25, 39.0, 99.0)]
    got = ranking.rank_probes(counted, spark.createDataFrame(probes, "k string, v double"), ["k"], "v").collect()
    assert len(got) == len(probes)
    for r in got:
        values = [v for k, v, _ in rows if k == r.k]
        assert (r.n_lt, r.n_le) == (sum(v < r.v for v in values), sum(v <= r.v for v in values))
    for r in ranking.running_counts(counted, ["k"], "v").collect():
        values = [v for k, v, _ in rows if k == r.k]
        assert (r.n_lt, r.n_le) == (sum(v < r.v for v in values), sum(v <= r.v for v in values))


def test_exact_median(spark):
    import statistics

    rows, df = skewed(spark)
    got = {r.k: r.median for r in ranking.exact_median(df, ["k"], "v").collect()}
    assert got == {k: statistics.median([v for kk, v, _ in rows if kk == k]) for k in {r[0] for r in rows}}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(200, 200), (301, 300), (300, 301), (302, 301)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300, 302: 300}
