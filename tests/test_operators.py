"""Operator rules on small tables, and properties that must always hold."""

from datetime import date

from pyspark.sql import functions as F

from pricelens.operators import cluster as C
from pricelens.operators import dedupe as U
from pricelens.operators import history as H
from pricelens.operators import market as M
from pricelens.operators import matching as X
from pricelens.operators import summary as S
from pricelens.plans import ranking as K
from pricelens.plans import weekly as W
from pricelens.sources import tables as TB

ROW = "store string, item string, norm_name string, price double, unit_price double, unit_type string, obs_date date"
DAY = date(2026, 1, 1)


def rows(spark, data):
    return spark.createDataFrame([(*d, DAY) if len(d) == 6 else d for d in data], ROW)


def test_tiers_and_gates(spark):
    history = rows(spark, [
        ("A", "milk jug", "Milk", 3.0, None, None), ("A", "milk jug", "Milk", 4.0, None, None),
        ("A", "milk jug", "Milk", 5.0, None, None),
        ("A", "big rye bread loaf", "Rye", 2.0, None, None), ("B", "rye bread", "Rye", 4.0, None, None),
        ("A", "prefix tofu", "Tofu", 1.0, None, None), ("A", "tofu", "Tofu", 3.0, None, None),
    ])
    current = rows(spark, [
        ("A", "milk jug", "Milk", 4.0, None, None),   # exact name, three rows
        ("A", "rye bread", "Bread", 3.0, None, None),  # keywords rye and bread, two rows
        ("A", "tofu", None, 1.0, None, None),          # one keyword never matches: substring
        ("A", "caviar", None, 9.0, None, None),        # nothing
    ])
    tiers = {r["item"]: (r.tier, r.matched_rows) for r in H.tier_matches(current, history).collect()}
    assert tiers == {"milk jug": (1, 3), "rye bread": (2, 2), "tofu": (3, 2)}
    stats = {r["item"]: r for r in H.historical_stats(current, history).collect()}
    assert stats["milk jug"].historical_avg == 4.0 and stats["milk jug"].price_percentile == 33.3  # 100 - (1 + 2 + 1) * 50 / 3
    assert stats["tofu"].is_lowest and stats["caviar"].historical_count == 0 and stats["caviar"].pct_below_avg is None


def test_percentile_and_like_for_like(spark):
    history = rows(spark, [("A", "x", "X", float(i), float(i) * 10, "$/kg") for i in (1, 2, 3, 4)] + [("A", "x", "X", 50.0, 5.0, "$/L")])
    current = rows(spark, [("A", "x", "X", 9.0, 20.0, "$/kg"), ("B", "x", "X", 2.0, 5.0, "$/L"), ("C", "x", "X", 2.0, None, None)])
    got = {r.store: r for r in H.historical_stats(current, history).collect()}
    assert (got["A"].historical_count, got["A"].price_percentile) == (4, 50.0)  # unit prices 10..40
    assert got["B"].historical_count == 5  # only one $/L row: shelf prices
    assert got["C"].historical_max == 50.0


def test_cross_store_rank_rules(spark):
    df = rows(spark, [
        ("A", "x1", "X", 5.0, 2.0, "$/kg"), ("B", "x2", "X", 1.0, 3.0, "$/kg"), ("C", "x3", "X", 0.5, None, None),
        ("A", "y", "Y", 1.0, None, None), ("A", "y2", "Y", 2.0, None, None), ("A", "z", None, 1.0, None, None),
    ])
    got = {r["item"]: (r.cross_store_rank, r.cross_store_count, r.cross_store_best_store) for r in M.cross_store_rank(df).collect()}
    assert got == {"x1": (1, 2, "A"), "x2": (2, 2, "A"), "x3": (None, 1, None), "y": (None, 1, None),
                   "y2": (None, 1, None), "z": (None, 1, None)}


def test_dedupe_keeps_last_text_and_is_idempotent(spark):
    df = spark.createDataFrame(
        [(DAY, "A", "Bananas", 4.0, 1), (DAY, "A", "BANANAS  ", 4.0, 2), (DAY, "A", "Bananas", 4.5, 3)],
        "obs_date date, store string, item string, price double, n int",
    )
    once = U.dedupe(df, U.archive_keys(), [F.col("n")], keep="last")
    assert sorted(r["item"] for r in once.collect()) == ["BANANAS  ", "Bananas"]
    twice = U.dedupe(once, U.archive_keys(), [F.col("n")], keep="last")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_archive_append_twice_is_once(spark):
    schema = "store string, item string, price double, valid_from date, valid_until date"
    new = spark.createDataFrame([("A", "milk", 1.0, None, None), ("A", "rye", 2.0, None, None)], schema)
    empty = new.withColumn("obs_date", F.lit(DAY)).limit(0)
    once = U.append_to_archive(empty, new, F.lit(DAY), [])
    twice = U.append_to_archive(once, new, F.lit(DAY), [])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.select(once.columns).collect()))
    assert {r.valid_until for r in once.collect()} == {date(2026, 1, 8)}


def test_clusters(spark):
    names = [("Ground Beef (Regular)", 1), ("Regular Ground Beef", 5), ("Ground Beef", 9), ("Milk", 2), ("milk", 3)]
    for parts in (1, 5):
        df = spark.createDataFrame(names, "name string, n long").repartition(parts)
        got = {r.name: r.canonical for r in C.canonical_names(df, 0.75).collect()}
        assert got == {"Ground Beef (Regular)": "Regular Ground Beef", "Regular Ground Beef": "Regular Ground Beef",
                       "Ground Beef": "Ground Beef", "Milk": "Milk", "milk": "milk"}


def test_best_match_bonus_and_page_edges(spark):
    offers = spark.createDataFrame([("A", "corn flakes", 5.0), ("B", "corn flakes", 5.0)], "store string, item string, price double")
    document = spark.createDataFrame(
        [("A", "Corn Flakes big", 9.0, 1), ("A", "corn flakes", 5.05, 2)], "store string, name string, doc_price double, pos long"
    )
    got = {r.store: (r.doc_name, r.confidence, r.validation_status) for r in X.best_document_match(offers, document).collect()}
    assert got == {"A": ("corn flakes", 1.0, "verified"), "B": (None, None, "not_in_pdf")}
    pages = spark.createDataFrame([(1, 10, 0, 0.0, 100.0, 0.0, 100.0), (1, 11, 1, 100.0, 900.0, 0.0, 100.0)],
                                  "feed int, page int, page_pos int, left double, right double, bottom double, top double")
    items = spark.createDataFrame([(1, 1, 90.0, 110.0, 40.0, 60.0), (1, 2, 700.0, 720.0, 0.0, 0.0), (1, 3, -50.0, -40.0, 0.0, 0.0)],
                                  "feed int, item_id int, left double, right double, bottom double, top double")
    placed = {r.item_id: r.page for r in X.place_on_pages(items, pages).collect()}
    assert placed == {1: 10, 2: 11, 3: None}


def test_sale_frequency(spark):
    days = [date(2026, 1, 1), date(2026, 1, 20), date(2026, 2, 10), date(2026, 3, 2)]
    df = spark.createDataFrame([("x", d) for d in days] + [("y", days[0])], "item string, obs_date date")
    assert [tuple(r) for r in S.sale_frequency(df, "item").collect()] == [("x", 4, 2.0)]


def test_week_scores_stay_in_range(spark):
    offers = rows(spark, [("A", "milk 2 l", "Milk", 1.0, 0.5, "$/L"), ("B", "milk 2 l", "Milk", 9.0, 4.5, "$/L"),
                          ("B", "milk 2 l", "Milk", 9.0, 4.5, "$/L"), ("A", "gin", "Gin", 9.0, None, None)])
    offers = offers.withColumn("price_basis", F.lit("each"))
    archive = offers.unionByName(offers).unionByName(offers)
    week = W.score_week(offers, archive, [F.col("obs_date")]).collect()
    assert len(week) == 2 and all(0 <= r.deal_score <= 100 for r in week)
    assert all(0 <= r.price_percentile <= 100 for r in week)


def test_publish_refuses_and_keeps_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(5)
    assert TB.publish(df, path) == 1 and TB.publish(spark.range(3), path, expected_rows=3) == 2
    for bad in (lambda: TB.publish(spark.range(0), path), lambda: TB.publish(df, path, expected_rows=6)):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError("a bad table was published")
    assert TB.versions(spark, path) == [1, 2] and TB.read_published(spark, path).count() == 3


def test_missing_table_is_empty_and_fallback_used(spark, tmp_path):
    from pricelens.schema import OBSERVATION

    gone = str(tmp_path / "gone")
    assert TB.read_observations(spark, gone, OBSERVATION).count() == 0
    spark.createDataFrame([(DAY,)], "obs_date date").write.parquet(str(tmp_path / "second"))
    assert TB.first_available(spark, [gone, str(tmp_path / "second")], OBSERVATION).count() == 1


def test_line_and_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "second"), (1, "first")], "n int, text string")
    TB.write_lines(df, str(tmp_path / "lines"), ["n"])
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["first", "second"]
    TB.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_backfill_and_merge_do_not_fan_out(spark):
    from pricelens.operators import enrich as E

    rows_ = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "item string, n int")
    out = E.backfill(rows_, ["item"], lambda d: d.withColumn("size", F.coalesce(F.length("item"), F.lit(0))))
    assert sorted((r.n, r.size) for r in out.collect()) == [(1, 1), (2, 1), (3, 0)]
    results = spark.createDataFrame([("a", 7), ("a", 7)], "item string, score int")
    merged = E.merge_results(rows_, results, "item", {"score": 50}, [F.col("score")])
    assert sorted((r.n, r.score) for r in merged.collect()) == [(1, 7), (2, 7), (3, 50)]


def test_weekly_run_keeps_old_archive_rows_and_columns(spark):
    kind = ROW + ", price_basis string, order_no long"
    old = [("A", "milk jug", "Milk", 3.0, None, None, date(2020, 1, 1), "each", 1), ("A", "milk jug", "Milk", 9.0, None, None, date(2025, 12, 1), "each", 2)]
    offers = spark.createDataFrame([("A", "milk jug", "Milk", 4.0, None, None, DAY, "each", 3)], kind)
    archive = spark.createDataFrame(old, kind)
    current, after = W.run_week(offers, archive, [F.col("order_no")], DAY, 180)
    assert after.columns == archive.columns and {r.order_no for r in after.collect()} == {1, 2, 3}
    assert current.first().historical_count < 3


def test_results_of_repeated_keys_do_not_depend_on_partitions(spark):
    from pricelens.operators import enrich as E

    rows_ = spark.createDataFrame([(f"k{i}",) for i in range(50)], "item string")
    results = spark.createDataFrame([(f"k{i}", float(j)) for i in range(50) for j in range(20)], "item string, score double")
    for n in (1, 7, 13):
        merged = E.merge_results(rows_, results.repartition(n), "item", {"score": 0.0}, [F.col("score")])
        assert {r.score for r in merged.collect()} == {19.0}


def test_regex_search_ignores_case_but_not_classes(spark):
    from pricelens.operators import filters as P

    df = spark.createDataFrame([("abc 12",), ("12 ABC",)], "item string")
    found = lambda t: [r.item for r in P.search(df, t, ["item"], "regex").collect()]
    assert found(r"^\D+ ") == ["abc 12"] and found("^ABC") == ["abc 12"]


def test_keep_last_refuses_an_order_of_its_own(spark):
    import pytest

    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    assert U.dedupe(df, ["k"], [F.col("v")], keep="last").first().v == 2
    with pytest.raises(ValueError):
        U.dedupe(df, ["k"], [F.col("v").desc()], keep="last")


def test_pages_are_whole_and_continue(spark):
    import pytest

    from pricelens.operators import deals as D

    df = spark.range(600).select(F.col("id").alias("order_no"), F.when(F.col("id") % 7 > 0, F.col("id") % 5).alias("deal_score"))
    by = [("deal_score", False), ("order_no", True)]
    whole = [r.order_no for r in D.page(df, [F.col("deal_score").desc_nulls_last(), F.col("order_no")], 0, 600).collect()]
    assert len(whole) == 600
    got, last = [], None
    while rows_ := D.page_after(df, by, last, 170).collect():
        got += [r.order_no for r in rows_]
        last = rows_[-1].asDict()
    assert got == whole
    with pytest.raises(ValueError):
        D.page(df, [F.col("order_no")], 0, 201, most=200)


def test_appends_and_lookbacks_read_their_months_only(spark, tmp_path):
    from pricelens.operators.filters import within_days

    path = str(tmp_path / "archive")
    kind = "obs_date date, store string, item string, price double, order_no long"
    rows_ = [(date(2025, m, 3), "A", f"i{k}", 1.0, k) for m in range(1, 13) for k in range(5)]
    TB.append_archive_table(spark, path, spark.createDataFrame(rows_, kind), [F.col("order_no")])
    plan = TB.held_months(spark, path, ["2025-03", "2025-04"])._jdf.queryExecution().executedPlan().toString()
    assert "obs_month#" in plan.split("PartitionFilters")[1] and "2025-03" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    late = within_days(TB.held_months(spark, path, [f"2025-{m:02}" for m in range(1, 13)]), date(2025, 12, 31), 40)
    assert late.count() == 5 and ">= 2025-11" in late._jdf.queryExecution().executedPlan().toString()
    before = {r.obs_month: r.n for r in spark.read.parquet(path).groupBy("obs_month").agg(F.count("*").alias("n")).collect()}
    TB.append_archive_table(spark, path, spark.createDataFrame(rows_[:5] + [(date(2025, 1, 4), "B", "x", 2.0, 9)], kind), [F.col("order_no")])
    assert spark.read.parquet(path).count() == 61 and len(before) == 12


def test_detail_history_and_last_sale_follow_the_match(spark):
    from datetime import date

    from pricelens.operators import history as H

    kind = "item string, norm_name string, store string, price double, unit_price double, unit_type string, obs_date date"
    day = lambda n: date(2026, 1, n)
    past = [
        ("Ripe Tomato Vine", "tomato", "a", 2.0, None, None, day(3)), ("Ripe Tomato Vine", "tomato", "a", 2.0, None, None, day(3)),
        ("Tomato Vine Red", "tomato", "b", 1.5, None, None, day(9)), ("Cherry Tomato Vine Box", "cherry", "c", 3.0, None, None, day(5)),
        ("Other", None, "c", 9.0, None, None, day(1)),
    ]
    now = [("Tomato Vine", "tomato", "a", 2.5, None, None, day(20)), ("Cherry Tomato Box", "none", "a", 2.5, None, None, day(20)),
           ("Missing Thing", None, "a", 1.0, None, None, day(20))]
    current, history = spark.createDataFrame(now, kind), spark.createDataFrame(past, kind)
    rows = [tuple(r) for r in H.matched_history(current, history).orderBy("item", "pos").collect()]
    # three rows of the exact name; the other name is found by its words only
    assert [(r[0], r[2], r[3].day, r[4], r[5], r[6], r[7]) for r in rows] == [
        ("Cherry Tomato Box", "keywords", 5, "c", 3.0, 1, 1),
        ("Tomato Vine", "exact", 3, "a", 2.0, 2, 1), ("Tomato Vine", "exact", 9, "b", 1.5, 1, 2),
    ]
    last = {r["item"]: (r["last_date"], r["last_price"], r["last_store"], r["days_ago"]) for r in H.last_matched_sale(current, history, day(9)).collect()}
    assert last["Tomato Vine"] == (day(3), 2.0, "a", 6) and "Missing Thing" not in last


def test_list_metrics_without_expanding_rows(spark):
    from pricelens.operators import summary as S

    df = spark.createDataFrame([("x", "a", 2.0, 80), ("x", "b", 4.0, 10), (None, "a", None, None)], "item string, store string, price double, ai_score int")
    assert tuple(S.list_metrics(df).first()) == (3, 3.0, 1, 45.0, 1, 2)
    assert tuple(S.list_metrics(df.limit(0)).first()) == (0, None, 0, None, 0, 0)
    assert "Expand" not in S.list_metrics(df)._jdf.queryExecution().executedPlan().toString()


def test_item_store_stats_equal_brute_force(spark):
    import random
    from datetime import timedelta
    from statistics import median

    rnd = random.Random(8)
    data = [(rnd.choice(["A", "B", None]), rnd.choice(["Milk", "milk", "Rye"]), "x", float(rnd.choice([0, 1, 1, 2, 5])), None, None,
             DAY + timedelta(days=7 * rnd.randint(0, 6))) for _ in range(150)] + [("C", "tofu", "x", 2.0, None, None, DAY)]
    history = rows(spark, data)
    groups = {}
    for store, item, _, price, _, _, day in data:
        for key in {(item.lower(), store), (item.lower(), None)}:
            groups.setdefault(key, []).append((day, price))
    got = {(r.item_key, r.store): r for r in H.item_store_stats(history).collect()}
    assert set(got) == set(groups)
    for key, seen in groups.items():
        r, paid = got[key], [p for _, p in seen if p > 0]
        late, early = ([p for _, p in sorted(seen, key=by)[:3]] for by in (lambda x: (-x[0].toordinal(), x[1]), lambda x: x))
        a, b = sum(late) / len(late), sum(early) / len(early)
        trend = "UNKNOWN" if len(seen) < 2 else "DECREASING" if a < b * 0.95 else "INCREASING" if a > b * 1.05 else "STABLE"
        assert (r.min_price, r.max_price, r.median_price, r.frequency) == (min(paid), max(paid), median(paid), len(seen))
        assert abs(r.avg_price - sum(paid) / len(paid)) < 1e-9 and r.weeks_tracked == len({d.isocalendar()[1] for d, _ in seen})
        assert (r.price_trend, r.last_price, r.last_date) == (trend, late[0], max(d for d, _ in seen))


def test_the_item_level_adds_up_counts_instead_of_rows(spark):
    history = rows(spark, [("A", "milk", "x", 1.0, None, None), (None, "milk", "x", 1.0, None, None)] * 500)
    cube = H.sighting_cube(history).collect()
    assert sorted((r.store or "", r.n) for r in cube) == [("", 1000), ("A", 500)]


def test_fuzzy_match_pairs_word_sets_and_agrees_with_all_pairs(spark):
    words = lambda n: {w for w in n.split() if len(w) > 3}
    names = [f"{a}corn {b}{s}" for a in ("", "Sale ", "fine ") for b in ("flakes", "chips") for s in ("", " 25 g", " 50 g", " 1000 g")]
    offers = [("A", n.strip(), 1.0 + (i * 7) % 5) for i, n in enumerate(names)] + [("A", "corn", 2.0), ("A", "rye", 2.0)]
    entries = [("A", n, 1.0 + (i * 3) % 11 * 0.45, i % 9) for i, n in enumerate(names) if i % 5]

    def best(item, price):
        found = []
        for _, name, at, pos in entries:
            l, r = item.lower(), name.lower()
            share = len(words(l) & words(r)) / len(words(l) | words(r)) if words(l) and words(r) else 0.0
            score = 0.8 if l in r or r in l else share * 0.6 if share >= 0.5 else None
            if score is not None:
                score += 0.2 if abs(price - at) / price < 0.1 else 0.0
                if score > 0.5:
                    found.append((-score, pos, name, at))
        return min(found)[2:] if found else (None, None)

    left = spark.createDataFrame(offers, "store string, item string, price double")
    right = spark.createDataFrame(entries, "store string, name string, doc_price double, pos long")
    got = {(r.item, r.price): (r.doc_name, r.doc_price) for r in X.best_document_match(left, right).collect()}
    assert got == {(i, p): best(i, p) for _, i, p in offers}
    # names that differ in their sizes only are one word set: one link, not 40 x 40
    many = spark.range(40).select(F.lit("A").alias("store"), F.concat(F.lit("corn flakes "), F.col("id").cast("string")).alias("l"))
    sets = many.select("store", X._word_set(F.col("l")).alias("ls"), X._word_set(F.col("l")).alias("rs"))
    assert X._worded(sets, sets, 0.5, ["store"]).count() == 1


def test_match_keys_with_equal_texts_share_their_values(spark):
    sizes = [100, 200, 300]
    history = rows(spark, [("A", f"corn flakes crisp {s}", "x", float(s), None, None) for s in sizes for _ in (1, 2)])
    current = rows(spark, [("A", f"corn flakes crisp box{i}", None, 200.0, None, None) for i in range(12)])
    counted = H.counted_history(history)
    tiers, links, sets = H.assign_tiers(current, counted)
    # 12 keyword sets find the same texts: one key, linked and valued once
    assert tiers.count() == 12 and tiers.select("kid").distinct().count() == 1
    assert links.count() == links.distinct().count() == sets.select("mid").distinct().count()
    assert sorted(map(tuple, H.key_values(links, sets, counted).select("basis", "value", "n").collect())) == [
        ("shelf", float(s), 2) for s in sizes]
    stats = H.historical_stats(current, history).select("historical_count", "price_percentile").distinct().collect()
    assert [tuple(r) for r in stats] == [(6, 41.7)]  # 100 - (2 + 4 + 1) * 50 / 6


def test_ranks_pair_no_probe_with_values(spark):
    counted = spark.createDataFrame([("k", i / 100, 1 + i % 3) for i in range(250)] + [(None, 1.0, 5)], "k string, v double, n long")
    probes = spark.createDataFrame([("k", i / 200) for i in range(520)] + [(None, 1.0), ("k", None), ("none", 1.0)], "k string, v double")
    ranked = K.rank_probes(counted, probes, ["k"], "v")
    got = {(r.k, r.v): (r.n_lt, r.n_le) for r in ranked.collect()}
    want = {("k", i / 200): (sum(1 + j % 3 for j in range(250) if j / 100 < i / 200), sum(1 + j % 3 for j in range(250) if j / 100 <= i / 200))
            for i in range(520)}
    assert got == want | {("none", 1.0): (0, 0)}
    # values and probes meet in one union: the only join brings the totals of the slices
    assert ranked._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_pages_of_a_cell_end_at_the_first_that_covers_it(spark):
    pages = [(1, 1000 + i, i, float(i % 3), 100.0 + i % 3, float(i % 5), 100.0 + i % 5) for i in range(300)]
    pages += [(1, 7, 500, 150.0, 260.0, 0.0, 90.0), (1, 8, 501, 150.0, 260.0, 0.0, 90.0), (1, 9, 502, 200.0, 200.0, 50.0, 50.0)]
    spots = [(1, 100 * x + y, x * 2.0, x * 2.0, y * 3.0, y * 3.0) for x in range(-2, 135) for y in range(-1, 40)]
    p = spark.createDataFrame(pages, "feed int, page int, page_pos int, left double, right double, bottom double, top double")
    i = spark.createDataFrame(spots, "feed int, id int, left double, right double, bottom double, top double")
    got = {r.id: r.page for r in X.place_on_pages(i, p).collect()}

    def first(x, y):
        return next((page for _, page, _, l, r, b, t in pages if l <= x <= r and b <= y <= t), None)

    assert got == {n: first(x, y) for _, n, x, _, y, _ in spots}
    listed = X.page_lists(p, X.cell_sizes(p))
    # 303 pages, 15 different ones on top of each other: lists stop at the first that covers the cell
    assert listed.agg(F.max(F.size("_pages"))).first()[0] <= 16
