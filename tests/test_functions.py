"""Literal cases of the parse, rule, date and score functions."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from pricelens.functions import dates, price as PR, rules as R, score as SC
from pricelens.functions.text import alike, alike_by_words, keywords, name_tokens, needed_hits

PRICES = [
    ("$3.99/lb", 3.99, "per_lb"), ("$8.80/kg", 8.80, "per_kg"), ("$1.50/100g", 1.50, "per_100g"),
    ("2 for $5", 2.50, "multi_buy"), ("3/$10", 3.33, "multi_buy"), ("$5.99", 5.99, "each"),
    ("$3.99/100ml", 1.01, "multi_buy"), ("1,299.00", 1.0, "each"), ("99¢", 99.0, "each"),
    ("0 for $5", 0.0, "each"), ("", None, None), ("see store", None, None), (None, None, None),
]


def test_price_parse(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PRICES)], "i int, raw_price string")
    got = {r.i: (r.price, r.price_basis) for r in PR.parse_prices(df).collect()}
    assert got == {i: (p[1], p[2]) for i, p in enumerate(PRICES)}


UNITS = [
    (3.99, "per_lb", "pork", 8.80, "$/kg", None), (5.99, "each", "cola 12 x 355 ml", 1.41, "$/L", 4260.0),
    (4.99, "each", "bacon 500 g", 9.98, "$/kg", 500.0), (6.0, "each", "milk 2 l", 3.0, "$/L", 2000.0),
    (6.0, "each", "beef 2 lb", 6.61, "$/kg", 907.184), (3.6, "each", "eggs 12's", 0.30, "$/each", 12.0),
    (2.0, "each", "gum 1 pack", None, None, None), (0.0, "each", "bacon 500 g", None, None, None),
    (4.0, "each", "soup 0 x 5 g 2 kg", 2.0, "$/kg", 2000.0),
]


def test_unit_price(spark):
    rows = [(i, u[2], u[0], "", u[1]) for i, u in enumerate(UNITS)]
    df = spark.createDataFrame(rows, "i int, item string, price double, price_text string, price_basis string")
    for r in PR.add_unit_prices(df).collect():
        _, _, _, value, kind, qty = UNITS[r.i]
        assert (r.unit_price, r.unit_type) == (value, kind)
        assert r.qty_equiv == (pytest.approx(qty) if qty is not None else None)


def test_legacy_price(spark):
    df = spark.createDataFrame([("$5.99/lb",), ("2 for $5",), ("$3/100g",), ("free",)], "raw_price string")
    got = [(r.price, r.per_kg_text) for r in PR.parse_prices_legacy(df).collect()]
    assert got == [(5.99, "$13.21/kg"), (2.5, None), (3.0, "$30.00/kg"), (None, None)]


def test_counter_price(spark):
    rows = [
        ("Sobeys", "Atlantic Salmon Fillet", 2.39, "each", True),
        ("Sobeys", "Frozen Atlantic Salmon Fillet", 2.39, "each", False),
        ("Sobeys", "Atlantic Salmon Fillet 400 g", 2.39, "each", False),
        ("Sobeys", "Atlantic Salmon Fillet 5g sodium", 2.39, "each", True),
        ("No Frills", "Atlantic Salmon Fillet", 2.39, "each", False),
        ("Sobeys", "Atlantic Salmon Fillet", 12.0, "each", False),
        ("Sobeys", "Halibut", 12.0, None, True),
        ("Sobeys", "Chicken Wings", 4.0, "per_lb", False),
    ]
    df = spark.createDataFrame(rows, "store string, item string, price double, basis string, want boolean")
    test = R.is_counter_price(*[F.col(c) for c in ("store", "item", "price", "basis")])
    assert all(r.got == r.want for r in df.select("want", test.alias("got")).collect())


def test_drinks_and_food(spark):
    df = spark.createDataFrame(
        [("gin 750 ml", True), ("ginger beer", False), ("non-alcoholic gin", False), ("Red Wine 1 l", True), ("Red Wine vinegar", False),
         ("cooking wine red wine", False), ("égin tonic", False)],
        "item string, want boolean",
    )
    assert all(r.got == r.want for r in df.select("want", R.is_excluded_drink(F.col("item")).alias("got")).collect())
    foods = [
        ("Dove Body Wash", None, False, "ambiguous_brand:dove->nonfood"), ("Dove Candy", None, True, "ambiguous_brand:dove->food"),
        ("Tide pods", None, False, "brand:tide->cleaning"), ("Similac powder", None, True, "brand:similac->baby_food"),
        ("Kids shampoo", None, False, "keyword:shampoo"), ("Apples", None, True, "default:food"),
        ("Formula", "Baby", True, "baby_food"), ("Collar", "Pet", False, "category:Pet"), ("gains", None, True, "default:food"),
    ]
    df = spark.createDataFrame(foods, "item string, category string, food boolean, why string")
    got = df.select("food", "why", R.food_verdict(F.col("item"), F.col("category")).alias("v")).collect()
    assert all((r.v.is_food, r.v.reason) == (r.food, r.why) for r in got)


def test_keyword_category(spark):
    cases = [("Turkey Sausage", "Poultry"), ("Chorizo", "Pork"), ("banana bread", "Produce"), ("Bananas", "Other"),
             ("cheddar cheese", "Dairy & Eggs"), ("paper towel", "Household & Personal")]
    df = spark.createDataFrame(cases, "item string, want string")
    assert all(r.got == r.want for r in df.select("want", R.keyword_category(F.col("item")).alias("got")).collect())


def test_deal_score(spark):
    cases = [(20.0, True, 1, 3, 1.0, True, 94.0), (-60.0, False, 4, 4, None, False, 5.0), (None, False, None, 1, None, False, 40.0),
             (80.0, True, 1, 2, 1.0, True, 100.0)]
    df = spark.createDataFrame(cases, "p double, l boolean, r int, c int, u double, k boolean, want double")
    got = df.select("want", SC.deal_score(*[F.col(c) for c in "plrcuk"]).alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_context_score_without_statistics(spark):
    none = F.lit(None).cast("double")
    row = spark.range(1).select(SC.context_score(F.lit(3.0), none, none, none, none, none).alias("s")).first()
    assert row.s == 40


def test_text_helpers(spark):
    row = spark.range(1).select(
        F.array_sort(keywords(F.lit("Fresh Ground beef  and Ground beef"))).alias("k"),
        F.array_sort(name_tokens(F.lit("Ground Beef (Regular), pack"))).alias("n"),
        needed_hits(F.array(*[F.lit(c) for c in "abcde"])).alias("five"),
        needed_hits(F.array(F.lit("a"))).alias("one"),
        alike(F.lit("corn flakes"), F.lit("corn flakes large")).alias("a"),
        alike_by_words(F.lit("corn flakes"), F.lit("corn flakes large box extra")).alias("b"),
    ).first()
    assert row.k == ["beef", "ground"] and row.n == ["beef", "ground", "regular"]
    assert (row.five, row.one, row.a, row.b) == (3, 2, True, False)


def test_dates(spark):
    texts = ["2026-01-05", "2026-01-05T10:00:00", "2026-01-05 10:00:00", "01/05/2026", "2026/01/05", "Jan 5, 2026"]
    df = spark.createDataFrame([(t,) for t in [*texts, "soon", "", None]], "t string")
    got = [r[0] for r in df.select(dates.lenient_date(F.col("t"))).collect()]
    assert got == [date(2026, 1, 5)] * len(texts) + [None] * 3
    day = F.lit(date(2026, 1, 1))
    row = spark.range(1).select(
        dates.valid_until(F.lit(None).cast("date"), dates.valid_from(F.lit(None).cast("date"), day)).alias("until"),
        dates.repaired_end(F.lit(None).cast("date"), day, 3).alias("v2"),
        dates.repaired_end(F.lit(date(2025, 12, 1)), day).alias("early"),
    ).first()
    assert (row.until, row.v2, row.early) == (date(2026, 1, 8), date(2026, 1, 4), date(2026, 1, 8))
