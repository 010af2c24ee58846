import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricelens.operators import matching as X
from pricelens.plans.spelling import best_spelling, edit_links

COLOURS = "almond antique aquamarine azure beige bisque black blanched blue blush brown burlywood chartreuse".split()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute(left, right, threshold):
    out = set()
    for a in {x for x in left if x}:
        for b in {x for x in right if x}:
            most = int((1 - threshold) * max(len(a), len(b)) + 1e-9)
            if abs(len(a) - len(b)) <= most and (d := distance(a, b)) <= most:
                out.add((a, b, d))
    return out


def links(spark, left, right, threshold, q=3):
    l = spark.createDataFrame([(x,) for x in left], "a string")
    r = spark.createDataFrame([(x,) for x in right], "b string")
    return {(x["a"], x["b"], x["edits"]) for x in edit_links(l, "a", r, "b", threshold, q).collect()}


def typo(rnd, text):
    i = rnd.randrange(len(text))
    return rnd.choice([text[:i] + text[i + 1:], text[:i] + rnd.choice("aeiou z") + text[i:], text[:i] + rnd.choice("xyz") + text[i + 1:]])


def names(rnd, n):
    return [" ".join(rnd.sample(COLOURS, 3)) for _ in range(n)]


@pytest.mark.parametrize("threshold, q", [(0.7, 3), (0.8, 3), (0.6, 2), (1.0, 3)])
def test_short_texts_over_few_letters_equal_brute_force(spark, threshold, q):
    rnd = random.Random(int(threshold * 10))
    texts = lambda: ["".join(rnd.choice("aabé") for _ in range(rnd.randrange(12))) for _ in range(200)] + [None, "", "a", "aa"]
    left, right = texts(), texts()
    assert links(spark, left, right, threshold, q) == brute(left, right, threshold)


def test_two_thousand_names_with_typos_are_found(spark):
    rnd = random.Random(7)
    known = sorted(set(names(rnd, 2000)))
    wanted = {}
    for name in rnd.sample(known, 400):
        wanted[typo(rnd, typo(rnd, name))] = name
    found = links(spark, wanted, known, 0.85)
    for w, name in wanted.items():
        if distance(w, name) <= int(0.15 * max(len(w), len(name)) + 1e-9):
            assert (w, name, distance(w, name)) in found
    sample = rnd.sample(sorted(wanted), 25)
    assert {f for f in found if f[0] in sample} == brute(sample, known, 0.85)


def test_a_gram_many_texts_share_is_split(spark, monkeypatch):
    from pricelens.plans import blocking

    monkeypatch.setattr(blocking, "SPLIT", 7)
    rnd = random.Random(3)
    left, right = names(rnd, 40), names(rnd, 60)
    assert links(spark, left, right, 0.7) == brute(left, right, 0.7)


def test_plan_has_no_cross_join(spark):
    l = spark.createDataFrame([("ab",)], "a string")
    plan = edit_links(l, "a", l.withColumnRenamed("a", "b"), "b", 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_threshold_must_leave_a_gram(spark):
    l = spark.createDataFrame([("ab",)], "a string")
    with pytest.raises(ValueError):
        edit_links(l, "a", l, "a", 0.6, q=3)


def test_misspelt_words_count_as_the_nearest_known(spark):
    known = spark.createDataFrame([("Blue almond tart",), ("black bisque",), ("blue almond",), (None,)], "name string")
    wanted = spark.createDataFrame(
        [("bleu almnd tart",), ("blakc bisque",), ("zzzz",), (None,), ("",), ("blue almond",), ("bleu almnd tart",)], "name string")
    found = {r["name"]: (r["known_name"], r["score"]) for r in X.lookup_names(wanted, known, spelling=0.7).collect()}
    assert found["blue almond"][1] == 100.0 and "zzzz" not in found and "" not in found
    assert found["blakc bisque"][0] == "black bisque"
    # almnd is one edit from almond; bleu is two from blue, too many for four letters
    assert found["bleu almnd tart"][0] in ("Blue almond tart", "blue almond")
    alone = spark.createDataFrame([("almnd",)], "name string")
    assert X.lookup_names(alone, known).count() == 0
    assert X.lookup_names(alone, known, spelling=0.75).first()["known_name"] == "Blue almond tart"


def test_prices_of_the_known_name(spark):
    history = spark.createDataFrame([("blue almond", 2.0), ("blue almond", 4.0), (None, 1.0), ("other", 9.0)], "norm_name string, price double")
    known = history.select(F.col("norm_name").alias("name")).where("name is not null")
    wanted = spark.createDataFrame([("blue almnd",), ("nothing",)], "name string")
    rows = X.seen_prices(X.lookup_names(wanted, known, spelling=0.75), history).collect()
    assert [(r["name"], r["known_name"], r["times_seen"], r["cheapest"], r["avg_price"]) for r in rows] == [("blue almnd", "blue almond", 2, 2.0, 3.0)]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text("abc d", max_size=9), min_size=1, max_size=12), st.lists(st.text("abc d", max_size=9), min_size=1, max_size=12))
def test_any_texts_equal_brute_force(spark, left, right):
    assert links(spark, left, right, 0.75) == brute(left, right, 0.75)


def test_best_spelling_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("a", "y", 1, 0.8), ("a", "x", 1, 0.8), ("a", "b", 2, 0.7)], "t string, k string, edits int, similarity double")
    assert tuple(best_spelling(df, "t", "k").first()) == ("a", "x", 1, 0.8)
