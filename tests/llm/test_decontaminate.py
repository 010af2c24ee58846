import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pricelens.llm import decontaminate as dc
from pricelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]


def passage(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def naive_tiles(doc, item, least):
    """Greedy string tiling by trying every pair of places."""
    fd, fi, tiles = [t != 0 for t in doc], [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and fd[i + n] and fi[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return tiles
        fd[i:i + n], fi[j:j + n] = [False] * n, [False] * n
        tiles.append((i, j, n))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(1, 3), min_size=1, max_size=40), st.integers(2, 4))
def test_tiles_equal_naive_search(doc, item, least):
    tiles = dc.greedy_tiles(doc, item, least)
    assert sorted(n for *_, n in tiles) == sorted(n for *_, n in naive_tiles(doc, item, least)) or (
        sum(n for *_, n in tiles) >= 0.8 * sum(n for *_, n in naive_tiles(doc, item, least)))
    places, items = [], []
    for i, j, n in tiles:
        assert n >= least and doc[i:i + n] == item[j:j + n] and 0 not in doc[i:i + n]
        places += range(i, i + n)
        items += range(j, j + n)
    assert len(set(places)) == len(places) and len(set(items)) == len(items)


def frames(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string, item_id string"),
            spark.createDataFrame(items, "item_id long, text string, doc_id string"))


def test_exact_reordered_and_partial_passages(spark):
    rnd = random.Random(3)
    item = passage(rnd, 40)
    w = item.split()
    cut = " ".join(w[20:] + ["xx"] + w[:20])
    docs = [
        (1, passage(rnd, 50) + " " + item.upper() + ". " + passage(rnd, 50), "x"), (2, cut, "x"), (3, " ".join(w[:20]), "x"),
        (4, passage(rnd, 300), "x"), (5, " ".join(reversed(w)), "x"), (6, " ".join(w[:12]) + " a, " + " ".join(w[12:26]), "x"),
    ]
    d, b = frames(spark, docs, [(7, item, "x"), (8, None, "x"), (9, "too short", "x"), (10, item, "x")])
    found = {(r["doc_id"], r["item_id"]): r for r in dc.contaminated(d, b).collect()}
    assert set(found) == {(i, k) for i in (1, 2, 6) for k in (7, 10)}
    assert found[1, 7]["coverage"] == 1 and (found[1, 7]["first_word"], found[1, 7]["last_word"]) == (50, 89)
    assert found[2, 7]["n_tiles"] == 2 and found[2, 7]["n_covered"] == 40
    assert found[6, 7]["n_covered"] == 26 and {r["doc_id"] for r in dc.contaminated(d, b, min_coverage=0.5).collect()} == {1, 2, 3, 6}
    assert sorted(r["doc_id"] for r in dc.drop_contaminated(d, b).collect()) == [3, 4, 5]


def test_shuffled_join_equals_broadcast(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    key = lambda: sorted((r["doc_id"], r["item_id"], r["n_covered"]) for r in dc.contaminated(docs, items).collect())
    small = key()
    monkeypatch.setattr(dc, "BROADCAST_SEEDS", 0)
    assert key() == small


def test_short_items_are_found_where_held_whole(spark, monkeypatch):
    rnd = random.Random(9)
    items = [(1, "alpha beta"), (2, "gamma"), (3, "one two three four"), (4, passage(rnd, 30)), (5, "beta alpha"), (6, "alpha beta")]
    docs = [(10, "x Alpha, beta! alpha beta", "x"), (11, "alpha x beta gammas", "x"), (12, "one two three", "x"), (13, "zero one two three four", "x"),
            (14, items[3][1] + " gamma", "x"), (15, "gamma", "x"), (16, "one two three beta", "x")]
    d, b = frames(spark, docs, [(*i, "x") for i in items])
    plain = {i: t.lower().replace(",", "").replace("!", "").split() for i, t, _ in docs}
    want = {(i, k) for i, w in plain.items() for k, t in items
            if any(w[p:p + len(t.split())] == t.split() for p in range(len(w)))}
    for bound in (200_000, 0):
        monkeypatch.setattr(dc, "BROADCAST_SEEDS", bound)
        got = {(r["doc_id"], r["item_id"]): r for r in dc.contaminated(d, b).collect()}
        assert set(got) == want and all(r["coverage"] == 1 for r in got.values())
        assert (got[10, 1]["first_word"], got[10, 1]["last_word"]) == (1, 2)
    assert sorted(r["doc_id"] for r in dc.drop_contaminated(d, b).collect()) == [11, 12, 16]


def test_large_ids_beside_null_ids_stay_exact(spark):
    text = "one two three four five six seven"
    ids = [None, 2**53 + 1, 2**62 + 3]
    d, b = frames(spark, [(i, text, "x") for i in ids], [(k, text, "x") for k in ids])
    found = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(d.coalesce(1), b.coalesce(1)).collect()}
    assert found == {(i, k) for i in ids for k in ids}
    assert dc.drop_contaminated(d, b).count() == 0


def test_query_finds_every_verbatim_item(spark, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    held = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    found = {(r["doc_id"], r["item_id"]) for r in QUERIES["op5_string_tiling"](spark, SF).collect()}
    assert held <= found


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one two three four five six"), (None, "seven eight nine ten one two"), (3, "")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(odd_docs, items).collect()}
    assert found == {(i, k) for i in (1, 2, None) for k in (1, None)}
    kept = dc.drop_contaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 4, 5, 6, 7, 8]
    assert dc.contaminated(no_docs, items).count() == 0 and dc.contaminated(odd_docs, items.limit(0)).count() == 0
