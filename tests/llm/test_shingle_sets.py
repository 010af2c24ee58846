import random

import corpus_pipeline
from pricelens.llm import shingle_sets as ss


def shingle_set(text, width=5):
    w = text.split()
    return {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, least=0.8):
    """Smallest id of each row's component, over all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j > i and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_copies(rnd, n=12, changes=6):
    """Groups of texts with single words changed, around a similarity of 0.8, and a line they all hold."""
    rows, line = [], " the same line stands in every single one of these texts "
    for g in range(n):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([12, 90, 150]))]
        for k in range(8):
            w = list(base)
            for _ in range(rnd.randrange(changes)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
            rows.append((100 * g + k, " ".join(w) + line))
    return [*rows, (9001, ""), (9002, " \n"), (9003, "a b"), (9004, "a b"), (9005, "a b c")]


def test_components_equal_brute_force(spark):
    for seed in (1, 2):
        rows = near_copies(random.Random(seed))
        found = {r["doc_id"]: r["component_id"] for r in ss.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        want = brute(rows)
        assert found == want and 20 < len(set(want.values())) < len(rows) - 20


def test_the_stage_drops_what_is_similar_but_beyond_three_bits(spark):
    from pricelens.llm.near_dup import simhash

    rows = [(i, t) for i, t in near_copies(random.Random(3)) if t.strip()]
    root = brute(rows)
    text = dict(rows)
    assert any((simhash(text[i].encode()) ^ simhash(text[r].encode())).bit_count() > 3 for i, r in root.items())
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r["doc_id"] for r in kept.collect()} == set(root.values())


def test_ring_is_the_proportional_budget(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(5)
    values = [sum(1 << b for b in rnd.sample(range(64), rnd.randrange(24))) for _ in range(2000)]

    def brute_ring(x, bits):
        d = [bin(x >> 16 * k & 0xFFFF).count("1") for k in range(4)]
        return any(all(sum(d[(i + j) % 4] for j in range(n)) <= bits * n // 4 for n in range(1, 5)) for i in range(4))

    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in values], "x long")
    for bits in (3, 11, 16):
        assert [r[0] for r in df.select(ss.ring(F.col("x"), bits)).collect()] == [brute_ring(x, bits) for x in values]
        # all that the whole budget admits, the ring admits
        assert all(brute_ring(x, bits) == (x.bit_count() <= bits) for x in values)


def test_recall_of_similar_pairs(spark):
    """Of all pairs at 0.8 or more in the table, at least nine in ten end in one component."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    low = [(i, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for i, t in rows]
    sets = {i: shingle_set(t) for i, t in low}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(i, j) for group in by.values() for i in group for j in group if i < j}
    pairs = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    found = {r["doc_id"]: r["component_id"] for r in ss.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 20 and sum(found[i] == found[j] for i, j in pairs) >= 0.9 * len(pairs)
    # and nothing else: every component holds only what chains of such pairs connect
    assert len(set(found.values())) >= len(rows) - len(pairs) - sum(not s for s in sets.values())


def test_odd_rows(spark, odd_docs, no_docs):
    found = ss.similar_texts(odd_docs).collect()
    assert len(found) == odd_docs.count() and ss.similar_texts(no_docs).count() == 0
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by[1] == by[2] == {1} and by[3] == by[4] == by[5] == {3} and by[None] == {1, 3} and by[6] == {6}
    assert ss.drop_similar(odd_docs).columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in ss.drop_similar(odd_docs).collect()) == [1, 3, 6, 7, 8]


def test_sets_that_no_pair_asks_for_are_not_shuffled(spark, monkeypatch):
    """Only the sets at a pair's ends travel, and no key's chain carries parity bits; the form for
    more pairs than are broadcast gives the same components."""
    plans, written = [], ss.written

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(ss, "written", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = near_copies(random.Random(7))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        want = brute(rows)
        assert {r["doc_id"]: r["component_id"] for r in ss.similar_texts(docs).collect()} == want
        asked = [p for p in plans if "LeftSemi" in p and "whole" in p]
        assert len(asked) == 2 and all("BroadcastHashJoin" in p for p in asked)
        chains = [p for p in plans if "lead(" in p]
        assert len(chains) == 1 and "lead(odd" not in chains[0]
        monkeypatch.setattr(ss, "SENT_PAIRS", 0)
        assert {r["doc_id"]: r["component_id"] for r in ss.similar_texts(docs).collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
