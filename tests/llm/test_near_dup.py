import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pricelens.llm import near_dup as nd
from pricelens.llm.queries import QUERIES
from pricelens.plans.components import connected_components

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(fps))]


def test_query_equals_brute_force(spark, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op10_simhash_ring"](spark, SF).collect()}
    ids = sorted(texts)
    fps = [brute_fingerprint(texts[i]) for i in ids]
    assert [rows[i]["fingerprint"] for i in ids] == [f"{x:016x}" for x in fps]
    assert [rows[i]["component_id"] for i in ids] == [ids[c] for c in brute_components(fps)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("seed", [1, 2])
def test_links_of_clusters_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    fps = set()
    for _ in range(25):
        x = rnd.getrandbits(64)
        fps.add(x)
        for _ in range(rnd.randrange(14)):
            for _ in range(rnd.randrange(1, 5)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    root = {r["node"]: r["root"] for r in connected_components(nd.link_forest(nodes)).collect()}
    got = [root.get(signed(x), signed(x)) for x in fps]
    want = brute_components(fps)
    pairs = lambda z: {(a, b) for a in range(len(z)) for b in range(a) if z[a] == z[b]}
    assert pairs(got) == pairs(want)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_ring_filter_loses_no_pair(x, bits):
    y = x
    for b in bits:
        y ^= 1 << b
    found = False
    for start in range(4):
        a, b = (nd._head(np.array([v], dtype="u8"), start)[0] for v in (x, y))
        if int(a ^ b) & 0xFFFF == 0 and int(a ^ b).bit_count() <= 1:
            own = np.array([True, bool(a == b)])
            found |= bool(nd.bucket_forest(np.array([x, y], dtype="u8"), own, start)) or x == y
    assert found


def test_odd_rows(spark, odd_docs, no_docs):
    rows = nd.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count() and nd.near_duplicates(no_docs).count() == 0
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["component_id"] == 1 and by_id[4]["fingerprint"] == "0" * 16 and by_id[4]["component_id"] == 3
    assert by_id[None]["component_id"] in (1, 3)
    kept = nd.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 6, 7, 8]


def test_only_null_ids_keep_one_row(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "A b c d")], "doc_id long, text string")
    assert nd.drop_near_duplicates(docs).count() == 1


def test_a_dense_bucket_takes_a_forest(spark):
    rnd = random.Random(5)
    fps = np.array(sorted({sum(1 << rnd.randrange(40, 64) for _ in range(2)) for _ in range(300)}), dtype="u8")
    edges = nd.bucket_forest(fps, np.ones(len(fps), dtype=bool), 0)
    assert 0 < len(edges) < len(fps)
