import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricelens.llm import packing
from pricelens.llm.common import tokenizer_file
from pricelens.llm.queries import QUERIES
from pricelens.llm.word_ids import WordTokenizer

SF = "/root/testdata/sf0.001"
PATH = tokenizer_file("word_bpe_49k.json")


@cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@cache
def words():
    return WordTokenizer(PATH, limit=2000)


def check_sequences(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for x in sequences.values():
        at = 0
        for r in sorted(x, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(sequences)


def test_query_round_trip_and_little_padding(spark, texts):
    rows = QUERIES["op4_packing"](spark, SF).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(texts)
    for i, t in texts.items():
        ids = np.array(tokenizer().encode(t, add_special_tokens=False).ids + [2], dtype="<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    total = sum(r["length"] for r in rows)
    assert check_sequences(rows, 4096) <= -(-total // 4096) + 2


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abzAZéÉñßΣσİКк'’.,!?#|<>&*09 \n\t\x0b\x1c\x1f\x85\xa0 ​́😀the"), max_size=60))
def test_ids_are_the_tokenizers(text):
    assert words().ids(text).tolist() == tokenizer().encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "it's we've don't", "a<|endoftext|>b <|startoftext|>", "x" * 5000, "É.È!! ÀÿÖ,ø", "é ́a"])
def test_ids_of_special_texts(text):
    assert words().ids(text).tolist() == tokenizer().encode(text, add_special_tokens=False).ids


def test_knapsack_and_plan_on_known_instances():
    value, pattern = packing.best_pattern(np.array([0.35, 0.5, 0.9]), np.array([3, 4, 7]), 10)
    assert abs(value - 1.25) < 1e-9 and pattern == {0: 1, 2: 1} or abs(value - max(0.35 * a + 0.5 * b + 0.9 * c for a in range(4) for b in range(3) for c in range(2) if 3 * a + 4 * b + 7 * c <= 10)) < 1e-9
    # 30 of 5, 20 of 3, 20 of 2 fill 20 + 5 sequences of 10 without waste
    assert sum(n for n, _ in packing.plan({5: 30, 3: 20, 2: 20}, 10)) == 25
    assert packing.plan({}, 10) == [] and packing.plan({10: 7}, 10) == [(7, ((10, 1),))]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(0, 300), max_size=12))
def test_plans_hold_every_piece_once(demand):
    held = Counter()
    sequences = 0
    for times, pattern in packing.plan(demand, 32):
        assert times > 0 and sum(c * n for c, n in pattern) <= 32
        sequences += times
        for c, n in pattern:
            held[c] += n * times
    assert held == Counter({c: n for c, n in demand.items() if n})
    needed = {c: n for c, n in demand.items() if n}
    linear = sum(t for t, _ in packing.solve(needed, 32)) if needed else 0
    assert sum(c * n for c, n in needed.items()) / 32 <= linear + 1e-6 and sequences <= linear + len(needed)


def test_a_hot_length_is_packed_whole(spark):
    pieces = spark.range(9000).select(
        F.col("id").alias("row_key"), F.lit(0).cast("long").alias("start"),
        F.when(F.col("id") % 3 == 0, 1000).otherwise(F.col("id") % 90 + 1).cast("long").alias("length"))
    rows = packing.pack(pieces).collect()
    assert len({r["row_key"] for r in rows}) == 9000
    assert check_sequences(rows, 4096) <= 1.02 * sum(r["length"] for r in rows) / 4096


def test_odd_rows(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, PATH).collect()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r)
    assert [(r["length"], r["doc_tokens"], r["ids_crc32"]) for r in by_id[3]] == [(1, 1, zlib.crc32(b"\2\0\0\0"))]
    assert len(by_id[1]) == 2 and len(by_id[None]) == 2 and len(by_id[6]) > 10
    assert sum(r["length"] for r in by_id[6]) == by_id[6][0]["doc_tokens"]
    check_sequences(rows, 4096)
    assert packing.pack_documents(no_docs, PATH).count() == 0
