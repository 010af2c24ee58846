import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pricelens.llm import chunk_dedup as cd
from pricelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(n))


def test_gear_hash_is_the_recurrence():
    data = np.frombuffer(random.Random(1).randbytes(500), dtype=np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(cd.GEAR[b])) & 0xFFFF
        want.append(h)
    assert cd.gear_hash(data).tolist() == want


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=900))
def test_chunks_cover_the_text_and_split_no_character(text):
    body = text.encode()
    ends = cd.cuts(body)
    pieces = [body[s:e] for s, e in zip([0, *ends], ends)]
    assert b"".join(pieces) == body and "".join(p.decode() for p in pieces) == text
    assert all(cd.LEAST <= len(p) <= cd.MOST + 3 for p in pieces[:-1]) and all(pieces)


def test_an_insertion_shifts_few_chunks():
    rnd = random.Random(2)
    text = words(rnd, 3000)
    other = "inserted " + text[:9000] + " more" + text[9000:]
    split = lambda t: {t.encode()[s:e] for s, e in zip([0, *cd.cuts(t.encode())], cd.cuts(t.encode()))}
    assert len(split(text) - split(other)) < 12 and len(split(text)) > 300


def test_repeated_passages_are_found_and_clean_texts_are_not(spark):
    rnd = random.Random(4)
    shared = [words(rnd, 55) for _ in range(30)]
    rows = [(i, words(rnd, 80)) for i in range(60)]  # clean
    for k, p in enumerate(shared):
        rows += [(1000 + 2 * k, words(rnd, 30) + " " + p + " " + words(rnd, 20)), (1001 + 2 * k, p + ". " + words(rnd, 60))]
    rows += [(5000 + i, words(rnd, 40) + "\nthe same short line.\n" + words(rnd, 40)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = cd.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in found} == set(range(1000, 1060))
    text = dict(rows)
    seen = defaultdict(list)
    for r in found:
        part = text[r["doc_id"]][r["start"]:r["stop"]]
        assert len(part) == r["n_chars"] and part in shared[(r["doc_id"] - 1000) // 2]
        seen[(r["doc_id"] - 1000) // 2].append(r["first"])
    assert all(sorted(x) == [False, True] for x in seen.values())


def test_query_finds_documents_that_share_fifty_words(spark, texts):
    own = defaultdict(set)
    for i, t in texts.items():
        w = t.split()
        for k in range(len(w) - 50):
            own[tuple(w[k:k + 51])].add(i)
    shared = set().union(*[x for x in own.values() if len(x) > 1])
    assert shared <= {r["doc_id"] for r in QUERIES["op6_chunk_dedup"](spark, SF).collect()}


def test_odd_rows(odd_docs, no_docs):
    rows = cd.repeated_passages(odd_docs).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, None} and cd.repeated_passages(no_docs).count() == 0
    assert {r["first"] for r in rows if r["doc_id"] is None} == {True}  # nulls order first
