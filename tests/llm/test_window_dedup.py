import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pricelens.llm import window_dedup as wd
from pricelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(bodies, width):
    """bodies in order; the removed bytes of each as a mask."""
    seen, out = set(), []
    for body in bodies:
        gone = bytearray(len(body))
        for i in range(len(body) - width + 1):
            window = body[i:i + width]
            if window in seen:
                gone[i:i + width] = b"\x01" * width
            else:
                seen.add(window)
        out.append(bytes(gone))
    return out


def digest_row(body, gone):
    left = bytes(b for b, g in zip(body, gone) if not g)
    starts = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
    return len(body), sum(gone), starts, left


def test_query_equals_brute_force(spark, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op11_radix_windows"](spark, SF).collect()}
    ids = sorted(texts)
    bodies = [(texts[i] or "").encode() for i in ids]
    removed = 0
    for i, body, gone in zip(ids, bodies, brute(bodies, 100)):
        n, cut, spans, left = digest_row(body, gone)
        removed += cut
        assert (rows[i]["n_bytes"], rows[i]["n_removed"], rows[i]["n_spans"]) == (n, cut, spans), i
        assert rows[i]["kept_sha256"] == hashlib.sha256(left).hexdigest()
    assert removed > 10_000 and len(rows) == len(ids)


def made(seed):
    """Texts over few letters, copied stretches of all lengths, runs of one letter, periods."""
    rnd = random.Random(seed)
    texts = []
    for _ in range(40):
        out = []
        for _ in range(rnd.randint(0, 6)):
            kind = rnd.random()
            if kind < 0.4 and texts:
                other = rnd.choice(texts)
                s = rnd.randint(0, max(0, len(other) - 1))
                out.append(other[s:s + rnd.randint(1, 40)])
            elif kind < 0.55:
                out.append(rnd.choice("ab") * rnd.randint(1, 30))
            elif kind < 0.65:
                out.append("xyz" * rnd.randint(1, 12))
            else:
                out.append("".join(rnd.choice("abcdéß") for _ in range(rnd.randint(1, 25))))
        texts.append("".join(out))
    return texts


@pytest.mark.parametrize("seed, width, gram, block", [(1, 12, 5, 3), (2, 9, 9, 9), (3, 10, 1, 1), (4, 16, 7, 4)])
def test_any_split_equals_brute_force(spark, seed, width, gram, block):
    texts = made(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = {r["doc_id"]: r for r in wd.remove_repeats(docs, width=width, gram=gram, block=block).collect()}
    bodies = [t.encode() for t in texts]
    for i, (body, gone) in enumerate(zip(bodies, brute(bodies, width))):
        n, cut, spans, left = digest_row(body, gone)
        assert (rows[i]["n_bytes"], rows[i]["n_removed"], len(rows[i]["spans"]), bytes(rows[i]["kept"])) == (n, cut, spans, left), texts[i]


def test_long_texts_in_pieces_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(wd, "PIECE", 64)
    texts = made(9) + ["".join(made(10))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: bytes(r["kept"]) for r in wd.remove_repeats(docs, width=14, gram=6, block=4).collect()}
    bodies = [t.encode() for t in texts]
    assert rows == {i: digest_row(b, g)[3] for i, (b, g) in enumerate(zip(bodies, brute(bodies, 14)))}


def test_odd_rows(spark, odd_docs, no_docs):
    found = wd.remove_repeats(odd_docs).collect()
    assert len(found) == odd_docs.count()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], set()).add((r["n_bytes"], r["n_removed"]))
    # id 1 stands twice and is one document; ids 2 and null hold copies of it
    plain = next(iter(by[1]))
    assert by[2] == {(plain[0], plain[0])} and (plain[0], plain[0]) in by[None] and (0, 0) in by[None]
    assert by[3] == by[4] == {(0, 0)} and by[7] == {(1, 0)}
    assert 0 < plain[1] < plain[0]  # the text repeats itself
    assert wd.remove_repeats(no_docs).count() == 0


def test_hot_passage(spark):
    """Two thirds of the documents share a passage; its bytes stay in the first only."""
    passage = " ".join(f"shared{i}" for i in range(40))
    docs = spark.range(900).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 < 2, F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(passage), F.sha2((F.col("id") + 5000).cast("string"), 256)))
        .otherwise(F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.sha2(F.concat(F.col("id").cast("string"), F.lit("-"), i.cast("string")), 256))))
        .alias("text"),
    ).repartition(7)
    rows = {r["doc_id"]: r for r in wd.remove_repeats(docs).collect()}
    n = len(passage)
    assert rows[0]["n_removed"] == 0 and all(rows[i]["n_removed"] == 0 for i in range(2, 900, 3))
    for i in range(1, 900):
        if i % 3 < 2:
            # a neighbouring hex digit may agree by chance
            assert n <= rows[i]["n_removed"] <= n + 8 and len(rows[i]["spans"]) == 1
