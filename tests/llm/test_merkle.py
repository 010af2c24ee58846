import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pricelens.llm import merkle
from pricelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def root_and_proofs(leaves, arity):
    """The top of the leaves and each one's siblings, level by level, by index."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // arity * arity:(k // arity + 1) * arity]
            proofs[i].append((run[:k % arity], run[k % arity + 1:]))
        nodes = [sha("".join(nodes[k:k + arity])) for k in range(0, len(nodes), arity)]
        at = [k // arity for k in at]
    return nodes[0], proofs


def brute(rows, arity):
    """rows: (id, group, leaf, seen leaf) to the expected output rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    done = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3]))
        done[g] = root_and_proofs([r[2] for r in groups[g]], arity)
    root, above = root_and_proofs([done[g][0] for g in order], arity)
    out = []
    for g, upper in zip(order, above):
        for r, proof in zip(groups[g], done[g][1]):
            path, node = proof + upper, r[3]
            for before, behind in path:
                node = sha("".join(before) + node + "".join(behind))
            joined = "".join("".join(b) + "".join(a) for b, a in path)
            out.append((r[0], r[2], done[g][0], root, sha(joined), node, node == root))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = []
    for d in docs:
        values = [d[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
        text = d["text"]
        if zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0 and text is not None:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        rows.append((d["doc_id"], d["source"], leaf(values), leaf([*values[:-1], text])))
    found = sorted(map(tuple, QUERIES["op12_merkle_manifest"](spark, SF).collect()), key=repr)
    expected = brute(rows, 16)
    assert found == expected
    assert 0 < sum(not r[-1] for r in expected) < len(expected)


@pytest.mark.parametrize("arity, levels", [(2, 1), (2, 3), (3, 2), (16, 3)])
def test_many_exchanges_give_the_same_tree(spark, arity, levels):
    """Groups of 1, 2, 9 and 70 rows and 40 groups of their own: up to seven exchanges."""
    rows = [(i, "big", f"T{i}") for i in range(70)] + [(i, "nine", "x") for i in range(9)] + [(1, "two", "A"), (2, "two", None)]
    rows += [(7, None, "n")] + [(i, f"g{i}é", "Q") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)
    found = merkle.manifest(docs, ("doc_id", "text"), seen={"text": merkle.ascii_lowered(F.col("text"))}, seen_where=F.col("doc_id") % 3 == 0,
                            arity=arity, levels=levels)
    expected = brute([
        (i, g, leaf([i, t]), leaf([i, t.lower() if t and i % 3 == 0 else t])) for i, g, t in rows], arity)
    assert sorted(map(tuple, found.collect()), key=repr) == expected


def test_odd_rows(spark, odd_docs, no_docs):
    found = merkle.manifest(odd_docs).collect()
    rows = [tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in odd_docs.collect()]
    assert sorted(map(tuple, found), key=repr) == brute([(r[0], r[1], leaf(r), leaf(r)) for r in rows], 16)
    assert all(r["verified"] for r in found)
    assert merkle.manifest(no_docs).count() == 0
    assert merkle.manifest(no_docs).columns == merkle.manifest(odd_docs).columns


def test_one_group_does_not_meet_in_one_task(spark):
    """A group's rows are numbered by ranges and hashed by superblocks."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"))
    ranked, _ = merkle.numbered(docs.select(F.lit("hot").alias("tree"), F.col("doc_id").alias("doc")), "tree", ["doc"])
    assert ranked.where("pos = doc and total = 20000").count() == 20_000
    found = merkle.manifest(docs, ("doc_id",), arity=4, levels=3)
    assert found.count() == 20_000 and found.where("verified").count() == 20_000
    assert found.select("root").distinct().first()[0] == root_and_proofs([leaf([i]) for i in range(20_000)], 4)[0]
