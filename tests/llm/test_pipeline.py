import re
import zlib
from collections import defaultdict

import pytest

import corpus_pipeline
from pricelens.llm import pii, quality_rules
from pricelens.session import cut_lineage
from test_packing import check_sequences, tokenizer
from test_shingle_sets import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returned, by name, and the input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, SF))
        out[name] = docs
    return out


def test_stage_names_and_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "simhash near-dedup", "benchmark decontamination", "personal data", "packing"]
    for n in names[:-1]:
        assert stages[n].columns == stages["documents"].columns


def test_quality_stage_keeps_what_the_query_keeps(spark, stages):
    from pricelens.llm.queries import QUERIES

    want = {r["doc_id"] for r in QUERIES["op2_quality_rules"](spark, SF).collect() if r["kept"]}
    assert {r["doc_id"] for r in stages["quality rules"].collect()} == want
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assessed = quality_rules.assess(stages["documents"]).where(~quality_rules.base_failed()).collect()
    assert good & {r["doc_id"] for r in assessed} <= want


def test_one_document_of_each_group_stays(stages):
    before = [(r["doc_id"], "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])) for r in stages["quality rules"].collect()]
    roots = set(brute(before).values())
    assert {r["doc_id"] for r in stages["simhash near-dedup"].collect()} == roots and len(roots) < len(before)


def test_documents_with_benchmark_items_go(spark, stages):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r["text"] for r in stages["simhash near-dedup"].collect()}
    after = {r["doc_id"] for r in stages["benchmark decontamination"].collect()}
    holding = {i for i, t in before.items() if any(x in t for x in items)}
    assert not holding & after

    def grams(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        return set(zip(*(w[k:] for k in range(5))))

    seeds = set().union(*map(grams, items))
    assert {i for i, t in before.items() if not grams(t) & seeds} <= after


def test_personal_data_is_masked(stages):
    before = {r["doc_id"]: r["text"] for r in stages["benchmark decontamination"].collect()}
    after = stages["personal data"].collect()
    assert {r["doc_id"] for r in after} == set(before)
    for r in after:
        plain = pii.plain_spans(before[r["doc_id"]])
        assert r["text"] == pii.masked(before[r["doc_id"]], plain + pii.disguised_spans(before[r["doc_id"]], plain))
        assert pii.plain_spans(r["text"]) == [] and r["n_chars"] == len(r["text"])


def test_packing_holds_every_token(stages):
    rows = stages["packing"].collect()
    check_sequences(rows, 4096)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    docs = {r["doc_id"]: r["text"] for r in stages["personal data"].collect()}
    assert set(pieces) == set(docs)
    import numpy as np

    for i, t in docs.items():
        ids = np.array(tokenizer().encode(t, add_special_tokens=False).ids + [2], dtype="<u4")
        found = sorted((r["start"], r["length"], r["ids_crc32"]) for r in pieces[i])
        assert found == [(s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096].tobytes())) for s in range(0, len(ids), 4096)]


def test_run_equals_the_stages(spark, stages):
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages["packing"])


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns or name == "packing"
            out.count()


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in names
