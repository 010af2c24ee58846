import re

from compare import compare, connect
from pricelens.llm import queries
from pricelens.llm.license_scan import Template, license_spans, scan_licenses

SF = "/root/testdata/sf0.001"


def scan(spark, *texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in scan_licenses(docs, **how).collect()}


def test_query_equals_its_check(spark):
    name = "op1_license_scan"
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name], []) == ""


def test_base_counts_equal_brute_force(spark, texts):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in scan_licenses(docs).collect():
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r["doc_id"]])
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        found = [(i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i:i + len(p)]) == p]
        starts = [i for i, _ in found]
        assert r["n_words"] == len(w) and r["n_base"] == len(found)
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found}))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}


def test_overlapping_and_repeated_phrases_all_count(spark):
    r = scan(spark, "MIT License mit licenſe mit-license, the GNU General Public License")[0]
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (3, 0, 8, "gpl,mit")


def test_inserted_and_missing_words_move_diagonals_but_count(spark):
    notice = "Permission is hereby kindly granted, free of any charge, to any person obtaining a copy of software and associated documentation files"
    r = scan(spark, "start " + notice + " end", "Permission to any person")
    assert "mit-text" in r[0]["labels"] and 0.6 <= r[0]["score"] < 1 and r[0]["n_base"] == 0
    assert r[1]["labels"] == "" and r[1]["score"] == 0


def test_far_votes_are_not_one_span(spark):
    template = (Template("t", "a b c d e f g h"),)
    docs = spark.createDataFrame([(0, "a b c x x x x x x x x x x x x x x x x f g h"), (1, "a b c d x e f g h")], "doc_id long, text string")
    assert [(r["doc"], r["first_word"], r["last_word"]) for r in license_spans(docs, template).collect()] == [(1, 0, 8)]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = scan_licenses(odd_docs).collect()
    assert len(rows) == odd_docs.count() and scan_licenses(no_docs).count() == 0
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[3]["n_words"] == by_id[4]["n_words"] == by_id[5]["n_words"] == 0
    assert by_id[6]["n_words"] == 30_003 and (by_id[8]["n_base"], by_id[8]["first_word"]) == (1, 3)


def test_hot_template_in_one_row(spark):
    r = scan(spark, "mit license " * 20_000)[0]
    assert (r["n_base"], r["first_word"], r["last_word"]) == (20_000, 0, 39_998)
