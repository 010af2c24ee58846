import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricelens.llm import pii
from pricelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) < 256 for p in m[0].split("."))]
    found += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return [(k, m.start(), m.end()) for k, m in found]


def test_query_equals_brute_force(spark, texts):
    rows = QUERIES["op8_personal_data"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(pii.written(base).split(",")) - {""} <= set(r["spans"].split(","))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("a1234.@+- ()4%é\n0"), max_size=60))
def test_plain_spans_equal_the_patterns(text):
    assert sorted(pii.plain_spans(text)) == sorted(brute(text))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "255.1.2.3", "1.2.3.4.5.6.7.8", "a.b@c.d", "@@", "+1 (202) 555-0143", "+", " ", "x", "999.1.1.1", "5500000000000004", "a@b", "é"]), max_size=8))
def test_mixed_identifiers_equal_the_patterns(parts):
    text = "".join(parts)
    assert sorted(pii.plain_spans(text)) == sorted(brute(text))


@pytest.mark.parametrize("text,kind,source", [
    ("write to john (at) example (dot) com now", "email", "john (at) example (dot) com"),
    ("write to john [at] mail [dot] example.org.", "email", "john [at] mail [dot] example.org"),
    ("joe at site dot org, at home", "email", "joe at site dot org"),
    ("x jоhn@exаmple.com y", "email", "jоhn@exаmple.com"),
    ("x ｊｏｅ＠ａ．ｂ y", "email", "ｊｏｅ＠ａ．ｂ"),
    ("x jo​e@ex­ample.com y", "email", "jo​e@ex­ample.com"),
    ("user @ host.com ", "email", "user @ host.com"),
    ("at 10 dot 0 dot 0 dot 255 ok", "ip", "10 dot 0 dot 0 dot 255"),
    ("ip １０.０.０.１ ok", "ip", "１０.０.０.１"),
    ("call plus four four two zero seven nine four six zero nine five eight ok", "phone", "plus four four two zero seven nine four six zero nine five eight"),
    ("call two zero two, five five five, zero one four three.", "phone", "two zero two, five five five, zero one four three"),
    ("four one one one 1 1 1 1 one one one one 1 1 1 one", "card", "four one one one 1 1 1 1 one one one one 1 1 1 one"),
    ("call (663) 555-6869 or", "phone", "(663) 555-6869"),
])
def test_disguises_map_back_to_their_source(text, kind, source):
    found = pii.disguised_spans(text, pii.plain_spans(text))
    assert (kind, source) in {(k, text[s:e]) for k, s, e in found}
    assert source not in pii.masked(text, pii.plain_spans(text) + found)


@pytest.mark.parametrize("text,kind,source", [
    ("write to john dot smith at example dot com now", "email", "john dot smith at example dot com"),
    ("john [dot] q [dot] smith [at] example [dot] com", "email", "john [dot] q [dot] smith [at] example [dot] com"),
    ("write to john.smith at example.com.", "email", "john.smith at example.com"),
    ("john dot smith at mail.xyz ok", "email", "john dot smith at mail.xyz"),
    ("write to joe at example.org now", "email", "joe at example.org"),
    ("host one nine two dot one six eight dot zero dot one ok", "ip", "one nine two dot one six eight dot zero dot one"),
    ("host one dot two dot three dot four ok", "ip", "one dot two dot three dot four"),
])
def test_disguised_dots_on_both_sides(text, kind, source):
    found = pii.disguised_spans(text, pii.plain_spans(text))
    assert (kind, source) in {(k, text[s:e]) for k, s, e in found}
    assert pii.masked(text, found) == text.replace(source, f"[{kind.upper()}]")


@pytest.mark.parametrize("text", ["We met at noon.Then home.", "a dot at the end. One", "one dot two dot three", "x" * 70 + " dot " * 3000])
def test_words_at_and_dot_in_prose(text):
    assert pii.disguised_spans(text, pii.plain_spans(text)) == []


@pytest.mark.parametrize("text", [
    "We met at noon. Then home.", "one or two of them", "a dot and a line at the end", "Ελληνικά και Русский текст", "look at this (at) last",
    "seven eight nine", "né à l'été. Où est la mer", "1.2.3", "+1 2",
])
def test_clean_texts_have_no_spans(text):
    plain = pii.plain_spans(text)
    assert plain + pii.disguised_spans(text, plain) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aо＠@. dtone tw​(1)+4"), max_size=50))
def test_spans_lie_in_the_text_and_masking_is_whole(text):
    plain = pii.plain_spans(text)
    spans = plain + pii.disguised_spans(text, plain)
    assert all(0 <= s < e <= len(text) for _, s, e in spans)
    inside = {i for _, s, e in spans for i in range(s, e)}
    kept = "".join(c for i, c in enumerate(text) if i not in inside)
    assert re.sub(r"\[(EMAIL|IP|CARD|PHONE)\]", "", pii.masked(text, spans)) == kept


def test_odd_rows(spark, odd_docs, no_docs):
    rows = pii.find_personal_data(odd_docs).collect()
    spelled = (1, 2, None)  # "one two three ..." is a spelled number
    assert len(rows) == odd_docs.count() and all(r["spans"] == [] for r in rows if r["doc_id"] not in spelled)
    assert all(r["plain"] == [] for r in rows)
    assert pii.find_personal_data(no_docs).count() == 0
    masked = pii.mask_personal_data(odd_docs, length_col="n_chars")
    assert masked.columns == odd_docs.columns and masked.schema["n_chars"].dataType == odd_docs.schema["n_chars"].dataType
    kept = lambda df: {r["doc_id"]: r["text"] for r in df.collect() if r["doc_id"] not in spelled}
    assert kept(masked) == kept(odd_docs)
    one = spark.createDataFrame([(1, "mail a@b.cd " * 3000 + "+1 202 555 0143", 5)], "doc_id long, text string, n_chars int")
    row = pii.mask_personal_data(one, length_col="n_chars").first()
    assert row["text"] == "mail [EMAIL] " * 3000 + "[PHONE]" and row["n_chars"] == len(row["text"])


def test_disguised_names_of_any_length_are_whole():
    for local in ("x" * 200, " dot ".join(["ab"] * 40), ".".join(["name"] * 60), " [dot] ".join(["y" * 90] * 12)):
        for at, rest in ((" at ", "example dot com"), (" [at] ", "z" * 80 + ".example (dot) org"), ("(at)", "mail.example.com"), (" @ ", "example dot org")):
            text = f"write, {local}{at}{rest}, now"
            spans = pii.disguised_spans(text, pii.plain_spans(text))
            assert spans == [("email", 7, len(text) - 5)], text


def test_cost_of_long_texts_with_disguises_grows_with_their_length():
    parts = ["a" * 1_000_000 + " dot b", "x dot " * 200_000, " at " * 300_000, " " * 500_000 + "(at)" + " " * 500_000, "one two " * 100_000,
             "( at ) [dot] " * 80_000, "a.b@" * 200_000, "1 dot 2 dot " * 80_000, "name at host.com " * 50_000]
    for text in parts:
        begin = time.process_time()
        pii.disguised_spans(text, pii.plain_spans(text))
        assert time.process_time() - begin < 12, text[:20]
