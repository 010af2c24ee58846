from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricelens.llm.common import tokenizer_file
from pricelens.llm.queries import QUERIES
from pricelens.llm.token_count import MARK, Counter, Vocabulary, count_tokens, load_vocabulary

SF = "/root/testdata/sf0.001"
PATH = tokenizer_file("piece_bpe_32k.model")
#: scores with many ties, in exact binary fractions
TIES = {MARK: -2.0, "a": -1.0, "b": -1.0, "ab": -2.0, "ba": -2.0, "aba": -3.0, "bab": -2.5, MARK + "a": -3.0, MARK + "ab": -3.5, "c": -4.0}


def reference(pieces, byte_fallback):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    vocabulary = [("<unk>", -1000.0 if pieces is TIES else 0.0)]
    if byte_fallback:
        vocabulary += [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    return Tokenizer(Unigram(vocabulary + list(pieces.items()), 0, byte_fallback))


@cache
def public():
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    m = sentencepiece.SentencePieceProcessor(model_file=PATH)
    pieces = [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]
    return Tokenizer(Unigram(pieces, 0, True)), Counter(load_vocabulary(PATH))


def marked(text):
    return MARK + text.replace(" ", MARK)


def test_query_equals_the_tokenizer(spark, texts):
    tokenizer, _ = public()
    rows = QUERIES["op3_token_count"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["n_chars"] == len(t) and r["n_tokens"] == len(tokenizer.encode(marked(t), add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("the ing onéß\n\t😀漢字  ▁'.,"), max_size=60))
def test_any_text_equals_the_tokenizer(text):
    tokenizer, counter = public()
    want = len(tokenizer.encode(marked(text), add_special_tokens=False).ids) if text else 0
    assert counter.count(text)[1] == want


@cache
def tied():
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    return Tokenizer(Unigram([("?", -5.0), *TIES.items()], 0, False)), Counter(Vocabulary({"?": -5.0, **TIES}, False))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab cxy", min_size=1, max_size=25))
def test_ties_and_unknown_runs_follow_the_tokenizer(text):
    tokenizer, counter = tied()
    assert counter.count(text)[1] == len(tokenizer.encode(marked(text), add_special_tokens=False).ids)


def test_pieces_across_words_are_searched_as_one():
    counter = Counter(Vocabulary({"a": -1.0, MARK: -1.0, f"a{MARK}a": -1.0}, False))
    assert counter.count("a a") == (-2.0, 2)


@pytest.mark.parametrize("text,tokens", [("", 0), (" ", 1)])
def test_blank_texts(text, tokens):
    assert public()[1].count(text)[1] == tokens


def test_odd_rows(odd_docs, no_docs):
    rows = count_tokens(odd_docs, PATH).collect()
    assert len(rows) == odd_docs.count() and count_tokens(no_docs, PATH).count() == 0
    assert {(r["n_chars"], r["n_tokens"], r["score"]) for r in rows if r["doc_id"] in (3, 4)} == {(0, 0, 0.0)}
    assert len({(r["n_tokens"], r["score"]) for r in rows if r["doc_id"] in (1, 2)}) == 1
