import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyvox.llm import tokens, units
from tallyvox.llm.common import tokenizer_path
from tallyvox.llm.queries import LLM_QUERIES

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
ODD = (
    "a  b   c\n\n d\t\te   f g  h <|endoftext|> i<|endoftext|>j 's we'll 12 34 ... !!\x85x\x1cy "
    "z\x1f \x1e ÀÉ é ́ ß İI ΑΣ Σ ﬁ 😀👍🏽 中文 字 <|startoftext|>\r\n end \n"
)


def library(name):
    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def ids_of(ids):
    return tuple(ids.tolist())


def by_units(name, texts):
    encode = units.units(tokenizer_path(name), ids_of)
    assert encode.split is not None
    return [[i for part in parts for i in part] for parts in encode(texts)]


@pytest.mark.parametrize("name", [BYTES, WORDS])
def test_units_are_the_library(name, documents):
    draw = random.Random(5)
    texts = [t or "" for _, t in documents[:60]]
    texts += ["Δ. Σ, İ. İstanbul, \u0958. \u0958a b, c. aa.. ,b .c d., e,. \u2126. \u212b, ﬁn. x", "a,", " a,", ","]
    texts += ["", " ", "\n", ODD, *("".join(draw.choices(ODD, k=draw.randrange(40))) for _ in range(3000))]
    encode = library(name)
    assert by_units(name, texts) == [encode(t) for t in texts]


@pytest.mark.parametrize("name", [BYTES, WORDS])
@given(text=st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_units_of_any_text(name, text):
    assert by_units(name, [text]) == [library_cache(name)(text)]


_LIBRARY = {}


def library_cache(name):
    return _LIBRARY.setdefault(name, library(name))


def test_memo_is_bounded():
    path = tokenizer_path(BYTES)
    joint = units.joint(units.spec(path), units.SPACED)
    encode = units.Units(Tokenizer.from_file(path), units.SPACED, len, joint, entries=50)
    for i in range(20):
        texts = [f"w{i}x{j} " + "y" * 100 for j in range(30)]
        counted = library_cache(BYTES)
        assert [sum(parts) for parts in encode(texts)] == [len(counted(t)) for t in texts]
        assert len(encode.memo) <= 50 + 60 and len(encode.older) <= 50 + 60


def test_unknown_kinds_are_encoded_whole():
    spec = dict(units.spec(tokenizer_path(BYTES)))
    assert units.splitter(spec) is not None
    assert units.splitter({**spec, "normalizer": {"type": "Strip"}}) is None
    assert units.splitter({**spec, "pre_tokenizer": {"type": "Whitespace"}}) is None
    assert units.splitter({**spec, "model": {"type": "Unigram"}}) is None


def test_query(spark, sf_dir, documents):
    count = library_cache(BYTES)
    found = {r.doc_id: r for r in LLM_QUERIES["op3_token_counts"](spark, sf_dir).collect()}
    assert len(found) == len(documents)
    for key, text in documents:
        row, body = found[key], text or ""
        assert (row.n_bytes, row.n_tokens) == (len(body.encode()), len(count(body)))
        assert row.over_limit == (row.n_tokens > 512)


def test_sentencepiece_file(spark):
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_path("piece_bpe_32k.model")
    model = SentencePieceProcessor(model_file=path)
    docs = spark.createDataFrame([(1, "Hello world"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, path).collect()}
    assert found == {1: len(model.encode("Hello world")), 2: 0}


def test_odd_rows(odd_documents, no_documents):
    path, count = tokenizer_path(BYTES), library_cache(BYTES)
    found = tokens.token_counts(odd_documents, path, limit=3).collect()
    wanted = sorted(
        (r.doc_id, len((r.text or "").encode()), len(count(r.text or "")), len(count(r.text or "")) > 3)
        for r in odd_documents.collect()
    )
    assert sorted(tuple(r) for r in found) == wanted
    assert tokens.token_counts(no_documents, path).count() == 0




@pytest.mark.parametrize("entries", [30, 1 << 20])
def test_ids_of_whole_texts_are_the_library(documents, entries):
    """Batches one after another, with a table that is cleared in between and one that is not."""
    shared = units.units(tokenizer_path(WORDS), None)
    encode = units.WordIds(shared.tokenizer, shared.split, shared.joint, shared.plain, entries)
    texts = [text or "" for _, text in documents] + [
        "", " ", "x" * 5000, "a,b.c!? d'll we've 'S it's...", "İstanbul ΣΑΣ ΟΔΟΣ. ﬁn Å Å", "a\x1cb c\x1d", "tail### .,; ## _x_ <|endoftext|>",
        "<|startoftext|> word<|endoftext|> ab̸c≠ é. Straße...  x y 12.5% café!!! ͅa",
    ]
    for start in range(0, len(texts), 40):
        part = texts[start : start + 40]
        assert [ids.tolist() for ids in encode(part)] == [library_cache(WORDS)(t) for t in part]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aZé .,!'’#_̸́İΣßﬁ1٣\n \x1c"), max_size=40))
def test_ids_of_any_whole_text(text):
    encode = units.units(tokenizer_path(WORDS), None)
    assert encode([text, text + " tail"])[0].tolist() == library_cache(WORDS)(text)


def test_a_very_long_text_without_white_space_is_one_unit():
    encode = units.units(tokenizer_path(WORDS), None)
    text = "abcdefghij" * 1_000_000  # 10 MB, one word
    before = len(encode.words)
    assert encode([text])[0].tolist() == library_cache(WORDS)(text) and len(encode.words) == before
