"""Prefix token counts against the tokenizer library on whole texts and on every prefix."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from ripplenet.llm import token_counts

tokenizers = pytest.importorskip("tokenizers")
PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    loaded = tokenizers.Tokenizer.from_file(PATH)
    return lambda text: len(loaded.encode(text, add_special_tokens=False).ids)


ODD = [
    "", " ", "  \n\n x", "we'll say 'tis don't they'RE 'r", "a  b\t\tc \n\n\n d  ", "x<|endoftext|>y<|endof", "!!'s  <|endoftext|>",
    "naïve \U0001f600\U0001f600 日本語 ½ ²", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\x1c\x1d a\x85b\xa0 c  ",
]


@pytest.mark.parametrize("text", ODD)
def test_every_prefix(library, text):
    ask = token_counts.counter(PATH)
    assert ask.count(text) == library(text)
    assert ask.prefixes(text) == [library(text[:k]) for k in range(len(text) + 1)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdeilrtsv' '\n\t 019.,!é日 \xa0")), max_size=40))
def test_random_prefixes(text):
    loaded = tokenizers.Tokenizer.from_file(PATH)
    want = [len(loaded.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    ask = token_counts.counter(PATH)
    assert ask.prefixes(text) == want and ask.count(text) == want[-1]


def test_counts_of_documents(library, documents, odd_documents, no_documents):
    for docs in (documents, odd_documents, no_documents):
        got = sorted(map(tuple, token_counts.count_tokens(docs, PATH).collect()), key=str)
        texts = [(r[0], r[1] or "") for r in docs.select("doc_id", "text").collect()]
        want = [(i, len(t.encode()), library(t), library(t) > 512) for i, t in texts]
        assert got == sorted(want, key=str)


def test_truncation_by_stored_counts(spark, library):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, None)], "doc_id bigint, text string")
    stored = token_counts.prefix_counts(docs, PATH)
    cuts = {r[0]: r[1] for r in stored.select("doc_id", token_counts.longest_prefix(F.col("counts"), F.lit(3))).collect()}
    for i, text in enumerate(ODD):
        assert cuts[i] == max(k for k in range(len(text) + 1) if library(text[:k]) <= 3)
    assert cuts[None] == 0


def test_small_store_gives_equal_counts(monkeypatch, library):
    monkeypatch.setattr(token_counts, "MAX_PIECES", 3)
    text = "one two three four five six seven one two three"
    assert token_counts.PrefixCounter(PATH).count(text) == library(text)


@pytest.mark.parametrize("limit", [0, 1, 3, 7])
def test_kept_characters(spark, library, limit):
    texts = [*ODD, "one two   three  \n\n four's<|endoftext|>  five <|endoftext|><|endoftext|> six <|endoft"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None)], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in token_counts.count_and_cut(docs, PATH, limit).collect()}
    for i, text in enumerate(texts):
        want = max(k for k in range(len(text) + 1) if library(text[:k]) <= limit)
        assert (rows[i]["n_chars_kept"], rows[i]["n_tokens"]) == (want, library(text))
        assert rows[i]["over_limit"] == (library(text) > limit)
    assert rows[None]["n_chars_kept"] == 0


def test_documents_cut_to_the_limit(library, documents):
    texts = dict(documents.select("doc_id", "text").collect())
    for r in token_counts.count_and_cut(documents, PATH).collect():
        text, k = texts[r["doc_id"]], r["n_chars_kept"]
        assert library(text[:k]) <= 512 and (k == len(text) or library(text[: k + 1]) > 512)


def test_special_strings_cost_what_stands_between_them():
    ask = token_counts.counter(PATH)
    ask.count("some words ")
    seconds = []
    for n in (50, 200):
        text = ("some words " * 90 + "<|endoftext|>") * n
        began = time.process_time()
        counts = ask.prefixes(text)
        seconds.append(time.process_time() - began)
        assert len(counts) == len(text) + 1 and counts[-1] == ask.count(text)
    assert seconds[1] < 10 * seconds[0]
