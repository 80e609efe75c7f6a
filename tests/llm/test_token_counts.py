import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from stintwise.llm import token_counts as token_counts_module
from stintwise.llm.token_counts import Counter, marked_words, token_counts, unigram_vocabulary

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def library(vocabulary, unknown, fallback):
    t = Tokenizer(models.Unigram(vocabulary, unk_id=unknown, byte_fallback=fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def count(counter, text):
    words = marked_words(text)
    known = counter.known(words)
    assert all(known[w] == counter.walk(w) for w in words)  # together and one by one
    return sum(known[w][0] for w in words)


@pytest.mark.parametrize("seed", range(30))
def test_small_vocabularies_with_many_ties(seed):
    rng = random.Random(seed)
    letters = "abc▁"
    pieces = {"".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(rng.randint(3, 25))}
    vocabulary = [("<unk>", 0.0)] + [(p, -float(rng.randint(1, 4))) for p in sorted(pieces)]
    want, counter = library(vocabulary, 0, False), Counter(vocabulary, 0, False)
    for _ in range(60):
        text = "".join(rng.choices("abcd é", k=rng.randint(0, 14)))
        assert count(counter, text) == len(want.encode(text, add_special_tokens=False).ids), text


def test_generations_of_known_words_and_words_that_hold_the_separator(monkeypatch):
    monkeypatch.setattr(token_counts_module, "MEMO", 5)
    vocabulary = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("▁ab", -2.0), ("b", -3.0)]
    counter = Counter(vocabulary, 0, False)
    for _ in range(3):
        for text in ("ab a b", "a aa aaa ab abb", "b\U0010fffea ab", "x " + "ab" * 100):
            assert count(counter, text) == sum(counter.walk(w)[0] for w in marked_words(text))
    assert len(counter.old) <= 12


@pytest.fixture(scope="module")
def public():
    return unigram_vocabulary(MODEL)


def test_given_documents_equal_the_library(spark, public):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = library(*public, True)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in token_counts(docs, *public).collect():
        assert r["n_tokens"] == len(want.encode(texts[r["doc_id"]], add_special_tokens=False).ids)


def test_odd_texts(spark, public):
    rows = [(1, None), (2, ""), (3, " "), (4, "  a  "), (5, "▁x ▁"), (6, "ꙮ\n\U0001f642"), (None, "a b")]
    rows += [(7, "ab" * 20_000), (1, None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, score double")
    want = library(*public, True)
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts(df, *public).collect())
    assert got == sorted(
        (str(d), len(want.encode(t or "", add_special_tokens=False).ids)) for d, t in rows
    )
    assert token_counts(df.limit(0), *public).collect() == []
