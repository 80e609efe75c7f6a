import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stintwise.llm import planes
from stintwise.llm.planes import Encoder, crc_after, encoded_documents, from_planes, to_planes

FILE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", None, " ", "  two  spaces ", "a b c", "line\nbreak and\n\nmore", "tab\tand x\n", "it's we'll",
    "<|endoftext|> inside a<|endoftext|>b <|endoftext|>", "été ñandú 日本 🙂", "x" * 3000, " nbsp a",
    "word " * 5000, "1 2 33 %%% a!! b", "a b c",
]


@pytest.mark.parametrize("unit", [1, 8])
def test_planes_go_there_and_back(unit):
    rng = np.random.default_rng(1)
    for ids in ([], [0], [0, 0], [2**32 - 1, 5], rng.integers(0, 50257, 1001), rng.integers(0, 70000, 64)):
        ids = np.array(ids, np.uint32)
        bits, raw = to_planes(ids, unit)
        assert len(raw) == bits // unit
        assert from_planes(raw, len(ids), unit).tolist() == ids.tolist()


def test_crc_of_parts():
    rng = random.Random(3)
    for _ in range(20):
        a, b = rng.randbytes(rng.randint(0, 50)), rng.randbytes(rng.randint(0, 3000))
        assert crc_after(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_plain_words_go_to_the_model_by_their_pieces():
    library, own = Tokenizer.from_file(FILE), Encoder(FILE)
    own.tokenizer = None  # what cuts whole words
    texts = ["It's über-plain, 'll we?\n\nYes 12a b3!!  ", "a b a b'd", " \n x", "ÀÿéÖ'S ~|_"]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_odd_texts_give_the_ids_of_the_library():
    library, own, rng = Tokenizer.from_file(FILE), Encoder(FILE), random.Random(5)
    signs = "ab'stremvldA09 \n\n  .,!<|>_-~éÿ×÷ßÀ\t\u00a0²ªµ漢\x00\x7f\x0b"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 25))) for _ in range(3000)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_give_the_ids_of_the_whole_text():
    library, own = Tokenizer.from_file(FILE), Encoder(FILE)
    texts = [t or "" for t in TEXTS]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", [1, 8])
def test_documents_from_the_files(spark, monkeypatch, unit):
    rng = random.Random(2)
    rows = [(i * 7 - 20, t) for i, t in enumerate(TEXTS)] + [(8, "a b c"), (8, "a b c"), (None, "n")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id bigint, text string, start int, shard string")
    got = sorted(map(tuple, encoded_documents(df, FILE, unit).collect()), key=lambda r: r[1])
    library, start, want = Tokenizer.from_file(FILE), 0, []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for doc, text in order:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_documents_over_many_chunks_and_no_rows(spark):
    text = "abc def " * 60_000
    df = spark.createDataFrame([(1, text), (2, "x"), (3, text)], "doc_id bigint, text string")
    got = sorted(map(tuple, encoded_documents(df, FILE).collect()))
    ids = [*Tokenizer.from_file(FILE).encode(text, add_special_tokens=False).ids, 2]
    assert len(ids) > planes.CHUNK
    crc = zlib.crc32(np.array(ids, "<u4").tobytes())
    assert got[0] == (1, 0, len(ids), crc) and got[2] == (3, len(ids) + 2, len(ids), crc)
    assert encoded_documents(df.limit(0), FILE).collect() == []
