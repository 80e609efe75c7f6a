import itertools
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from stintwise.llm import sampling
from stintwise.llm.lattice import SPACE, Lattices, Vocabulary
from stintwise.llm.queries import op1_sentencepiece_gumbel_topk
from stintwise.llm.sampling import decoded, draw, sampled_segmentations

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(MODEL)


def every(vocabulary, text):
    """All segmentations with their probabilities, by plain recursion over the whole text."""
    weight = {}
    for table in vocabulary.tables:
        if table:
            weight |= {vocabulary.pieces[i]: s for i, s in zip(table[1].tolist(), table[2], strict=True)}
    marked = SPACE + text.replace(" ", SPACE)

    def ways(at):
        if at == len(marked):
            yield (), 0.0
        for end in range(at + 1, min(len(marked), at + vocabulary.longest) + 1):
            piece = marked[at:end]
            if piece in weight:
                head, score = (piece,), weight[piece]
            elif end == at + 1:
                raw = piece.encode()
                head, score = tuple(f"<0x{b:02X}>" for b in raw), vocabulary.byte_score * len(raw)
            else:
                continue
            for rest, more in ways(end):
                yield head + rest, score + more

    found = dict(ways(0))
    total = math.log(sum(math.exp(s) for s in found.values()))
    return {k: v - total for k, v in found.items()}


def lattice_draw(vocabulary, text, seed, k):
    lattices = Lattices(vocabulary)
    nodes = lattices.look_up(vocabulary.chunks(text))
    ((paths, threshold),) = draw(lattices, [nodes], [seed], k)
    names = [tuple(vocabulary.pieces[i] for i in lattices.ids(p.edges)) for p in paths]
    return names, paths, threshold


@pytest.fixture(autouse=True, params=[-30.0, -1.0])
def head(request, monkeypatch):
    """With a short head most regions are opened late."""
    monkeypatch.setattr(sampling, "HEAD", request.param)


@pytest.mark.parametrize("text", ["abc", "a\n b", "to  be", "né\x01 日ꙮ", "the then"])
def test_all_segmentations_come_once_with_their_probability(vocabulary, text):
    want = every(vocabulary, text)
    names, paths, threshold = lattice_draw(vocabulary, text, 5, len(want) + 3)
    assert len(set(names)) == len(names)
    assert set(names) == set(want) and threshold == -np.inf
    for name, path in zip(names, paths, strict=True):
        assert path.log_prob == pytest.approx(want[name], abs=1e-9)
    scores = [p.score for p in paths]
    assert scores == sorted(scores, reverse=True)


def test_ordered_pairs_are_drawn_without_replacement(vocabulary):
    text = "abc"
    p = {k: math.exp(v) for k, v in every(vocabulary, text).items()}
    pairs, runs = Counter(), 12_000
    lattices = Lattices(vocabulary)
    nodes = lattices.look_up(vocabulary.chunks(text))
    for paths, _ in draw(lattices, [nodes] * runs, [i * 7717 + 3 for i in range(runs)], 2):
        pairs[tuple(tuple(vocabulary.pieces[i] for i in lattices.ids(x.edges)) for x in paths)] += 1
    for a, b in itertools.permutations(p, 2):
        want = p[a] * p[b] / (1 - p[a])
        assert abs(pairs[a, b] / runs - want) < 4.5 * math.sqrt(want / runs) + 1e-3


def test_chunks_join_to_the_text_and_decode_equals_the_library(vocabulary):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in ["", " ", "a  b", "\n\nx\n y", "a\x01b c", SPACE + "a", "été 日本\t", " lead"]:
        assert "".join(vocabulary.chunks(text)) == (SPACE + text.replace(" ", SPACE) if text else "")
        ids = library.encode(text)
        assert vocabulary.decode(ids).decode() == library.decode(ids)


def test_many_samples_of_a_long_text(vocabulary):
    text = "the long river ran by the old stone bridge, and on. " * 12 + "ꙮ" * 40
    names, paths, _ = lattice_draw(vocabulary, text, 9, 60)
    assert len(set(names)) == 60
    joined = {"".join(n for n in name if not n.startswith("<0x")) for name in names}
    assert joined == {SPACE + text.replace(" ", SPACE).replace("ꙮ", "")}
    scores = [p.score for p in paths]
    assert scores == sorted(scores, reverse=True)


ROWS = [(1, "Hello there, world.\nAgain"), (2, ""), (3, None), (None, "x"), (4, "no space" * 2000)]


def test_rows_decode_to_their_texts_and_do_not_depend_on_the_partition(spark):
    rows = [*ROWS, ROWS[0]]
    df = spark.createDataFrame(
        [(*r, 1, [1]) for r in rows], "doc_id bigint, text string, rank int, ids array<int>"
    )
    got = decoded(sampled_segmentations(df, MODEL), MODEL).collect()
    texts = dict(ROWS)
    for r in got:
        assert r["decoded"] == (texts[r["doc_id"]] or "").replace(SPACE, " ")
        assert r["n_pieces"] == len(r["ids"]) and r["log_inclusion"] <= 0
    key = lambda r: (str(r["doc_id"]), r["rank"], r["ids_crc32"], r["log_prob"], r["perturbed"])
    again = sampled_segmentations(df.repartition(5), MODEL).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))
    counts = Counter(r["doc_id"] for r in got)
    assert counts[1] == 6 and counts[2] == counts[3] == 1 and counts[4] == 3
    assert sampled_segmentations(df.limit(0), MODEL).collect() == []


def test_the_query_returns_the_ids_that_it_sums_up(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Hello there, world."), (2, None)], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = op1_sentencepiece_gumbel_topk(spark, str(tmp_path)).collect()
    assert len(got) == 4
    for r in got:
        assert r["n_pieces"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
