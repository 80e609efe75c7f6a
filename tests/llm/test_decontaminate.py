import random

import numpy as np

from stintwise.llm.decontaminate import _PLACES, WRITTEN, Known, clean, leaks, window_hashes
from stintwise.llm.shingles import mix

ITEMS = [
    (1, "A train leaves Berlin at 40 km per hour and Anna waits 15 minutes for it at the gate."),
    (2, "If 12 boxes hold 7 kg of salt each and 12 boxes are sold, how much is left in the store?"),
    (3, "Short words of five here"),
    (4, "no way"),
    (5, ""),
    (6, None),
    (7, "A train leaves Berlin at 40 km per hour and Anna waits 15 minutes for it at the gate."),
]
NOISE = "then we went on to talk about some other thing that day in the rain".split()


def docs():
    rng = random.Random(2)
    pad = lambda: " ".join(rng.choices(NOISE, k=30)) + ". "
    return [
        (10, pad() + ITEMS[0][1] + " " + pad()),
        (11, pad() + ITEMS[0][1].replace("Berlin", "Paris").replace("40", "65").replace("Anna", "Ben")),
        (12, pad() + ITEMS[1][1].replace("12", "90")),
        # the same template, yet one value of the item would stand for two: not this question
        (13, pad() + "If 12 boxes hold 7 kg of salt each and 13 boxes are sold, how much is left in the store?"),
        (14, pad()),
        (15, pad() + ITEMS[1][1].upper() + "!! " + pad()),
        (16, pad() + "short WORDS of, five here " + pad()),
        (17, pad() + "no way no way"),
        (18, ""),
        (19, None),
        (20, ITEMS[0][1][:20]),
        (21, "x " * 30_000 + ITEMS[0][1]),
        (None, ITEMS[0][1]),
    ]


WANT = {(10, 1), (11, 1), (12, 2), (15, 2), (16, 3), (21, 1), (None, 1)}


def test_leaks_and_slots_either_way_of_joining(spark):
    left = spark.createDataFrame(
        [(*r, 1, "h") for r in docs()], "doc_id bigint, text string, item_id int, hash string"
    )
    left = left.unionByName(left.where("doc_id = 11"))  # a repeated row
    right = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for known in (1_000_000, 0):
        rows = leaks(left, right, known).collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows} == WANT
        assert len(rows) == len(WANT)
    at = {r["doc_id"]: r for r in leaks(left, right).collect()}
    assert at[10]["at_word"] == 30 and at[10]["covered"] == at[10]["item_words"] == 19
    kept = clean(left, right).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["13", "14", "17", "18", "19", "20"]


def test_rows_are_judged_one_by_one(spark):
    leak, plain = ITEMS[0][1], "nothing that any of the items holds"
    rows = [(None, leak, 1), (None, plain, 2), (7, leak, 3), (7, plain, 4), (7, plain, 5), (8, None, 6)]
    left = spark.createDataFrame(rows, "doc_id bigint, text string, row int")
    right = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert sorted(r["row"] for r in clean(left, right).collect()) == [2, 4, 5, 6]


LONG = (
    "The baker sold 5 loaves in the early morning before the school bus came down the hill and then "
    "sold 5 more loaves in the late afternoon when all of the children walked slowly home again"
)
PEARS = "Someone has 3 apples and 5 pears in a bag and then eats 3 apples at home with a friend"


def found(spark, docs, items):
    left = spark.createDataFrame(docs, "doc_id bigint, text string")
    right = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]) for r in leaks(left, right).collect()}


def test_one_changed_value_or_equal_new_values_or_a_shared_id(spark):
    items = [(1, LONG), (2, PEARS)]
    docs = [
        (1, LONG.replace("sold 5 more", "sold 6 more")),
        (2, PEARS.replace("3", "4").replace("5", "4")),
        (3, PEARS.replace("3", "7").replace("5", "8")),
        (3, PEARS.replace("3", "1").replace("5", "2")),
        (None, PEARS.replace("3", "7").replace("5", "8")),
        (None, PEARS.replace("3", "1").replace("5", "2")),
    ]
    assert found(spark, docs, items) == {(1, 1), (2, 2), (3, 2), (None, 2)}


ANNA = "Anna has 5 apples and 3 pears. Ben gives her 4 more. Carol takes 2 away. What is left?"
SHIFTED = (
    "Near the old gate Ada left 12,000 coins for her brother and walked to Rome before the sun went "
    "down behind Ivo and the hills"
)


def test_names_that_start_sentences_and_names_of_several_words(spark):
    items = [(1, ANNA), (2, ITEMS[0][1]), (3, SHIFTED)]
    anna = "Tom has 6 apples and 2 pears. Lisa gives her 3 more. Paul takes 1 away. What is left?"
    berlin = ITEMS[0][1].replace("Berlin", "New York").replace("Anna", "Anna Maria")
    coins = SHIFTED.replace("12,000", "15 000").replace("Rome", "Tel Aviv").replace("Ivo", "Li Wei")
    docs = [(1, "We were told: " + anna), (2, "So it went on. " + berlin), (3, coins)]
    # words put in between break the item into three alignments of 12 words
    words = LONG.split()
    parts = [words[:12], ["so", "they", "say"], words[12:24], ["as", "well"], words[24:]]
    docs.append((4, " ".join(sum(parts, []))))
    assert len(words) == 36
    assert found(spark, docs, [*items, (4, LONG)]) == {(1, 1), (2, 2), (3, 3), (4, 4)}


def test_items_of_few_plain_words_short_items_and_lines(spark):
    items = [
        (1, "What comes next: 2 3 5 8 13 21 34 55?"),
        (2, "What is the capital of France?"),
        (3, "Name three planets now"),
        (4, "Who wrote Hamlet?"),
        (5, "Where does Anna live now?"),
        (6, "Anna Ben Carol Dan Eve Frank Gil Hal Ida Jon Kim Leo Max Ned Ole Pia sing"),
    ]
    docs = [(i, f"Quiz night\n{text}\nThe end") for i, text in items]
    docs.append((7, "Quiz night\nWhere does Tom live now?\nThe end"))
    docs.append((8, "Nothing to see in here at all, is there?"))
    assert found(spark, docs, items) == {(i, i) for i in range(1, 7)} | {(7, 5)}


def test_verbatim_passages_equal_brute_force(spark):
    """On the given tables: every document that holds an item word for word, and no other."""
    folder = "/root/testdata/sf0.01"
    left = spark.read.parquet(f"{folder}/documents.parquet")
    right = spark.read.parquet(f"{folder}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in leaks(left, right).collect()}
    plain = lambda t: " " + " ".join(w.strip(".,!?*#$%&|").lower() for w in t.split()) + " "
    items = [(i, plain(t)) for i, t in right.select("item_id", "text").collect()]
    want = set()
    for doc, text in left.select("doc_id", "text").collect():
        held = plain(text)
        want |= {(doc, i) for i, t in items if t in held}
    assert got == want and want


def test_no_rows(spark):
    left = spark.createDataFrame(docs(), "doc_id bigint, text string")
    right = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert leaks(left.limit(0), right).collect() == []
    assert leaks(left, right.limit(0)).collect() == []


def test_window_hashes_add_up_over_widths():
    rng = np.random.default_rng(5)
    hashed = rng.integers(0, 2**63, 400).astype(np.uint64) * np.uint64(2)
    for share in (0.02, 0.9):
        here = {w: (rng.random(400) < share) & (np.arange(400) <= 400 - w) for w in (8, 5, 6)}
        told = list(window_hashes(hashed, here, WRITTEN))
        assert [width for width, *_ in told] == [5, 6, 8]
        for width, index, mixed in told:
            assert index.tolist() == np.flatnonzero(here[width]).tolist()
            for i, value in zip(index.tolist(), mixed.tolist(), strict=True):
                total = WRITTEN + width + sum(int(hashed[i + k]) * int(_PLACES[k]) for k in range(width))
                assert value == mix(np.array([total % 2**64], np.uint64)).view(np.int64)[0]
    assert list(window_hashes(hashed, {})) == []
    assert [len(i) for _, i, _ in window_hashes(hashed[:3], {5: np.zeros(3, bool), 3: np.array([True, False, False])})] == [1, 0]


def test_known_hashes_are_told_by_their_high_bits_first():
    rng = np.random.default_rng(6)
    hashes = np.sort(rng.integers(-(2**63), 2**63 - 1, 3000))
    asked = np.concatenate([hashes[::7], rng.integers(-(2**63), 2**63 - 1, 5000), hashes[:3] + 1])
    assert Known(hashes).among(asked).tolist() == np.flatnonzero(np.isin(asked, hashes)).tolist()
    assert Known(hashes[:0]).among(asked).tolist() == []
