import random

from stintwise.llm.near_dedup import CHUNKS, ERRORS, chunk_keys, near_duplicates

import numpy as np

SCHEMA = "doc_id bigint, text string, size string, id string, cluster string, key string"


def brute(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    n = len(rows)
    comp = list(range(n))
    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and comp[i] != comp[j]:
                old = comp[i]
                comp = [comp[j] if c == old else c for c in comp]
    low = {}
    for c, (doc, _) in zip(comp, rows, strict=True):
        low[c] = min(low.get(c, doc), doc)
    return sorted(
        (doc, len(s), low[c], doc == low[c])
        for (doc, _), s, c in zip(rows, sets, comp, strict=True)
    )


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []

    def add(words):
        rows.append((len(rows) * 3 + 1, " ".join(words)))

    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(40, 300))
        add(base)
        for _ in range(rng.randint(1, 8)):
            changed = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                changed[rng.randrange(len(base))] = rng.choice(vocabulary)
            add(changed)
    big = rng.choices(vocabulary, k=60)
    for _ in range(300):  # a group beyond one block, most of it just not linked
        changed = list(big)
        for _ in range(rng.randint(1, 5)):
            changed[rng.randrange(len(big))] = rng.choice(vocabulary)
        add(changed)
    for text in ("", " \t\n", "one", "One", "one two", "a b c d e", "A B\x0bC d E", "x " * 40_000):
        rows.append((len(rows) * 3 + 1, text))
    rows.append((len(rows) * 3 + 1, None))
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    got = sorted(map(tuple, near_duplicates(df).collect()))
    assert got == brute(rows)


def test_null_ids_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame(
        [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "A b c d e f")],
        "doc_id bigint, text string",
    )
    got = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    assert got == [(4, 2, 4, True), (4, 2, 4, True), (9, 2, 4, False), (None, 2, None, True)]
    assert near_duplicates(df.limit(0)).collect() == []


def test_signatures_within_the_guaranteed_distance_share_a_key():
    rng = np.random.default_rng(3)
    reach = CHUNKS * (ERRORS + 1) - 1
    one = rng.integers(0, 2**16, (200, 64)).astype(np.uint16)
    two = one.copy()
    for row in two:
        row[rng.choice(64, reach, replace=False)] += 1
    a, b = chunk_keys(one), chunk_keys(two)
    assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))
