import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stintwise.llm import collocations as C
from stintwise.llm.batches import short_batches

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, longest=4, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(
                len(q) > len(p)
                and 100 * b >= 80 * a
                and any(q[i : i + len(p)] == p for i in range(len(q)))
                for q, b in found.items()
            ):
                continue
            score, k = min(
                (2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))
            )
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def got(spark, rows, schema=SCHEMA, **options):
    found = C.collocations(spark.createDataFrame(rows, schema).repartition(3), **options)
    return sorted(tuple(r) for r in found.collect())


def texts(seed, count, words):
    draw = random.Random(seed)
    stock = [f"w{i}" for i in range(words)] + ["été", "Ünder", "a b", "\x00", "B"]
    marks = [" ", "  ", "\t", ". ", ", ", ";", "\n", "\x0b", "\r\n", " ! "]
    return [
        (
            i,
            "".join(
                draw.choice(stock) + draw.choices(marks, [12, 2, 1, 1, 1, 1, 1, 1, 1, 1])[0]
                for _ in range(draw.randrange(60))
            ),
            draw.choice(["en", "de", None, "und"]),
        )
        for i in range(count)
    ]


@pytest.mark.parametrize("least", [2, 5])
def test_equals_brute_force(spark, monkeypatch, least):
    rows = texts(least, 150, 12)
    rows += [(900 + i, "one two three four. two three, three four five", "en") for i in range(8)]
    monkeypatch.setattr(C, "BLOCK", 500)
    want = brute(rows, least)
    assert len(want) > 50
    assert got(spark, rows, least=least) == want


def test_top_of_a_language_and_ties(spark):
    rows = texts(3, 120, 8)
    assert got(spark, rows, least=2, top=7) == brute(rows, 2, top=7)


def test_overlapping_repeats_and_one_hot_phrase(spark):
    rows = [(1, "x x x x x x", "en"), (1, "x x x x x x", "en"), (2, "go on " * 5000, "en")]
    assert got(spark, rows, least=3) == brute(rows, 3)


def test_nulls_empty_texts_empty_tables_and_clashing_columns(spark):
    rows = [(None, None, None), (1, "", "en"), (2, " .,\n", None)]
    assert got(spark, rows, least=1) == []
    assert got(spark, [], least=1) == []
    schema = SCHEMA + ", block string, places int, words string, a int, phrase string"
    more = [(3, "a b", None, "q", 1, "w", 7, "z"), (3, "A b", "und", None, 1, "w", 7, "z")]
    assert got(spark, more, schema, least=2) == [("und", 1, "a b", 2, 2, 2, 4, 1_000_000)]


def test_counts_whose_products_pass_64_bits(spark):
    big = 9_000_000_000_000_000_000
    rows = [(1, "en", "a b", big, [big, big], [big, big])]
    frame = spark.createDataFrame(
        rows, "id long, lang string, phrase string, a long, heads array<long>, tails array<long>"
    )
    assert C.scored(frame).first()["score"] == 1_000_000


def test_long_text_is_cut_between_pieces(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 100)
    text = ", ".join(f"w{i % 7} w{i % 3} w{i % 5}" for i in range(3000))
    assert got(spark, [(1, text, "en")], least=30) == brute([(1, text, "en")], 30)


def test_a_full_bit_map_changes_nothing(spark, monkeypatch):
    rows = texts(8, 120, 10)
    monkeypatch.setattr(C, "BITS", 7)  # every bit is set: nothing is ruled out
    assert got(spark, rows, least=2) == brute(rows, 2)


def test_shared_hashes_are_seen_and_others_taken(spark, monkeypatch):
    rows = texts(9, 60, 10)
    seeds = []
    plain = C.word_blocks

    def poor(docs, seed):
        seeds.append(seed)
        found = plain(docs, seed)
        return found.withColumn("id", F.col("id") * 0) if seed < 2 else found

    monkeypatch.setattr(C, "word_blocks", poor)
    assert got(spark, rows, least=2) == brute(rows, 2)
    assert seeds == [0, 1, 2]


def test_a_batch_holds_few_blocks(spark):
    """Blocks are rows of megabytes: what goes to a Python worker at once is bounded by bytes, and the
    session is afterwards as it was."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(0, 12, 1, 1).selectExpr("repeat('a', 1500000) AS places")

    def held(batches):
        for batch in batches:
            yield pa.record_batch({"n": [batch.num_rows]})

    with short_batches(spark):
        assert max(r.n for r in rows.mapInArrow(held, "n long").collect()) <= 2
    assert spark.conf.get(name) == before
    seen = []
    real = C.work_table
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(C, "work_table", lambda df, label: (seen.append(spark.conf.get(name)), real(df, label))[1])
        got(spark, texts(5, 20, 4), least=2)
    assert len(set(seen)) == 1 and seen[0] != before and spark.conf.get(name) == before
