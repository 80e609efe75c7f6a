"""Phrase collocations by set-oriented mining (SETM) over stored occurrence relations.

The occurrence relation of length k says at which place of which piece a frequent k-word phrase
starts. It is kept sorted by piece and place, in blocks: the places of whole pieces of one language one
after another, with a gap between pieces. A round

1. merge-joins the relation with itself on (piece, place + 1): places stand next to each other in a
   block, so that join is a shift by one and moves nothing;
2. counts the groups, once inside the block and then by a grouped sum, and keeps those of at least
   `least` occurrences;
3. semi-joins the relation with them before the next length, by a bit map of fixed size with a bit for
   each kept group: it drops no kept group and almost all others. What else it leaves cannot be part
   of a phrase that is kept later, since no phrase occurs more often than its parts.

Words and phrases go by 64-bit hashes. Every round looks whether two that matter share one; if so, all is
done again with other hashes, so results are exact.

Only distinct phrases of blocks are shuffled, never occurrences; a phrase or a language that holds a
large share of all words is one row a block. A long text is cut between pieces; one piece stays whole.
"""

import functools
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.llm.batches import give_back, short_batches
from stintwise.llm.shingles import mix
from stintwise.session import work_table

LEAST, LONGEST, TOP = 30, 4, 2000
SCALE, COVERED = 2_000_000, 80
BLOCK = 800_000
"""Words of a block; a piece is never cut, so a longer piece makes a longer block."""
UNKNOWN_LANGUAGE = "und"
PARTS = 64
"""Parts of a language whose best rows are taken apart before the last ranking."""

BREAK = 10
GAP = -1
TABLE = bytearray(range(256))
for _byte in b".,;:!?\n\x0b\x0c\r":
    TABLE[_byte] = BREAK
for _byte in range(ord("A"), ord("Z") + 1):
    TABLE[_byte] = _byte + 32
TABLE[9] = 32
TABLE = bytes(TABLE)

ROWS = 50_000
"""Groups of a block that leave a task together."""

BITS = 26
"""The bit map has 2**26 bits, 8 MB, whatever the number of phrases."""
SEEDS = 8

# A stored relation has a row with the places of each block, and rows with what stands there.
# Places hold the block's own numbers of what stands there, `GAP` for nothing, and `ids` tells them.
WORDS = "lang string, places binary, ids binary, id bigint, word string, count bigint"
PAIRS = "places binary, ids binary, id bigint, mark int"
BLOCKS = "places binary, ids binary"


def rows_of(schema: str, **columns: list | np.ndarray | str | None) -> Iterator[pa.RecordBatch]:
    """Record batches of `ROWS` rows at most; a plain string is the same in all rows, and what is left
    out is null."""
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    size = next(len(c) for c in columns.values() if not isinstance(c, str))
    for start in range(0, size, ROWS):
        n = min(ROWS, size - start)
        out = {}
        for name, kind in (f.split() for f in schema.split(", ")):
            value = columns.get(name)
            if value is None:
                out[name] = pa.nulls(n, types[kind])
            else:
                part = [value] * n if isinstance(value, str) else value[start : start + n]
                out[name] = pa.array(part, types[kind])
        yield pa.record_batch(out)


class Writer:
    """The growing blocks of one language in a task: words as local numbers, `GAP` between pieces."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.places = array("i")

    def add(self, line: list[bytes]) -> None:
        numbers = self.numbers
        found = [numbers.setdefault(w, len(numbers)) for w in line if w]
        if found:
            found.append(GAP)
            self.places.extend(found)

    def take(self) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Places, words and the words' counts."""
        places = np.array(self.places, dtype=np.int32)
        counts = np.bincount(places[places >= 0], minlength=len(self.numbers))
        return places, list(self.numbers), counts


def word_blocks(docs: DataFrame, seed: int) -> DataFrame:
    """The relation of length 1, as `WORDS`. A block is of one language; ids are of word and language."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writers: dict[str, Writer] = {}
        held = 0

        def rows(name: str) -> Iterator[pa.RecordBatch]:
            places, words, counts = writers.pop(name).take()
            mark = name.encode() + b"\x00"
            hashed = xxhash.xxh64_intdigest
            ids = np.array([hashed(mark + w, seed) for w in words], np.uint64).view(np.int64)
            yield from rows_of(WORDS, lang=name, places=[places.tobytes()], ids=[ids.tobytes()])
            yield from rows_of(WORDS, lang=name, id=ids, word=[w.decode() for w in words], count=counts)

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                raw = text.as_py()
                if not raw:
                    continue
                name = lang.as_py()
                for line in raw.encode().translate(TABLE).split(b"\n"):
                    if not line:
                        continue
                    writer = writers.get(name)
                    if writer is None:
                        writer = writers[name] = Writer()
                    before = len(writer.places)
                    writer.add(line.split(b" "))
                    held += len(writer.places) - before
                    if not writer.places:
                        del writers[name]
                    elif held > BLOCK:
                        largest = max(writers, key=lambda n: len(writers[n].places))
                        held -= len(writers[largest].places)
                        yield from rows(largest)
        for name in list(writers):
            yield from rows(name)
        give_back()

    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANGUAGE)).alias("lang"),
        F.col("text").cast("string").alias("text"),
    )
    return texts.mapInArrow(run, WORDS)


def bits_at(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, bit) of each id in a map of 2**size bits: its highest bits tell."""
    at = ids.view(np.uint64) >> np.uint64(64 - size)
    return (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)


def bit_map(groups: DataFrame) -> np.ndarray:
    """The bit map of all ids of `groups`, as 64-bit words."""
    size = BITS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << (size - 6), np.uint64)
        for batch in batches:
            word, bit = bits_at(batch.column("id").to_numpy(), size)
            np.bitwise_or.at(found, word, np.uint64(1) << bit)
        at = np.flatnonzero(found)
        yield pa.record_batch({"at": at, "bits": found[at].view(np.int64)})
        give_back()

    parts = groups.select("id").mapInArrow(run, "at bigint, bits bigint")
    rows = parts.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # 2**20 rows at most
    words = np.zeros(1 << (size - 6), np.int64)
    words[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return words.view(np.uint64)


def passes(bits: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """Which ids have their bit set."""
    word, bit = bits_at(ids, size)
    return ((bits[word] >> bit) & np.uint64(1)).astype(bool)


def semi_joined(relation: DataFrame, groups: DataFrame) -> DataFrame:
    """The blocks, with gaps where the bit map of `groups` rules a phrase out. Of a run of gaps one is
    left."""
    shared = relation.sparkSession.sparkContext.broadcast(bit_map(groups))
    size = BITS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, ids in block_arrays(batch):
                stays = passes(shared.value, ids, size)
                number = np.append(np.where(stays, np.cumsum(stays) - 1, GAP), GAP).astype(np.int32)
                left = number[places]  # a gap (-1) reads the last one
                met = left != GAP
                if not met.any():
                    continue
                keep = met.copy()
                keep[1:] |= met[:-1]
                yield from rows_of(BLOCKS, places=[left[keep].tobytes()], ids=[ids[stays].tobytes()])
        give_back()

    return blocks_of(relation).mapInArrow(run, BLOCKS)


def blocks_of(relation: DataFrame) -> DataFrame:
    return relation.where("places is not null").select("places", "ids")


def block_arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places and ids of each block."""
    for places, ids in zip(batch.column("places"), batch.column("ids"), strict=True):
        yield np.frombuffer(places.as_buffer(), np.int32), np.frombuffer(ids.as_buffer(), np.int64)


def block_pairs(
    places: np.ndarray, ids: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block joined with itself on (piece, place + 1): the places where pairs stand, the number of the
    pair at each, and the distinct pairs' first and last phrases and counts."""
    at = np.flatnonzero((places[:-1] != GAP) & (places[1:] != GAP))
    key = places[at].astype(np.int64) * len(ids) + places[at + 1]
    order = np.argsort(key, kind="stable")
    new = np.ones(len(at), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    first = np.flatnonzero(new)
    number = np.empty(len(at), np.int32)
    number[order] = np.cumsum(new) - 1
    pairs = key[order[first]]
    counts = np.diff(first, append=len(at))
    return at, number, ids[pairs // max(len(ids), 1)], ids[pairs % max(len(ids), 1)], counts


def pair_counts(relation: DataFrame) -> DataFrame:
    """(left, right, count): for each block its pairs of phrases of k words that make one of k + 1 words,
    its first and its last k words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, ids in block_arrays(batch):
                *_, left, right, counts = block_pairs(places, ids)
                for start in range(0, len(counts), ROWS):
                    part = slice(start, start + ROWS)
                    yield pa.record_batch({"left": left[part], "right": right[part], "count": counts[part]})
        give_back()

    return blocks_of(relation).mapInArrow(run, "left bigint, right bigint, count bigint")


def pair_ids(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The id of each phrase that begins with `left` and ends with `right`, one word longer."""
    step = np.uint64(0x9E3779B97F4A7C15)
    return mix(mix(left.view(np.uint64) + step) * step + right.view(np.uint64)).view(np.int64)


def extended(relation: DataFrame, groups: DataFrame) -> DataFrame:
    """The relation of one word more, as `PAIRS`: where pairs stand that the bit map of the frequent
    `groups` does not rule out, and once a block those pairs' ids, each with 32 more bits of the pair
    that tell pairs of one id apart."""
    shared = relation.sparkSession.sparkContext.broadcast(bit_map(groups))
    size = BITS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for old, names in block_arrays(batch):
                at, number, left, right, _ = block_pairs(old, names)
                ids = pair_ids(left, right)
                stays = passes(shared.value, ids, size)
                if not stays.any():
                    continue
                places = np.full(len(old), GAP, dtype=np.int32)
                places[at] = np.where(stays, np.cumsum(stays) - 1, GAP)[number]
                ids, mark = ids[stays], pair_ids(right[stays], left[stays]).astype(np.int32)
                yield from rows_of(PAIRS, places=[places.tobytes()], ids=[ids.tobytes()])
                yield from rows_of(PAIRS, id=ids, mark=mark)
        give_back()

    return blocks_of(relation).mapInArrow(run, PAIRS)


def named_pairs(counted: DataFrame) -> DataFrame:
    """(left, right, a) with their ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pair_ids(batch.column("left").to_numpy(), batch.column("right").to_numpy())
            yield batch.append_column("id", pa.array(ids))

    return counted.mapInArrow(run, "left bigint, right bigint, a bigint, id bigint")


def joined_names(pairs: DataFrame, shorter: DataFrame) -> DataFrame:
    """The pairs as phrases: language, words, last word, and the counts of all their beginnings
    (`heads`, shortest first) and endings (`tails`, shortest first), themselves included."""
    left = shorter.select(F.col("id").alias("left"), "lang", "phrase", "heads")
    right = shorter.select(F.col("id").alias("right"), "last", "tails")
    return (
        pairs.join(left, "left")
        .join(right, "right")
        .select(
            "id",
            "left",
            "right",
            "a",
            "lang",
            F.concat_ws(" ", "phrase", "last").alias("phrase"),
            "last",
            F.concat("heads", F.array("a")).alias("heads"),
            F.concat("tails", F.array("a")).alias("tails"),
        )
    )


class SharedHash(Exception):
    """Two phrases that matter have one id."""


def mined(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, seed: int = 0
) -> tuple[list[DataFrame], DataFrame]:
    """(phrases, totals): for each length from 2 to `longest` the phrases with at least `least`
    occurrences (id, left, right, a, lang, phrase, heads, tails; `left` and `right` are ids of the
    length below), and each language's number n of word occurrences."""
    relation = work_table(word_blocks(docs, seed), "words")
    counted = work_table(
        relation.where("id is not null").groupBy("lang", "word", "id").agg(F.sum("count").alias("a")),
        "counts",
    )
    totals = counted.groupBy("lang").agg(F.sum("a").alias("n"))
    one_id = counted.groupBy("id").agg(F.count("*").alias("words"), F.sum("a").alias("a"))
    if not one_id.where((F.col("words") > 1) & (F.col("a") >= least)).isEmpty():
        raise SharedHash
    frequent = counted.where(F.col("a") >= least)
    own = F.array("a")
    shorter = frequent.select(
        "id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), own.alias("heads"), own.alias("tails")
    )
    relation = work_table(semi_joined(relation, frequent), "places")
    kept = []
    for length in range(2, longest + 1):
        pairs = pair_counts(relation).groupBy("left", "right").agg(F.sum("count").alias("a"))
        frequent = work_table(named_pairs(pairs.where(F.col("a") >= least)), "pairs")
        shorter = work_table(joined_names(frequent, shorter), "phrases")
        kept.append(shorter)
        if length < longest:
            longer = work_table(extended(relation, frequent), "occurrences")
            marks = longer.where("id is not null").groupBy("id").agg(F.min("mark").alias("a"), F.max("mark").alias("b"))
            if not marks.where("a != b").isEmpty():
                raise SharedHash
            relation = longer
    return kept, totals


def outlasting(phrases: DataFrame, longer: DataFrame | None) -> DataFrame:
    """Phrases of one length without those that a phrase one word longer covers. What holds a phrase
    at greater length has every phrase between them inside and no more occurrences than that, so one
    word more is all that needs a look."""
    if longer is None:
        return phrases
    most = (
        longer.select(F.explode(F.array("left", "right")).alias("id"), F.col("a").alias("most"))
        .groupBy("id")
        .agg(F.max("most").alias("most"))
    )
    covered = F.col("most").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * COVERED
    return phrases.join(most.alias("m"), "id", "left").where(~F.coalesce(covered, F.lit(False))).drop("most")


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score): each phrase at its lowest-scoring cut, of equal ones the
    first. Decimals of 38 digits keep products of 64-bit counts exact."""

    def wide(c: Column) -> Column:
        return c.cast("decimal(20,0)")

    def cut(k: Column) -> Column:
        l, r = F.element_at("heads", k), F.element_at("tails", F.size("heads") - k)
        over = wide(F.col("a")) * F.lit(SCALE).cast("decimal(7,0)")
        score = F.call_function("div", over, wide(l) + wide(r))
        return F.struct(score.alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    cuts = F.transform(F.sequence(F.lit(1), F.size("heads") - 1), cut)
    return phrases.select("lang", "phrase", "a", F.array_min(cuts).alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score"
    )


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP
) -> DataFrame:
    """The best phrases of each language of `docs` (text, lang): lang, rank, phrase, a, l, r, n, score.

    ASCII capitals are lower-cased; texts are split at `. , ; : ! ?` and line ends into pieces, those at
    spaces and tabs into words. Candidates are phrases of 2 to `longest` words with `least` occurrences
    inside pieces. Of the cuts after the first k words, l and r being the occurrences of the parts, the
    one with the least floor(2000000*a/(l+r)) counts. A candidate goes if a longer one that holds it
    has 80 % of its occurrences.

    A null text is empty; a null language is `und`, with the rows that say so. Repeated rows count as
    often as they stand. Equal scores rank by occurrences, then by the phrase's bytes. Texts without
    candidates, or an empty table, give no rows. Other columns are not read. One piece, a run without
    separators, is held whole by one task; all else is cut.
    """
    for seed in range(SEEDS):
        try:
            with short_batches(docs.sparkSession):  # a block is a row
                kept, totals = mined(docs, least, longest, seed)
            break
        except SharedHash:
            continue
    else:
        raise RuntimeError("hashes of phrases are shared whatever the seed")
    rows = [scored(outlasting(p, q)) for p, q in zip(kept, [*kept[1:], None], strict=True)]
    found = functools.reduce(DataFrame.unionByName, rows)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    few = found.withColumn(
        "_place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*best))
    ).where(F.col("_place") <= top)  # at most PARTS * top rows of a language are left
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint")
    return (
        few.withColumn("rank", rank)
        .where(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
