"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders, one for a run of names or numbers, so
a question that was given other figures or names keeps its template. Texts are read with the
title-case words that start sentences, or sentences and lines, as plain words and as names. Windows of templates are hash-joined, and the values in the
slots of a match must agree: equal values of the item stand for equal values of the text.
"""

import functools
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.llm.batches import map_pieces
from stintwise.llm.shingles import mix

WINDOW = 8  # template words of a window; an item of 5 to 7 is one window, a shorter one none
LEAST = 5
EXACT = 3  # words of the shortest item that is looked for, word for word
LITERAL = 4  # words of a window that are no placeholders, at least
RUN = 13  # covered words that tell a leak; half of a shorter item does too
KNOWN = 2_000_000  # window hashes sent to the tasks at most (16 MB); beyond, Spark joins all windows
MEMO = 200_000

UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l kb mb gb tb ms s sec min h hr hrs w kw v a "
    "hz khz mhz ghz c f k pa kpa bar % percent meter meters metre metres kilometer kilometers "
    "kilometre kilometres mile miles foot feet inch inches yard yards gram grams kilogram kilograms "
    "pound pounds ounce ounces ton tons liter liters litre litres second seconds minute minutes hour "
    "hours day days week weeks month months year years dollar dollars euro euros cent cents".split()
)
_NUMBER = re.compile(r"[+\-]?\d+(?:[.,:/]\d+)*", re.ASCII)
_MEASURE = re.compile(r"[$€£]?[+\-]?\d+(?:[.,:/]\d+)*([^\W\d_]+|%|°|€)?")
_SIDES = re.compile(r"^[\W_]+|[\W_]+$")
_PLACES = np.array(
    [xxhash.xxh64_intdigest(b"slot", seed=k) | 1 for k in range(WINDOW)], dtype=np.uint64
)
WRITTEN = 1 << 32  # sets windows of words as written apart from templates
NUMBER, NAME, UNIT, MEASURE = (xxhash.xxh64_intdigest(x) for x in (b"#n", b"#name", b"#u", b"#nu"))
_PLAIN, _NUM, _TITLE, _UNIT, _MEAS = range(5)


class Words:
    """What is known of a written word by itself: its core, the hash of the core in lower case, its
    kind, and whether it ends a sentence."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.core: list[str] = []
        self.hash: list[int] = []
        self.kind: list[int] = []
        self.stop: list[bool] = []

    def add(self, word: str) -> int:
        core = _SIDES.sub("", word) or word
        low = core.lower()
        kind = _PLAIN
        if _NUMBER.fullmatch(core):
            kind = _MEAS if _MEASURE.fullmatch(word.strip(".,;!?")) and word[0] in "$€£" else _NUM
        elif core[0].isdigit() and _MEASURE.fullmatch(core):
            kind = _MEAS
        elif low in UNITS:
            kind = _UNIT
        elif len(core) > 1 and core[0].isupper() and not core.isupper():
            kind = _TITLE
        n = self.index[word] = len(self.core)
        self.core.append(low)
        self.hash.append(xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")))
        self.kind.append(kind)
        self.stop.append(word.rstrip("\"')]»”*#$%&")[-1:] in set(".!?:"))
        return n

    def look_up(self, words: list[str]) -> np.ndarray:
        found = list(map(self.index.get, words))
        if None in found:
            get, add = self.index.get, self.add
            found = [add(w) if (i := get(w)) is None else i for w in words]
        return np.array(found, np.int64)


class Tokens(NamedTuple):
    """Template words of texts that stand one after another: hash, whether a placeholder, the first
    written word and the end of the words that stand in it, and whether it reads otherwise under the
    plain reading."""

    hash: np.ndarray
    slot: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    differs: np.ndarray


def templates(ids: np.ndarray, first: np.ndarray, line: np.ndarray, words: Words) -> list[Tokens]:
    """Three readings of texts. `first` marks the first word of each text, `line` that of each line.
    In the plain one a title-case word is a name unless a sentence starts there, in the second
    unless a sentence or a line does, in the last it always is. A unit counts after a number only.
    Names next to each other in a sentence are one placeholder, and so are numbers."""
    kind = np.array(words.kind, np.int8)[ids]
    plain = np.array(words.hash, np.uint64)[ids]
    stop = np.array(words.stop, bool)[ids]
    start = first.copy()
    start[1:] |= stop[:-1]
    after = np.zeros(len(ids), bool)
    after[1:] = (kind[:-1] == _NUM) & ~first[1:]
    title = kind == _TITLE
    readings = []
    broken = start | line
    for name, starts, other in (
        (title & ~start, start, np.zeros(len(ids), bool)),
        (title & ~broken, broken, (title | (kind == _NUM)) & line),
        (title, start, title & start),
    ):
        out = plain.copy()
        slot = np.zeros(len(ids), bool)
        for here, value in (
            (kind == _NUM, NUMBER),
            (name, NAME),
            ((kind == _UNIT) & after, UNIT),
            (kind == _MEAS, MEASURE),
        ):
            out[here] = value
            slot |= here
        head = np.ones(len(ids), bool)
        for here in (kind == _NUM, name):
            head[1:] &= ~(here[1:] & here[:-1]) | starts[1:]
        begin = np.flatnonzero(head)
        differs = np.add.reduceat(other, begin) > 0
        readings.append(Tokens(out[begin], slot[begin], begin, np.append(begin[1:], len(ids)), differs))
    return readings


def window_hashes(hashed: np.ndarray, here: dict[int, np.ndarray], mark: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, index, hash) of the windows of each width of `here`, ascending, at the places that `here` marks
    for it. A window's sum is that of the next narrower one and one term more, so all widths together
    cost what the widest does."""
    widths = sorted(here)
    if not widths:
        return
    # Few places are gathered, many are summed up where they lie.
    wanted = functools.reduce(np.logical_or, here.values())
    at = np.flatnonzero(wanted)
    dense = 4 * len(at) > len(hashed)
    total = np.zeros(len(hashed) if dense else len(at), np.uint64)
    done = 0
    for width in widths:
        for k in range(done, width):
            if dense:
                total[: max(len(hashed) - k, 0)] += hashed[k:] * _PLACES[k]
            else:
                total += hashed[np.minimum(at + k, len(hashed) - 1)] * _PLACES[k]
        done = width
        index = np.flatnonzero(here[width])
        part = total[index] if dense else total[here[width][at]]
        yield width, index, mix(part + np.uint64(mark + width)).view(np.int64)


class Known:
    """The sorted hashes that are looked for, with a bit for the highest bits of each: it rules out most
    others before they are searched for."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        size = min(max(len(hashes), 1).bit_length() + 5, 24)
        self.shift = np.uint64(64 - size)
        self.marked = np.zeros(1 << size, bool)
        self.marked[hashes.view(np.uint64) >> self.shift] = True

    def among(self, mixed: np.ndarray) -> np.ndarray:
        """The places of `mixed` that hold one of the hashes."""
        near = np.flatnonzero(self.marked[mixed.view(np.uint64) >> self.shift])
        found = mixed[near]
        at = np.minimum(np.searchsorted(self.hashes, found), max(len(self.hashes) - 1, 0))
        return near[self.hashes[at] == found] if len(self.hashes) else near[:0]


def window_rows(
    docs: DataFrame,
    keys: list[str],
    widths: list[int],
    known: np.ndarray | None,
    exact: list[int] | None = None,
) -> DataFrame:
    """(keys, hash, width, at, size, slots, n_words, late): the template windows of every text, or
    only those whose hash is among the sorted `known`. `width` counts placeholders, `size` written
    words; `slots` are the placeholders' values in their order. `late` windows are those that read
    otherwise if names may start a sentence.

    Windows of words as written follow, negative in `width` and without slots: those of the `exact`
    sizes; without these, those of texts that are short or not covered by template windows, and of
    whole texts that are smaller."""
    kinds = {key: "string" if dict(docs.dtypes)[key] == "string" else "bigint" for key in keys}
    schema = "".join(f"{key} {kind}, " for key, kind in kinds.items())
    schema += "hash bigint, width int, at int, size int, slots array<string>, n_words int, late boolean"
    sent = None if known is None else docs.sparkSession.sparkContext.broadcast(known)

    def make():
        words = Words()
        among = None if sent is None else Known(sent.value)

        def step(piece: pa.RecordBatch) -> pa.RecordBatch | None:
            if len(words.core) > MEMO:
                words.clear()
            written: list[str] = []
            sizes, lines = [], []
            for t in piece.column("text").to_pylist():
                before = len(written)
                for part in (t or "").split("\n"):
                    lines.append(len(written))
                    written += part.split()
                sizes.append(len(written) - before)
            n = np.array(sizes, np.int64)
            ids = words.look_up(written)
            if not len(ids):
                return None
            line = np.zeros(len(ids) + 1, bool)
            line[lines] = True
            ends = np.cumsum(n)
            first = np.zeros(len(ids) + 1, bool)
            first[ends - n] = True
            owner = np.repeat(np.arange(len(n)), n)
            core = words.core
            parts = []
            covered = np.zeros(len(ids) + 1, np.int64)

            def among_known(index: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                if among is None:
                    return index, mixed
                hit = among.among(mixed)
                return index[hit], mixed[hit]

            for reading, tokens in enumerate(templates(ids, first[:-1], line[:-1], words)):
                if reading and not tokens.differs.any():
                    continue
                many = len(tokens.begin)
                text = owner[tokens.begin]
                left = np.cumsum(np.bincount(text, minlength=len(n)))[text] - np.arange(many)
                literal = np.concatenate([[0], np.cumsum(~tokens.slot)])
                differs = np.concatenate([[0], np.cumsum(tokens.differs)])
                marked = {}
                for width in widths:
                    till = np.minimum(np.arange(many) + width, many)
                    here = left >= width
                    here &= literal[till] - literal[:-1] >= min(LITERAL, width - 1)
                    if reading:
                        here &= differs[till] > differs[:-1]
                    marked[width] = here
                for width, index, mixed in window_hashes(tokens.hash, marked):
                    index, mixed = among_known(index, mixed)
                    slots = [
                        [
                            " ".join([core[j] for j in ids[tokens.begin[p] : tokens.end[p]]])
                            for p in range(i, i + width)
                            if tokens.slot[p]
                        ]
                        for i in index.tolist()
                    ]
                    at = tokens.begin[index]
                    size = tokens.end[index + width - 1] - at
                    late = np.full(len(index), reading == 2)
                    parts.append((mixed, np.full(len(index), width), at, size, slots, late))
                    if exact is None and not reading:
                        good = (width == WINDOW) | (size == n[owner[at]])
                        np.add.at(covered, at[good], 1)
                        np.add.at(covered, (at + size)[good], -1)
            plain = np.array(words.hash, np.uint64)[ids]
            left = np.repeat(ends, n) - np.arange(len(ids))
            open_ = np.ones(len(n), bool)
            if exact is None:
                bare = np.bincount(owner[np.cumsum(covered[:-1]) == 0], minlength=len(n)) > 0
                open_ = bare | (n <= RUN)
            marked = {}
            for width in range(EXACT, WINDOW + 1) if exact is None else exact:
                here = left >= width
                if exact is None:
                    here &= (open_ & ((n == width) | (width == WINDOW)))[owner]
                marked[width] = here
            for width, index, mixed in window_hashes(plain, marked, WRITTEN):
                index, mixed = among_known(index, mixed)
                size = np.full(len(index), width)
                parts.append((mixed, -size, index, size, [[]] * len(index), np.zeros(len(index), bool)))
            mixed, width, at, size, slots, late = zip(*parts, strict=True)
            at = np.concatenate(at)
            if not len(at):
                return None
            own = owner[at]
            return pa.RecordBatch.from_arrays(
                [
                    *[piece.column(key).take(pa.array(own)) for key in keys],
                    pa.array(np.concatenate(mixed)),
                    pa.array(np.concatenate(width), pa.int32()),
                    pa.array(at - (ends - n)[own], pa.int32()),
                    pa.array(np.concatenate(size), pa.int32()),
                    pa.array([s for part in slots for s in part], pa.list_(pa.string())),
                    pa.array(n[own], pa.int32()),
                    pa.array(np.concatenate(late)),
                ],
                [*keys, "hash", "width", "at", "size", "slots", "n_words", "late"],
            )

        return step

    rows = docs.select(*[F.col(key).cast(kinds[key]) for key in keys], F.col("text").cast("string"))
    return map_pieces(rows, make, schema)


class Match(NamedTuple):
    """A window of an item and an equal one of a text: first words, numbers of words, the values in
    the slots of either, and whether a name may start a sentence in the item's."""

    item_at: int
    item_size: int
    at: int
    size: int
    item_slots: tuple[str, ...]
    slots: tuple[str, ...]
    late: bool


def clashes(matches: list[Match]) -> set[str]:
    """Values of the item that stand for several values of the text."""
    seen: dict[str, str] = {}
    return {
        a
        for m in matches
        for a, b in zip(m.item_slots, m.slots, strict=True)
        if seen.setdefault(a, b) != b
    }


def runs(matches: list[Match]) -> list[list[Match]]:
    """Matches of one alignment, ascending, in runs without a word of the item between them."""
    out: list[list[Match]] = []
    end = -1
    for m in matches:
        if m.item_at > end:
            out.append([])
        out[-1].append(m)
        end = max(end, m.item_at + m.item_size)
    return out


def covered_words(matches: list[Match]) -> int:
    return len({w for m in matches for w in range(m.item_at, m.item_at + m.item_size)})


def units(matches: list[Match]) -> list[list[Match]]:
    """What may count of the matches of one alignment: all if every value of the item stands for one
    value; else, without the windows that hold a value that stands for several, run by run. Runs
    that stand word for word count whatever is found beside them."""
    bad = clashes(matches)
    if not bad:
        return [matches]
    return runs([m for m in matches if bad.isdisjoint(m.item_slots)]) + runs(
        [m for m in matches if m.item_slots == m.slots]
    )


def chains(parts: list[list[Match]], item_words: int) -> Iterator[list[Match]]:
    """Units of different alignments that follow one another in item and text and agree on what the
    item's values stand for. No longer gap than the item has words is bridged."""
    spans = sorted(
        (
            (
                min(m.at for m in part),
                min(m.item_at for m in part),
                max(m.at + m.size for m in part),
                max(m.item_at + m.item_size for m in part),
            ),
            i,
        )
        for i, part in enumerate(parts)
    )
    for n, ((_, at, end, item_end), i) in enumerate(spans):
        chain = list(parts[i])
        shift = chain[0].at - chain[0].item_at
        for (start, item_at, till, item_till), j in spans[n + 1 :]:
            if start > end + item_words:
                break
            next_shift = parts[j][0].at - parts[j][0].item_at
            if next_shift == shift or item_at < at or till <= end or item_till <= item_end:
                continue
            if clashes(chain + parts[j]):
                continue
            chain += parts[j]
            at, end, item_end, shift = item_at, till, item_till, next_shift
        if len(chain) > len(parts[i]):
            yield chain


def judged(matches: list[Match], item_words: int) -> tuple[int, int, int] | None:
    """(at_word, n_windows, covered) of the best covered, then earliest place of a text that leaks
    the item; None if none does. Alignments are put together only if none suffices alone."""
    by_shift: dict[int, list[Match]] = {}
    for m in sorted(matches):
        by_shift.setdefault(m.at - m.item_at, []).append(m)
    parts = []
    for alignment in by_shift.values():
        parts += units(alignment)
        early = [m for m in alignment if not m.late]
        if 0 < len(early) < len(alignment):
            parts += units(early)

    def best(of: Iterable[list[Match]]) -> tuple[int, int, int] | None:
        told = []
        for part in of:
            n = covered_words(part)
            if n >= RUN or 2 * n >= item_words:
                told.append((-n, min(m.at for m in part), len({(m.item_at, m.at) for m in part})))
        if not told:
            return None
        n, at, many = min(told)
        return at, many, -n

    return best(parts) or best(chains(parts, item_words))


def judged_rows(met: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_words, at_word, n_windows, covered) of every leaking row of `met`."""
    names = ["doc_id", "row", "item_id", "item_words"]
    places = ["at_word", "n_windows", "covered"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, found = [], []
            for i in range(batch.num_rows):
                matches = [
                    Match(
                        m["item_at"],
                        m["item_size"],
                        m["at"],
                        m["size"],
                        tuple(m["item_slots"]),
                        tuple(m["slots"]),
                        m["late"],
                    )
                    for m in batch.column("matches")[i].as_py()
                ]
                best = judged(matches, batch.column("item_words")[i].as_py())
                if best is not None:
                    kept.append(i)
                    found.append(best)
            if kept:
                at = pa.array(kept)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(name).take(at) for name in names],
                        *[pa.array(c, pa.int32()) for c in zip(*found, strict=True)],
                    ],
                    [*names, *places],
                )

    schema = "doc_id bigint, row string, item_id bigint, item_words int, at_word int, n_windows int, covered int"
    return met.select(*names, "matches").mapInArrow(run, schema)


def row_leaks(docs: DataFrame, items: DataFrame, known: int = KNOWN) -> DataFrame:
    """As `leaks`, a row for each leaking text of a doc_id; `row` has 128 bits of the text, which tell
    rows that share a doc_id, or have none, apart."""
    unique = items.groupBy("text").agg(F.min("item_id").alias("item_id"))
    widths = [WINDOW, *range(LEAST, WINDOW)]
    whole = window_rows(unique, ["item_id"], widths, None)
    # Narrow windows stand for whole short items only.
    own = whole.where(f"width = {WINDOW} or width < 0 or size = n_words").select(
        "item_id",
        "hash",
        "width",
        F.col("at").alias("item_at"),
        F.col("size").alias("item_size"),
        F.col("slots").alias("item_slots"),
        F.col("n_words").alias("item_words"),
        "late",
    )
    used = {r[0] for r in own.select("width").distinct().collect()}  # ten rows at most
    widths = sorted({WINDOW} | {w for w in used if w > 0})
    exact = sorted(-w for w in used if w < 0)
    wanted = own.select("hash").distinct()
    sent = None
    if wanted.limit(known + 1).count() <= known:
        sent = np.sort(np.array([r[0] for r in wanted.toLocalIterator()], np.int64))
    texts = docs.select("doc_id", "text", F.md5("text").alias("row"))
    found = window_rows(texts, ["doc_id", "row"], widths, sent, exact).drop("n_words", "late")
    match = F.struct("item_at", "item_size", "at", "size", "item_slots", "slots", "late")
    met = (
        found.join(own, ["hash", "width"])
        .groupBy("doc_id", "row", "item_id", "item_words")
        .agg(F.collect_set(match).alias("matches"))
    )
    return judged_rows(met)


def leaks(docs: DataFrame, items: DataFrame, known: int = KNOWN) -> DataFrame:
    """(doc_id, item_id, at_word, n_windows, covered, item_words): where `docs` (doc_id, text, any
    more) hold an item of `items` (item_id, text, any more), verbatim or with other figures, names
    or units. A match runs along one alignment of item and text; it is a leak if its windows cover
    13 words or half of the item and each value of the item stands for one value of the text. Where
    one stands for several, the windows that hold it are dropped and each run of the others must
    cover as much by itself, as may a run that is the item word for word. If no alignment suffices,
    those that follow one another and agree are added up. Of several the best covered, then
    earliest, is told.

    Texts that are null, empty or shorter than three words match nothing; items of three or four
    words match word for word. Items of 13 words or less, and those that names and figures leave
    without template windows somewhere, are looked for word for word too. Items with equal texts
    count as the one with the smallest item_id; rows that share a doc_id are matched each by itself
    and told once, also those without one. Other columns are not read. An empty side gives an empty
    result."""
    best = F.min_by(
        F.struct("at_word", "n_windows", "covered"), F.struct(-F.col("covered"), F.col("at_word"))
    )
    found = row_leaks(docs, items, known).groupBy("doc_id", "item_id", "item_words")
    return found.agg(best.alias("best")).select("doc_id", "item_id", "best.*", "item_words")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no item, all columns as they are. Each row is judged by its own text:
    a leaking row goes if it has no doc_id, too, and does not take others with its doc_id along."""
    found = row_leaks(docs, items).select("doc_id", "row").distinct()
    same = docs["doc_id"].eqNullSafe(found["doc_id"]) & (F.md5(docs["text"]) == found["row"])
    return docs.join(found, same, "left_anti")
