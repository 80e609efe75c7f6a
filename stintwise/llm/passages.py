"""Removal of repeated passages: every byte that a 50-byte string covers which also starts in a
document with a smaller doc_id.

The strings are brought together by content. The least hash among a window's 20-byte substrings is
its key, so equal windows have equal keys wherever they stand, and windows next to each other that
share a key make one segment of at most 80 bytes.

1. Segments go to buckets by key as fingerprints. A segment that stands in a smaller document as a
   whole is removed there and then; what was said of it in the smallest document, its owner, holds
   for all.
2. Owners whose key occurs in several documents with different segments send their bytes. Each
   bucket of them is a collection of short strings for the Burrows-Wheeler transform; a run of rows
   with common prefixes of 50 bytes or more is one window and the documents it starts in.
3. Spans found in either way go back to their documents and are cut out.

A key with very many different segments is cut into single windows known by their own fingerprint.
Spark takes the smallest document of each, partly before the shuffle, and joins it back, so a window
of very many documents makes no collection. Fingerprints have 64 bits; a segment is
known by the key and the fingerprints of its first and last window, which cover it.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.llm.batches import map_groups, map_pieces, pieces
from stintwise.llm.bwt import collection_bwt, first_to_last
from stintwise.llm.shingles import mix
from stintwise.session import work_table

LENGTH = 50
SEED_BYTES = 20
REACH = LENGTH - SEED_BYTES + 1  # substrings in a window, and windows in a segment at most
HOT = 50_000  # owners' segments of one key beyond which they are cut into windows
BUCKET = 4_000_000  # bytes of text whose segments make one bucket
COLLECTION = 1_000_000  # bytes of segments that make one collection
TEXTS = 1_000_000
SHORT = 100_000  # bytes of texts that are cut into segments together: their arrays stay in the caches
BLOCK = 1 << 14
FLUSH = 500_000

_BASE = 0x9E3779B97F4A7C15
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b]), 3) for b in range(256)], np.uint64)


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + LENGTH, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def rolling(text: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Fingerprints of all substrings of each of the ascending `sizes`, LENGTH at most: polynomials in
    `_BASE`, as differences of running sums over blocks of the text."""
    out = [np.empty(max(len(text) - size + 1, 0), np.uint64) for size in sizes]
    sums = np.zeros(BLOCK + LENGTH, np.uint64)
    for a in range(0, len(text), BLOCK):
        part = text[a : a + BLOCK + sizes[-1] - 1]
        np.cumsum(_BYTES[part] * _DOWN[: len(part)], out=sums[1 : len(part) + 1])
        for size, prints in zip(sizes, out, strict=True):
            m = min(BLOCK, len(part) - size + 1)
            if m > 0:
                np.subtract(sums[size : size + m], sums[:m], out=prints[a : a + m])
                prints[a : a + m] *= _UP[size - 1 : size - 1 + m]
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    out, size = values, 1
    while size < width:
        step = min(size, width - size)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        size += step
    return out


def segment_prints(windows: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The fingerprint of segments that start at `start` and have `n` windows."""
    last = windows[start + n - 1]
    return mix(windows[start] + mix(last + np.uint64(1)) + n.astype(np.uint64))


def segments(text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start, n, key, print) of the segments of documents that stand one after another
    in `text`; `start` counts from the document's begin, `n` is the number of windows."""
    ends = np.cumsum(lengths)
    none = np.zeros(0, np.int64)
    if len(text) < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    small, windows = rolling(text, [SEED_BYTES, LENGTH])
    key = sliding_least(mix(small), REACH)
    # No window goes over a document's end, and no run of windows with one key does.
    over = (ends[ends < len(text)][:, None] - np.arange(1, LENGTH)).ravel()
    valid = np.ones(len(windows), bool)
    valid[over[(over >= 0) & (over < len(windows))]] = False
    fresh = np.ones(len(windows), bool)
    fresh[1:] = (key[1:] != key[:-1]) | ~valid[:-1]
    begin = np.flatnonzero(fresh)
    many = (np.diff(begin, append=len(windows)) + REACH - 1) // REACH
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    start = np.repeat(begin, many) + nth * REACH
    start = start[valid[start]]
    # A segment ends where the next starts or its document's windows end.
    stop = np.append(start[1:], len(windows))
    document = np.searchsorted(ends, start, side="right")
    stop = np.minimum(stop, (ends - LENGTH + 1)[document])
    n = stop - start
    return document, start - (ends - lengths)[document], n, key[start], segment_prints(windows, start, n)


def repeated(ordered: np.ndarray) -> np.ndarray:
    """Whether an ordered value stands there more than once."""
    out = np.zeros(len(ordered), bool)
    same = ordered[1:] == ordered[:-1]
    out[1:] |= same
    out[:-1] |= same
    return out


def held_by_smaller(
    key: np.ndarray, mark: np.ndarray, doc: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, same, later): entries sorted by key, print and document; the group number of equal
    segments; and whether a smaller document has the segment."""
    order = np.argsort(key)
    k = key[order]
    at = np.flatnonzero(repeated(k))
    some = order[at]
    order[at] = some[np.lexsort((doc[some], mark[some], key[some]))]
    m, d = mark[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    same = np.cumsum(new) - 1
    owner = d[new]
    return order, same, d > owner[same]


PRINTS = "bucket int, spans boolean, key binary, mark binary, doc binary, start binary, n binary"
FIELDS = (("key", np.uint64), ("mark", np.uint64), ("doc", np.int64), ("start", np.int32), ("n", np.uint8))


def packed(bucket: int, spans: bool, columns: list[np.ndarray]) -> list:
    raw = [c.astype(t).tobytes() for c, (_, t) in zip(columns, FIELDS, strict=True)]
    return [bucket, spans, *raw]


def print_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """Segments as fingerprints, many in a row. Segments that a smaller document of the same task
    has too are told apart as spans, so that a passage of very many documents goes to its bucket
    once for each half million segments at most."""
    names = [name for name, _ in FIELDS]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            key, mark, doc, start, n = (np.concatenate(c) for c in zip(*held, strict=True))
            order, _, later = held_by_smaller(key, mark, doc)
            columns = [c[order] for c in (key, mark, doc, start, n)]
            home = (columns[0] % np.uint64(buckets)).astype(np.int64)
            home[later] = columns[2][later] % buckets
            group = home * 2 + later
            by = np.argsort(group.astype(np.uint16) if buckets < 1 << 15 else group, kind="stable")
            cuts = np.flatnonzero(np.diff(group[by], prepend=-1))
            rows = []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)], strict=True):
                at = by[a:b]
                one = int(group[at[0]])
                rows.append(packed(one // 2, bool(one % 2), [c[at] for c in columns]))
            types = [pa.int32(), pa.bool_(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                ["bucket", "spans", *names],
            )

        for batch in batches:
            for piece in pieces(batch, "text", SHORT):
                raw = [t or b"" for t in piece.column("text").cast(pa.binary()).to_pylist()]
                lengths = np.array([len(x) for x in raw], np.int64)
                document, start, n, key, mark = segments(
                    np.frombuffer(b"".join(raw), np.uint8), lengths
                )
                doc = piece.column("doc_id").to_numpy()[document]
                if len(doc):
                    held.append((key, mark, doc, start, n))
                    count += len(doc)
                if count >= FLUSH:
                    yield flush()
                    held.clear()
                    count = 0
        if held:
            yield flush()

    return docs.mapInArrow(run, PRINTS)


FOUND = "ask boolean, doc bigint, start int, n int, key bigint, mark bigint"


def settle(rows: pa.Table) -> pa.RecordBatch:
    """What a run of whole buckets tells: spans to remove, and owners whose bytes are asked for."""
    spans = rows.column("spans").to_numpy(zero_copy_only=False)

    def unpacked(which: np.ndarray) -> list[np.ndarray]:
        part = rows.filter(pa.array(which))
        return [
            np.frombuffer(b"".join(part.column(name).to_pylist()), t) for name, t in FIELDS
        ]

    key, mark, doc, start, n = unpacked(~spans)
    order = np.argsort(key)
    order = order[repeated(key[order])]  # a key that stands once has nothing to tell
    key, mark, doc, start, n = (c[order] for c in (key, mark, doc, start, n))
    order, same, later = held_by_smaller(key, mark, doc)
    key, mark, doc, start, n = (c[order] for c in (key, mark, doc, start, n))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    by_key = np.cumsum(first) - 1
    ask = ~later
    if len(key):
        at = np.flatnonzero(first)
        low, high = np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)
        kinds = np.add.reduceat(np.diff(same, prepend=-1), at)
        ask &= ((low < high) & (kinds > 1))[by_key]
    keep = ask | later
    old = unpacked(spans)
    columns = [
        np.concatenate([c[keep], o]) for c, o in zip((key, mark, doc, start, n), old, strict=True)
    ]
    asked = np.concatenate([ask[keep], np.zeros(len(old[0]), bool)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(asked),
            pa.array(columns[2]),
            pa.array(columns[3], pa.int32()),
            pa.array(columns[4].astype(np.int32)),
            pa.array(columns[0].view(np.int64)),
            pa.array(columns[1].view(np.int64)),
        ],
        ["ask", "doc", "start", "n", "key", "mark"],
    )


def cut_segments(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, doc, start, bytes): the asked segments of each document. A segment is cut only from a
    text that has its fingerprint there, so texts that share a doc_id do not mix. Segments of `hot`
    keys come as single windows under their own fingerprints, without bytes."""
    wanted = asked.groupBy(F.col("doc").alias("doc_id")).agg(
        F.collect_list(F.struct("start", "n", "mark", "key", "hot")).alias("asked")
    )

    def make():
        def step(piece: pa.RecordBatch) -> pa.RecordBatch | None:
            keys, docs_, starts, cuts = [], [], [], []
            asked = piece.column("asked")
            fields = asked.flatten()
            start, n, mark, key, hot = (
                fields.field(i).to_numpy(zero_copy_only=False) for i in range(5)
            )
            mark = mark.view(np.uint64)
            at = 0
            for doc, text, many in zip(
                piece.column("doc_id").to_pylist(),
                piece.column("text").to_pylist(),
                asked.value_lengths().to_pylist(),
                strict=True,
            ):
                raw = (text or "").encode("utf-8", "surrogatepass")
                mine = slice(at, at + many)
                at += many
                s, m, k, h = start[mine], n[mine], key[mine], hot[mine]
                good = s + m + LENGTH - 1 <= len(raw)
                if not good.any():
                    continue
                windows = rolling(np.frombuffer(raw, np.uint8), [LENGTH])[0]
                good[good] = segment_prints(windows, s[good], m[good]) == mark[mine][good]
                for i in np.flatnonzero(good).tolist():
                    a, size, own = int(s[i]), int(m[i]), int(k[i])
                    for b in range(a, a + size) if h[i] else (a,):
                        keys.append(int(windows[b].view(np.int64)) if h[i] else own)
                        docs_.append(doc)
                        starts.append(b)
                        cuts.append(None if h[i] else raw[a : a + size + LENGTH - 1])
            if not keys:
                return None
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array(docs_, pa.int64()),
                    pa.array(starts, pa.int32()),
                    pa.array(cuts, pa.binary()),
                ],
                ["key", "doc", "start", "bytes"],
            )

        return step

    return map_pieces(
        docs.select("doc_id", "text").join(wanted, "doc_id"),
        make,
        "key bigint, doc bigint, start int, bytes binary",
        "text",
        TEXTS,
    )


def each(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, inside) of the parts of things that have `n` parts each."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def window_runs(strings: list[bytes]) -> np.ndarray:
    """For the windows of all strings, one after another, the number of their run of rows with common
    prefixes of a window's length, from the transform."""
    lengths = np.array([len(x) for x in strings], np.int64)
    bwt, lcp, whole = collection_bwt(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lengths))
    shorter = first_to_last(bwt, len(strings))
    n = lengths - LENGTH + 1
    at = np.empty(n.sum(), np.int64)
    row, live = whole, np.arange(len(strings))
    offset = np.cumsum(n) - n
    for k in range(int(n.max(initial=0))):
        live = live[n[live] > k]
        at[offset[live] + k] = row[live]
        row = shorter[row]
    return np.cumsum(lcp < LENGTH)[at]


def collection_spans(rows: pa.Table) -> pa.RecordBatch:
    """Spans of windows that also start in a smaller document, from the transform of a collection of
    segments. A window whose fingerprint no other document has can be in no span, so segments go
    into the collection from their first to their last window that may be in two documents, each
    string once."""
    raw = rows.column("bytes").to_pylist()
    doc, start = rows.column("doc").to_numpy(), rows.column("start").to_numpy()
    lengths = np.array([len(x) for x in raw], np.int64)
    begin = np.cumsum(lengths) - lengths
    windows = rolling(np.frombuffer(b"".join(raw), np.uint8), [LENGTH])[0]
    n = lengths - LENGTH + 1
    owner, inside = each(n)
    prints = windows[begin[owner] + inside]
    order = np.argsort(prints)
    new = np.flatnonzero(np.diff(prints[order], prepend=~prints[order[:1]]))
    docs = doc[owner[order]]
    many = np.minimum.reduceat(docs, new) < np.maximum.reduceat(docs, new)
    shared = np.empty(len(prints), bool)
    shared[order] = np.repeat(many, np.diff(new, append=len(order)))
    offset = np.cumsum(n) - n
    first = np.minimum.reduceat(np.where(shared, inside, REACH), offset)
    last = np.maximum.reduceat(np.where(shared, inside, -1), offset)
    live = np.flatnonzero(last >= 0)
    doc, start, begin, first, last = (c[live] for c in (doc, start, begin, first, last))
    found: dict[bytes, int] = {}
    string = np.array(
        [
            found.setdefault(raw[i][a : b + LENGTH], len(found))
            for i, a, b in zip(live.tolist(), first.tolist(), last.tolist(), strict=True)
        ],
        np.int64,
    )
    run = window_runs(list(found))
    n = last - first + 1
    size = np.empty(len(found), np.int64)
    size[string] = n
    owner, inside = each(n)
    run = run[(np.cumsum(size) - size)[string[owner]] + inside]
    least = np.full(int(run.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, run, doc[owner])
    hit = least[run] < doc[owner]
    edge = hit.copy()
    edge[1:] &= ~hit[:-1] | (owner[1:] != owner[:-1])
    at = np.flatnonzero(edge)
    part = np.cumsum(edge)[hit] - 1
    size = np.bincount(part, minlength=len(at))
    own, place = owner[at], first[owner[at]] + inside[at]
    marks = segment_prints(windows, begin[own] + place, size)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc[own]),
            pa.array((start[own] + place).astype(np.int32)),
            pa.array(size.astype(np.int32)),
            pa.array(marks.view(np.int64)),
        ],
        ["doc", "start", "n", "mark"],
    )


SPANS = "doc bigint, start int, n int, mark bigint"


def window_spans(windows: DataFrame) -> DataFrame:
    """Spans of single windows (key, doc, start) that also start in a smaller document, by their
    fingerprints `key`. The smallest document is found by a partial aggregate; adaptive execution
    may split the join where one window has very many rows."""
    least = windows.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    later = windows.join(least.where("low < high"), "key").where("doc > low")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy().view(np.uint64)
            one = np.ones(len(key), np.int64)
            mark = segment_prints(key, np.arange(len(key)), one)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    batch.column("start"),
                    pa.array(one, pa.int32()),
                    pa.array(mark.view(np.int64)),
                ],
                ["doc", "start", "n", "mark"],
            )

    return later.select("key", "doc", "start").mapInArrow(run, SPANS)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, start, n, mark): windows start..start+n-1 of document `doc` also start in a smaller
    document; `mark` is their fingerprint. Spans may meet or overlap."""
    texts = docs.where("doc_id is not null and octet_length(text) >= 50").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, total // BUCKET)
    found = work_table(
        map_groups(print_rows(texts, buckets), ["bucket"], settle, FOUND, "key", 1),
        "segments",
    )
    asked = found.where("ask")
    crowd = asked.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > HOT)
    asked = asked.join(crowd, "key", "left").withColumn("hot", F.col("many").isNotNull())
    size = asked.groupBy("hot").agg(F.sum(F.col("n") + LENGTH))
    sizes = {r[0]: r[1] for r in size.collect()}
    groups = max(64, sizes.get(False, 0) // COLLECTION)
    cut = cut_segments(texts, asked.where("not hot")).withColumn(
        "collection", F.pmod("key", F.lit(groups))
    )
    shared = work_table(
        map_groups(
            cut.select("collection", "doc", "start", "bytes"),
            ["collection"],
            collection_spans,
            SPANS,
            "bytes",
            1,
        ),
        "spans",
    )
    spans = found.where("not ask").select("doc", "start", "n", "mark").unionByName(shared)
    if True not in sizes:
        return spans
    single = cut_segments(texts, asked.where("hot")).select("key", "doc", "start")
    hot = work_table(window_spans(work_table(single, "windows")), "hot")
    return spans.unionByName(hot)


def cut_out(raw: bytes, start: np.ndarray, n: np.ndarray, mark: np.ndarray) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed) of a text under its spans. Spans whose
    fingerprint is not found at their place belong to another text of the same doc_id."""
    good = start + n + LENGTH - 1 <= len(raw)
    if not good.any():
        return raw, 0, 0
    text = np.frombuffer(raw, np.uint8)
    windows = rolling(text, [LENGTH])[0]
    good[good] = segment_prints(windows, start[good], n[good]) == mark[good]
    depth = np.zeros(len(raw) + 1, np.int64)
    np.add.at(depth, start[good], 1)
    np.add.at(depth, start[good] + n[good] + LENGTH - 1, -1)
    gone = np.cumsum(depth[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return text[~gone].tobytes(), int(gone.sum()), runs


def without_repeats(docs: DataFrame) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept): for every row of `docs` (doc_id, text, any more) the
    row itself as a struct, the size of its text in UTF-8, what is removed, in how many maximal
    runs, and the remaining bytes.

    Null and empty texts have no bytes. Rows without a doc_id are passed over: nothing is removed
    from them or because of them. Repeated rows are cut alike; rows that share a doc_id are never
    held against each other. The first row among equals by doc_id keeps its text. An empty table
    gives an empty result."""
    spans = (
        repeated_spans(docs)
        .groupBy(F.col("doc").alias("_doc"))
        .agg(F.collect_list(F.struct("start", "n", "mark")).alias("spans"))
    )
    rows = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("bigint").alias("_doc"),
        F.col("text").cast("string").alias("_text"),
    ).join(spans, "_doc", "left")
    schema = f"row {rows.schema['row'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, "

    def make():
        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple[int, int, int, bytes]] = []
            for text, spans in zip(
                piece.column("_text").to_pylist(), piece.column("spans"), strict=True
            ):
                raw = (text or "").encode("utf-8", "surrogatepass")
                kept, removed, runs = raw, 0, 0
                if spans.is_valid:
                    fields = spans.values.flatten()
                    start, n, mark = (f.to_numpy().astype(np.int64) for f in fields)
                    kept, removed, runs = cut_out(raw, start, n, mark.view(np.uint64))
                out.append((len(raw), removed, runs, kept))
            n_bytes, removed, runs, kept = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays(
                [
                    piece.column("row"),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(runs, pa.int64()),
                    pa.array(kept, pa.binary()),
                ],
                ["row", "n_bytes", "n_removed", "n_spans", "kept"],
            )

        return step

    return map_pieces(
        rows.select("row", "_text", "spans"), make, schema + "n_spans bigint, kept binary", "_text"
    )


def cut_documents(docs: DataFrame) -> DataFrame:
    """`docs` with repeated passages cut from `text`, and `n_chars`, if there, counted anew. What a
    cut leaves of a character goes with it; a null text stays null."""
    cut = without_repeats(docs).select("row.*", F.col("kept").alias("_kept"))
    names = docs.columns
    schema = docs.schema

    def make():
        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            old = piece.column("text").is_null().to_pylist()
            texts = [
                None if gone else kept.decode("utf-8", "ignore")
                for kept, gone in zip(piece.column("_kept").to_pylist(), old, strict=True)
            ]
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                sizes = [None if t is None else len(t) for t in texts]
                new["n_chars"] = pa.array(sizes, piece.column("n_chars").type)
            return pa.RecordBatch.from_arrays([new.get(c, piece.column(c)) for c in names], names)

        return step

    return map_pieces(cut, make, schema, "_kept")
