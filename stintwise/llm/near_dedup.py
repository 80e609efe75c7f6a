"""Near-duplicates of documents through a multi-index Hamming join of MinHash signatures.

A signature has `chunks * width` symbols. By the pigeonhole principle two signatures that differ in
at most `chunks * (errors + 1) - 1` symbols have a chunk with at most `errors` differing symbols;
every way to leave out `errors` symbols of a chunk is one key, so such a pair meets under some key.
With 16 chunks of 4 symbols and one error all pairs up to distance 31 of 64 meet; a pair of
similarity 0.75 (16 expected) misses all keys with probability 5e-10. Pairs that meet beyond 31 are
taken as well.

Documents with equal shingle sets are one vertex. Keys gather vertices, clusters gather the vertices
whose signatures are close, and links are confirmed on full sets inside clusters. Buckets and
clusters of any size are cut into blocks, and every pair of blocks is a group of its own; a group
sends on at most one edge per member, never its pairs.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.llm.batches import map_groups, map_pieces
from stintwise.llm.components import components
from stintwise.llm.shingles import WordHashes, min_hashes, mix, shingle_sets
from stintwise.session import work_table

CHUNKS, WIDTH, ERRORS = 16, 4, 1
FAR = 40  # of 64 symbols: beyond, similarity 0.75 has probability 1e-9
PERCENT = 75
BLOCK = 256
EDGE = "src bigint, dst bigint"


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id, signature) of every row. `set_id` is a 128-bit
    digest of the shingle set, `signature` 64 symbols of 16 bits."""
    k = CHUNKS * WIDTH

    def make():
        import hashlib

        memo = WordHashes()

        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            h, ends = shingle_sets(piece.column("text").to_pylist(), memo)
            symbols = min_hashes(h, ends, k)
            starts = np.concatenate([[0], ends[:-1]]).tolist()
            digests = [
                hashlib.md5(h[a:b].tobytes()).digest()
                for a, b in zip(starts, ends.tolist(), strict=True)
            ]
            return pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array(np.diff(ends, prepend=0), pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array([row.tobytes() for row in symbols], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_id", "signature"],
            )

        return step

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return map_pieces(
        rows,
        make,
        "doc_id bigint, n_shingles bigint, set_id binary, signature binary",
    )


def chunk_keys(symbols: np.ndarray) -> np.ndarray:
    """All keys of each signature (a row of symbols): a chunk's number, the places left out, and
    the symbols that stay."""
    out = []
    for c in range(CHUNKS):
        part = symbols[:, c * WIDTH : (c + 1) * WIDTH].astype(np.uint64)
        for e, stay in enumerate(combinations(range(WIDTH), WIDTH - ERRORS)):
            key = np.full(len(part), c * 1000 + e, dtype=np.uint64)
            for place in stay:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part[:, place])
            out.append(key)
    return np.stack(out, axis=1).view(np.int64)


def key_rows(vertices: DataFrame) -> DataFrame:
    """(id, key): a row for every key of every vertex."""

    def make():
        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            raw = b"".join(piece.column("signature").to_pylist())
            keys = chunk_keys(np.frombuffer(raw, np.uint16).reshape(-1, CHUNKS * WIDTH))
            ids = np.repeat(piece.column("id").to_numpy(), keys.shape[1])
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.ravel())], ["id", "key"])

        return step

    return map_pieces(
        vertices.select("id", "signature"), make, "id bigint, key bigint", "signature", 1_000_000
    )


def block_pairs(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Each row once for every pair of blocks its block takes part in: (`key`, `_a`, `_b`) are the
    groups, `_side` is the row's own block. A key of up to BLOCK rows is one group."""
    n = F.ceil(F.col(size) / F.lit(float(BLOCK))).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(17)), F.col("_n")).cast("int")
    return (
        rows.withColumn("_n", n)
        .withColumn("_side", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("_a", F.least("_side", "_other"))
        .withColumn("_b", F.greatest("_side", "_other"))
        .drop("_n", "_other")
    )


def close_pairs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of one group with at most FAR differing symbols, sorted by i. In the
    group of two blocks only pairs across them count."""
    n = rows.num_rows
    raw = b"".join(rows.column("signature").to_pylist())
    symbols = np.frombuffer(raw, np.uint16).reshape(n, -1)
    group = rows.column("_group").to_numpy()
    side = rows.column("_side").to_numpy()
    within = rows.column("_a").to_numpy() == rows.column("_b").to_numpy()
    one, two = [], []
    live = np.arange(n)
    for step in range(1, n):
        live = live[live < n - step]
        live = live[group[live] == group[live + step]]  # rows whose group reaches that far
        if not len(live):
            break
        i = live[within[live] | (side[live] != side[live + step])]
        near = (symbols[i] != symbols[i + step]).sum(axis=1) <= FAR
        one.append(i[near])
        two.append(i[near] + step)
    none = np.zeros(0, np.int64)
    i, j = np.concatenate([none, *one]), np.concatenate([none, *two])
    order = np.argsort(i, kind="stable")
    return i[order], j[order]


def star_edges(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """An edge from every row that the pairs connect to some earlier row, to the first of its part."""
    part = np.arange(len(ids))
    while True:
        low = np.minimum(part[i], part[j])
        new = part.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == part).all():
            break
        part = new
    hung = np.flatnonzero(part != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[part[hung]]), pa.array(ids[hung])], ["src", "dst"])


def bucket_edges(rows: pa.Table) -> pa.RecordBatch:
    """Edges that connect the members of a bucket whose signatures are close."""
    return star_edges(rows.column("id").to_numpy(), *close_pairs(rows))


def cluster_links(rows: pa.Table) -> pa.RecordBatch:
    """Links of a cluster's members, confirmed on full sets; only those that connect."""
    i, j = close_pairs(rows)
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    held = [flat[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    mark = np.zeros(len(flat), np.int64)
    good = np.zeros(len(i), bool)
    starts = np.flatnonzero(np.diff(i, prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(i)], strict=True):
        one, others = int(i[a]), j[a:b]
        mark[held[one]] = 1
        hits = mark[np.concatenate([held[k] for k in others.tolist()])]
        both = np.add.reduceat(hits, np.cumsum(sizes[others]) - sizes[others])
        mark[held[one]] = 0
        good[a:b] = 100 * both >= PERCENT * (sizes[one] + sizes[others] - both)
    return star_edges(rows.column("id").to_numpy(), i[good], j[good])


def full_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """`members` (id, set_id, ...) with the shingles of the text that has this id and set."""
    import hashlib

    def make():
        memo = WordHashes()

        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            h, ends = shingle_sets(piece.column("text").to_pylist(), memo)
            starts = np.concatenate([[0], ends[:-1]]).tolist()
            raw = [h[a:b].tobytes() for a, b in zip(starts, ends.tolist(), strict=True)]
            right = pa.array(
                [
                    hashlib.md5(x).digest() == want
                    for x, want in zip(raw, piece.column("set_id").to_pylist(), strict=True)
                ],
                pa.bool_(),
            )
            columns = ["id", "cluster", "size", "signature"]
            out = pa.RecordBatch.from_arrays(
                [*(piece.column(c) for c in columns), pa.array(raw, pa.binary())],
                [*columns, "shingles"],
            )
            return out.filter(right)

        return step

    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string"))
    return map_pieces(
        members.join(texts.where("id is not null"), "id"),
        make,
        "id bigint, cluster bigint, size bigint, signature binary, shingles binary",
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs` (doc_id, text, any more).

    Words are lower-cased in A-Z and split at ASCII white space; a document's set has its distinct
    five-word shingles, with fewer words the whole sequence. Documents are linked if
    100 * |intersection| >= 75 * |union|; `component_id` is the smallest doc_id reachable.

    Null or empty texts and texts of white space have no shingles and stand alone. A row with a null
    doc_id links nothing, has null component_id and is kept. Repeated rows each come out, and where a
    doc_id has several texts each row follows its own. Other columns are not read. An empty table
    gives an empty result."""
    sketch = work_table(sketches(docs), "sketch")
    vertices = work_table(
        sketch.where("n_shingles > 0")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"))
        .where("id is not null"),
        "vertices",
    )
    keys = key_rows(vertices)
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = work_table(keys.join(sizes, "key"), "met")
    signed = met.join(vertices.select("id", "signature"), "id")
    edges = map_groups(
        block_pairs(signed, "key", "size"), ["key", "_a", "_b"], bucket_edges, EDGE, "signature"
    )
    clusters = work_table(components(edges), "clusters")
    counts = clusters.groupBy("component").agg(F.count("*").alias("size"))
    members = (
        clusters.join(counts, "component")
        .withColumnRenamed("component", "cluster")
        .join(vertices, "id")
    )
    links = map_groups(
        block_pairs(full_sets(docs, members), "cluster", "size"),
        ["cluster", "_a", "_b"],
        cluster_links,
        EDGE,
        "shingles",
    )
    found = components(links).withColumnRenamed("component", "linked")
    own = F.coalesce("linked", "id", "doc_id")
    return (
        sketch.join(vertices.select("set_id", "id").join(found, "id", "left"), "set_id", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), own))
        .select(
            "doc_id",
            "n_shingles",
            "component_id",
            F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, text, any more), one of each near-duplicate component, all columns as
    they are: the one with the smallest doc_id, rows without one after all others. Rows without words
    stay. Each row is judged by itself: of exact copies that share a doc_id, or have none, one stays,
    and rows that share a doc_id but not a component all stay. For that every row gets a number of
    its own, in a stored copy, so that numbers hold when a task is run again."""
    rows = work_table(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
            F.monotonically_increasing_id().alias("id"),
        ),
        "rows",
    )
    found = near_duplicates(rows.select(F.col("id").alias("doc_id"), F.col("row.text").alias("text")))
    own = rows.select(F.col("id").alias("doc_id"), F.col("row.doc_id").cast("bigint").alias("own"))
    stays = (
        found.join(own, "doc_id")
        .groupBy("component_id")
        .agg(F.min(F.struct(F.col("own").isNull().alias("late"), "own", F.col("doc_id").alias("id"))).alias("first"))
        .select("first.id")
    )
    return rows.join(stays, "id", "left_semi").select("row.*")
