"""Distinct sampled segmentations: Gumbel top-k without replacement over SentencePiece lattices.

Every segmentation has a perturbed score, its log-probability plus Gumbel noise; the k largest are a
sample without replacement. The search keeps regions of the lattice, each with the largest perturbed
score in it: all segmentations that share a prefix and then leave it by none of the edges already
taken. It takes the best region, draws its best segmentation (the edge among those left, then a free
walk to the end), and splits the rest of the region along the new path. A region's largest score is a
Gumbel variable about its total log-probability, cut off at the score of the region it was split
from, so no segmentation is ever listed.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.llm.batches import map_pieces
from stintwise.llm.lattice import Lattices, row_seed, shared_lattices, uniforms
from stintwise.llm.shingles import mix

SAMPLES = 3
SEED = 29
TEXTS = 1_000_000

SCHEMA = (
    "doc_id bigint, rank int, n_pieces int, log_prob double, perturbed double, "
    "log_inclusion double, ids_crc32 bigint, decoded_crc32 bigint"
)
_EDGE, _SPLIT, _TOP = 1 << 40, 1 << 41, 1 << 42


def region_tops(total: np.ndarray, below: float, seeds: np.ndarray, salt: int) -> np.ndarray:
    """Gumbel variables about the log-masses `total`, cut off at `below`; -inf for empty regions."""
    noise = -np.log(uniforms(seeds, salt))
    with np.errstate(divide="ignore"):
        return total - np.log(np.exp(np.minimum(total - below, 700.0)) + noise)


HEAD = -30.0  # regions further than this log-probability on stay together until they are drawn


class Path:
    """A segmentation of one document. `tops[i]` is the top of the region that leaves it at edge i;
    `tops[head]`, if there are more edges, of all that leave it later."""

    __slots__ = ("edges", "tops", "head", "log_prob", "score", "turn", "taken")


def left_mass(lattices: Lattices, edge: int, taken: tuple) -> tuple[np.ndarray, float]:
    """(edges, log of their probability): those from the edge's start that are not `taken`."""
    node = int(lattices.source[edge])
    first = int(lattices.first[node])
    found = [e for e in range(first, first + int(lattices.degree[node])) if e not in taken]
    mass = float(np.exp(lattices.log_q[found]).sum())
    return np.array(found, np.int64), float(np.log(mass)) if mass > 0 else -np.inf


def leaving(before: np.ndarray, log_q: np.ndarray) -> np.ndarray:
    """Log-probability of all that leaves a path at each edge; -inf where no other edge is."""
    with np.errstate(divide="ignore"):
        return before + np.log(-np.expm1(log_q))


def new_path(
    lattices: Lattices, edges: np.ndarray, score: float, key: int, turn: int = -1, taken: tuple = ()
) -> Path:
    """A path with its regions; from `turn` on they are its own, at `turn` without `taken`."""
    path = Path()
    path.edges, path.score, path.turn, path.taken = edges, score, turn, taken
    log_q = lattices.log_q[edges]
    path.log_prob = float(log_q.sum())
    begin = max(turn, 0)
    size = begin + 64
    while True:
        upto = np.cumsum(log_q[:size])
        far = np.flatnonzero(upto[begin:] < upto[begin] - log_q[begin] + HEAD) if begin < len(edges) else []
        if len(far) or size >= len(edges):
            break
        size *= 2
    head = path.head = min(begin + int(far[0]) + 1 if len(far) else len(edges), len(edges))
    before = upto[:head] - log_q[:head]
    rest = np.full(head + (head < len(edges)), -np.inf)
    rest[begin:head] = leaving(before[begin:], log_q[begin:head])
    if turn >= 0:
        rest[turn] = before[turn] + left_mass(lattices, int(edges[turn]), taken)[1]
    if head < len(edges):
        rest[head] = leaving(upto[head - 1], log_q[head:].sum())
    marks = mix(np.arange(len(rest), dtype=np.uint64) + np.uint64(key))
    path.tops = region_tops(rest, score, marks, _TOP)
    return path


def open_tail(lattices: Lattices, path: Path, key: int) -> int:
    """Split the region of all later edges, which is drawn: its best segmentation leaves at the edge
    returned, the other edges get regions of their own below its top."""
    log_q = lattices.log_q[path.edges]
    rest = leaving(np.cumsum(log_q) - log_q, log_q)[path.head :]
    weight = np.cumsum(np.exp(rest - rest.max()))
    marks = mix(np.arange(len(rest), dtype=np.uint64) + np.uint64(key))
    u = uniforms(marks[:1], _EDGE)[0] * weight[-1]
    i = min(int(np.searchsorted(weight, u, "right")), len(rest) - 1)
    tops = region_tops(rest, float(path.tops[path.head]), marks, _TOP)
    path.tops = np.concatenate([path.tops[: path.head], tops])
    path.head = len(path.edges)
    return path.head - len(rest) + i


def draw(lattices: Lattices, starts: list[np.ndarray], seeds: list[int], k: int) -> list[tuple]:
    """(paths, threshold) of each document, given the first nodes of its chunks. At most `k` paths,
    by falling perturbed score; `threshold` is the next perturbed score, -inf if none is left."""
    n = len(starts)
    paths: list[list[Path]] = [[] for _ in range(n)]

    def walked(jobs: list[tuple[int, np.ndarray, int]], round_: int) -> list[np.ndarray]:
        """Free walks: (document, nodes, place of the first chunk)."""
        if not jobs:
            return []
        nodes = np.concatenate([j[1] for j in jobs])
        keys = np.concatenate(
            [
                np.arange(place, place + len(at), dtype=np.uint64)
                * np.uint64(2654435761)
                + np.uint64((seeds[d] + round_ * 7919) & 0xFFFFFFFFFFFFFFFF)
                for d, at, place in jobs
            ]
        )
        counts, edges = lattices.walk(nodes, mix(keys))
        stops = np.cumsum([0, *(len(j[1]) for j in jobs)])
        by_chunk = np.concatenate([[0], np.cumsum(counts)])
        return [edges[by_chunk[a] : by_chunk[b]] for a, b in zip(stops, stops[1:], strict=False)]

    def key(d: int, round_: int) -> int:
        return (seeds[d] + round_ * 104729) & 0xFFFFFFFFFFFFFFFF

    first = walked([(d, starts[d], 0) for d in range(n)], 0)
    noise = (-np.log(-np.log(uniforms(np.array(seeds, np.uint64), _EDGE)))).tolist()
    for d in range(n):
        paths[d].append(new_path(lattices, first[d], noise[d], key(d, 0)))
    for round_ in range(1, k):
        jobs, turns = [], []
        for d in range(n):
            best = max(paths[d], key=lambda p: p.tops.max(initial=-np.inf))
            i = int(best.tops.argmax()) if len(best.tops) else 0
            top = float(best.tops[i]) if len(best.tops) else -np.inf
            if top == -np.inf:
                continue
            if i == best.head:
                i = open_tail(lattices, best, key(d, -round_))
            best.tops[i] = -np.inf
            taken = (*(best.taken if i == best.turn else ()), int(best.edges[i]))
            others, _ = left_mass(lattices, taken[-1], taken)
            weight = np.cumsum(np.exp(lattices.log_q[others]))
            u = uniforms(np.array([seeds[d]], np.uint64), _SPLIT + round_)[0] * weight[-1]
            new = int(others[min(int(np.searchsorted(weight, u, "right")), len(others) - 1)])
            # The chunk goes on from the new edge, then the chunks behind it are walked.
            chunk = int(lattices.end[lattices.to[best.edges[:i]]].sum())
            on = int(lattices.to[new])
            head = [] if lattices.end[on] else [on]
            nodes = np.concatenate([np.array(head, np.int64), starts[d][chunk + 1 :]])
            jobs.append((d, nodes, chunk + 1 - len(head)))
            turns.append((d, best.edges[:i], new, top, i, (*taken, new)))
        for (d, prefix, new, top, i, taken), suffix in zip(turns, walked(jobs, round_), strict=True):
            edges = np.concatenate([prefix, [new], suffix])
            paths[d].append(new_path(lattices, edges, top, key(d, round_), i, taken))
    return [(p, max(float(x.tops.max(initial=-np.inf)) for x in p)) for p in paths]


def sampled_segmentations(
    docs: DataFrame, model_file: str, k: int = SAMPLES, seed: int = SEED, with_ids: bool = True
) -> DataFrame:
    """Up to `k` distinct segmentations of every row of `docs` (doc_id, text, any more): doc_id, rank
    from 1, n_pieces, log_prob, perturbed score, log_inclusion, crc32 of the ids as little-endian
    unsigned 32-bit integers and of the text they decode to, and with `with_ids` the ids.

    `log_inclusion` is log(1 - exp(-exp(log_prob - t))) with t the perturbed score after the last:
    the probability that a segmentation is among the k given t; 0 if the text has no more. Noise is
    seeded by doc_id, so equal rows are drawn alike wherever they lie. Texts with fewer
    segmentations give fewer rows. A null or empty text has one, without pieces; null doc_ids share
    one seed. Other columns are not read. `model_file` is read on the executors."""
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def make():
        lattices = shared_lattices(model_file)
        vocabulary = lattices.vocabulary

        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            docs_ = piece.column("doc_id").to_pylist()
            split = [vocabulary.chunks(t or "") for t in piece.column("text").to_pylist()]
            nodes = lattices.look_up([c for s in split for c in s])
            starts = np.split(nodes, np.cumsum([len(s) for s in split])[:-1])
            rows = []
            found = draw(lattices, starts, [row_seed(d, seed) for d in docs_], k)
            for doc, (paths, threshold) in zip(docs_, found, strict=True):
                for rank, path in enumerate(paths, 1):
                    ids = lattices.ids(path.edges)
                    away = path.log_prob - threshold
                    with np.errstate(divide="ignore"):
                        kept = 0.0 if away > 30 else float(np.log(-np.expm1(-np.exp(away))))
                    raw = ids.astype("<u4").tobytes()
                    row = [doc, rank, len(ids), path.log_prob, path.score]
                    row += [kept if away > -30 else away, zlib.crc32(raw)]
                    row.append(zlib.crc32(vocabulary.decode(ids.tolist())))
                    rows.append((*row, ids) if with_ids else row)
            types = [pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 3, *[pa.int64()] * 2]
            names = [c.split()[0] for c in schema.split(", ")]
            types += [pa.list_(pa.int32())] * with_ids
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
            )

        return step

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return map_pieces(rows, make, schema, "text", TEXTS, lambda: shared_lattices(model_file).clear())


def decoded(rows: DataFrame, model_file: str) -> DataFrame:
    """`rows` with a column `decoded`, the text of the column `ids` (null for null ids)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        vocabulary = shared_lattices(model_file).vocabulary
        for batch in batches:
            texts = [
                None if ids is None else vocabulary.decode(ids).decode("utf-8", "replace")
                for ids in batch.column("ids").to_pylist()
            ]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    return rows.mapInArrow(run, schema + ", decoded string")
