"""A quality classifier: a factorisation machine over hashed words, structure and metadata.

    score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

The pairwise part is the sum-of-squares identity, so scoring is linear in a text's distinct features.
The model is fitted on the driver from a bounded sample of labelled rows; its size is fixed by
`Settings` and does not grow with the corpus. Every row is scored, over its whole text.
"""

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.llm.batches import map_pieces

MEMO = 200_000
ROWS = 500_000
"""Characters at a time where whole rows pass through, with all their columns."""
_RUNS = re.compile(r"[^\W\d_]+|\d+|(\W|_)\1*")


@dataclass(frozen=True)
class Settings:
    """`sample` is the most labelled rows the fit takes; `buckets` and `rank` fix the model size."""

    sample: int = 8000
    buckets: int = 1 << 14
    rank: int = 8
    epochs: int = 8
    rate: float = 0.1
    shrink: float = 1e-5
    batch: int = 32
    seed: int = 11


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    factors: np.ndarray


BINS = 24
DENSE = 4 * BINS + 4


def shape(word: str) -> str:
    """How a word is written: letters a, A (upper case) or Aa, digits 0, signs up to two of a run."""
    out = []
    for run in _RUNS.finditer(word):
        s = run.group()
        if s[0].isdigit():
            out.append("0")
        elif run.group(1):
            out.append(s[:2])
        elif s.isupper() and len(s) > 1:
            out.append("A")
        else:
            out.append("Aa" if s[0].isupper() else "a")
    return "".join(out)


class Buckets(dict):
    """Word to (word bucket << 32 | shape bucket). Emptied when full, which only costs time."""

    def __init__(self, buckets: int):
        super().__init__()
        self.half = buckets // 2

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        plain = word.lower().strip(".,;:!?").encode("utf-8", "surrogatepass")
        a = xxhash.xxh64_intdigest(plain) % self.half
        kind = shape(word).encode("utf-8", "surrogatepass")
        b = self.half + xxhash.xxh64_intdigest(kind, 1) % self.half
        self[word] = found = a << 32 | b
        return found


def features(
    texts: Iterable[str | None], sizes: Iterable[int | None], memo: Buckets
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, index, value): the features of every text, one text after another. Words and shapes
    are scaled to length 1 each; statistics are bins with value 1 or shares."""
    half, base = memo.half, 2 * memo.half
    lengths, parts, dense = [], [], []
    for text, size in zip(texts, sizes, strict=True):
        text = text or ""
        words = text.split()
        lengths.append(len(words))
        parts.extend(map(memo.__getitem__, words))
        lines = text.split("\n")
        dense.append((len(text) if size is None else size, len(text), len(lines), len(set(lines))))
    n = np.array(lengths, np.int64)
    both = np.array(parts, np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    word, form = both >> 32, both & 0xFFFFFFFF
    at = np.concatenate([owner * base + word, owner * base + form])
    key, count = np.unique(at, return_counts=True)
    own, index = key // base, key % base
    value = np.sqrt(count.astype(np.float64))
    side = own * 2 + (index >= half)
    norm = np.sqrt(np.bincount(side, value**2, minlength=2 * len(n)))
    value /= norm[side]

    distinct = np.bincount(own[index < half], minlength=len(n))
    most = np.zeros(len(n))
    np.maximum.at(most, own[index < half], count[index < half])
    again = np.zeros(len(n))
    if len(word) > 1:
        same = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
        again = np.bincount(owner[1:][same], minlength=len(n)).astype(float)
    meta = np.array(dense, np.float64).reshape(-1, 4)
    whole = np.maximum(n, 1)
    log = lambda x: np.clip(np.log2(np.maximum(x, 0) + 1), 0, BINS - 1).astype(np.int64)
    share = lambda x: np.clip(x * BINS, 0, BINS - 1).astype(np.int64)
    bins = np.stack(
        [log(meta[:, 0]), log(n), share(meta[:, 1] / whole / 16), share(distinct / whole)], axis=1
    ) + np.arange(4) * BINS
    shares = np.stack(
        [most / whole, again / whole, 1 - meta[:, 3] / meta[:, 2], meta[:, 2] / (whole + 1)], axis=1
    )
    rows = np.arange(len(n))
    own = np.concatenate([own, np.repeat(rows, 4), np.repeat(rows, 4)])
    index = np.concatenate(
        [index, base + bins.ravel(), np.tile(base + 4 * BINS + np.arange(4), len(n))]
    )
    value = np.concatenate([value, np.ones(4 * len(n)), np.minimum(shares.ravel(), 1.0)])
    order = np.argsort(own, kind="stable")
    ends = np.cumsum(np.bincount(own, minlength=len(n)))
    return ends, index[order], value[order]


def margins(
    model: Model, ends: np.ndarray, index: np.ndarray, value: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(margin, sums) of every text; `sums` holds sum_i v_if x_i."""
    starts = np.concatenate([[0], ends[:-1]])
    vx = model.factors[index] * value[:, None]
    sums = np.add.reduceat(vx, starts, axis=0)
    squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
    linear = np.add.reduceat(model.weights[index] * value, starts)
    return model.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums


def fit(
    ends: np.ndarray, index: np.ndarray, value: np.ndarray, label: np.ndarray, to: Settings
) -> Model:
    """Logistic loss by AdaGrad over small batches, in an order fixed by the seed. With no rows, or
    one label only, the bias alone tells the share of label 1."""
    rng = np.random.default_rng(to.seed)
    size = to.buckets + DENSE
    share = (label.sum() + 0.5) / (len(label) + 1)
    model = Model(float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, to.rank)))
    if len(np.unique(label)) < 2:
        return model
    model.factors = rng.normal(0, 0.05, (size, to.rank))
    gw, gv, gb = np.full(size, 1e-6), np.full((size, to.rank), 1e-6), 1e-6
    starts = np.concatenate([[0], ends[:-1]])
    for _ in range(to.epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), to.batch):
            rows = order[at : at + to.batch]
            span = np.concatenate([np.arange(starts[r], ends[r]) for r in rows])
            i, x = index[span], value[span]
            n = (ends - starts)[rows]
            score, sums = margins(model, np.cumsum(n), i, x)
            error = (1 / (1 + np.exp(-score)) - label[rows]) / len(rows)
            e = np.repeat(error, n)
            v = model.factors[i]
            step_v = (e * x)[:, None] * (np.repeat(sums, n, axis=0) - v * x[:, None])
            touched, back = np.unique(i, return_inverse=True)
            dw = np.bincount(back, e * x) + to.shrink * model.weights[touched]
            dv = np.stack(
                [np.bincount(back, step_v[:, f]) for f in range(to.rank)], axis=1
            ) + to.shrink * model.factors[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            gb += error.sum() ** 2
            model.weights[touched] -= to.rate * dw / np.sqrt(gw[touched])
            model.factors[touched] -= 0.2 * to.rate * dv / np.sqrt(gv[touched])
            model.bias -= to.rate * error.sum() / np.sqrt(gb)
    return model


def held_out(doc_id: str = "doc_id"):
    """True on the rows whose labels are never learnt."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, to: Settings = Settings()) -> Model:
    """Fit on at most `to.sample` labelled rows that are not held out, those with the least hash
    of their doc_id. Rows without doc_id or label are passed over; of repeated labels the greatest
    counts, of repeated documents the greatest text."""
    sample = (
        labels.where("doc_id is not null and quality is not null")
        .where(~held_out())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(to.sample)
    )
    rows = source(docs).join(F.broadcast(sample), "doc_id")  # at most to.sample ids

    def make():
        memo = Buckets(to.buckets)

        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            ends, index, value = features(
                piece.column("text").to_pylist(), piece.column("n_chars").to_pylist(), memo
            )
            starts = np.concatenate([[0], ends[:-1]]).tolist()
            spans = list(zip(starts, ends.tolist(), strict=True))
            return pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    piece.column("label"),
                    pa.array([index[a:b].astype(np.int32).tobytes() for a, b in spans]),
                    pa.array([value[a:b].astype(np.float32).tobytes() for a, b in spans]),
                ],
                ["doc_id", "label", "index", "value"],
            )

        return step

    found = map_pieces(
        rows.select("doc_id", "label", "text", "n_chars"),
        make,
        "doc_id bigint, label int, index binary, value binary",
    ).toPandas()
    found = found.sort_values(["doc_id", "index", "value"]).drop_duplicates("doc_id", keep="last")
    index = [np.frombuffer(x, np.int32) for x in found["index"]]
    value = [np.frombuffer(x, np.float32) for x in found["value"]]
    none = np.zeros(0, np.int64)
    return fit(
        np.cumsum([len(x) for x in index], dtype=np.int64),
        np.concatenate([none, *index]).astype(np.int64),
        np.concatenate([none, *value]).astype(np.float64),
        found["label"].to_numpy(np.float64),
        to,
    )


def source(docs: DataFrame) -> DataFrame:
    """The columns a score may rest on. Without a column n_chars, or where it is null, the text's
    own length stands for it."""
    size = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.lit(None)
    return docs.select(
        F.col("doc_id").cast("bigint"),
        F.col("text").cast("string"),
        size.cast("bigint").alias("n_chars"),
    )


def quality_scores(docs: DataFrame, labels: DataFrame, to: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs` (doc_id, text, n_chars, any
    more); `labels` has (doc_id, quality). Scores lie in 0..1; `predicted` is 1 from 0.5 on.

    Null and empty texts are scored from what is left (no words, size 0). A row with a null doc_id
    is scored and not held out. Repeated rows each come out, with equal scores. Neither labels nor
    lang, source or doc_id enter a score. Empty `labels` give every row the score 0.5."""
    model = train(docs, labels, to)
    light = Model(
        model.bias, model.weights.astype(np.float32), model.factors.astype(np.float32)
    )
    shared = docs.sparkSession.sparkContext.broadcast(light)  # (buckets + DENSE) * (rank + 1) floats

    def make():
        memo = Buckets(to.buckets)
        own = shared.value

        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            found = features(
                piece.column("text").to_pylist(), piece.column("n_chars").to_pylist(), memo
            )
            score = 1 / (1 + np.exp(-np.clip(margins(own, *found)[0], -60, 60)))
            return pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array(score.astype(np.float64)),
                    pa.array((score >= 0.5).astype(np.int32)),
                ],
                ["doc_id", "score", "predicted"],
            )

        return step

    scored = map_pieces(source(docs), make, "doc_id bigint, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, to: Settings = Settings()) -> DataFrame:
    """The rows of `docs` with a score of 0.5 or more, all columns as they are; no shuffle."""
    model = train(docs, labels, to)
    light = Model(
        model.bias, model.weights.astype(np.float32), model.factors.astype(np.float32)
    )
    shared = docs.sparkSession.sparkContext.broadcast(light)
    sized = "n_chars" in docs.columns

    def make():
        memo = Buckets(to.buckets)

        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            texts = piece.column("text").to_pylist()
            sizes = piece.column("n_chars").to_pylist() if sized else [None] * len(texts)
            margin, _ = margins(shared.value, *features(texts, sizes, memo))
            return piece.filter(pa.array(margin >= 0))

        return step

    return map_pieces(docs, make, docs.schema, "text", ROWS)
