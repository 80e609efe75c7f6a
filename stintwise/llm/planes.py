"""Token ids on disk as compressed bit planes.

A chunk holds up to `CHUNK` ids of consecutive documents of one shard. Its ids are transposed into bit
(or byte) planes: plane 0 has the lowest bit of every id, and so on up to the highest bit that occurs.
Each plane is compressed by itself with zstandard; high planes are nearly empty and all but vanish.

A file set is a Parquet folder with one row per chunk: shard, chunk, number of ids, plane width, the
compressed planes, and the chunk index: key, ordinal and number of ids of every document piece in it.
Spark's commit makes a written set complete or absent, whichever executor is lost.
"""

import functools
import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stintwise.llm.batches import map_pieces, pieces
from stintwise.session import work_table

CHUNK = 1 << 16
LEVEL = 3
END = 2
MEMO = 300_000
PIECES = 100_000
TEXTS = 4_000_000

_OTHER_SPACE = re.compile(r"[^\S \n]")

# Byte-level pieces of text of these characters alone, of which the library and `re` think alike.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[ \n!-~{_LETTER}]+")
_PIECE = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[^ \n0-9{_LETTER}]+|[ \n]+(?![^ \n])|[ \n]+"
)


def byte_signs() -> dict[int, str]:
    """The sign that byte-level models have for each byte: itself where it can be seen."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_SIGNS = byte_signs()


def plain_byte_level(tokenizer: Tokenizer) -> bool:
    """Whether a text's ids are those of its byte-level pieces, each given to the model by itself."""
    settings = json.loads(tokenizer.to_str())
    cut = settings["pre_tokenizer"] or {}
    return (
        settings["model"]["type"] == "BPE"
        and not settings["model"].get("dropout")
        and settings["normalizer"] is None
        and settings["truncation"] is None
        and settings["padding"] is None
        and cut.get("type") == "ByteLevel"
        and cut.get("use_regex", True)
        and not cut.get("add_prefix_space", True)
    )


CHUNKS = (
    "shard int, chunk int, n_ids int, bits int, width int, planes array<binary>, "
    "pieces array<struct<doc_id:bigint,ordinal:bigint,part:int,n:int>>"
)


def to_planes(ids: np.ndarray, unit: int = 1) -> tuple[int, list[bytes]]:
    """(bits, planes) of unsigned 32-bit ids; `unit` 1 makes bit planes, 8 byte planes."""
    bits = int(ids.max(initial=0)).bit_length()
    bits = -(-bits // unit) * unit
    if unit == 8:
        rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T[: bits // 8]
        return bits, [np.ascontiguousarray(r).tobytes() for r in rows]
    return bits, [np.packbits(((ids >> np.uint32(b)) & np.uint32(1)).astype(bool)).tobytes() for b in range(bits)]


def from_planes(planes: list[bytes], n: int, unit: int = 1) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for i, raw in enumerate(planes):
        plane = np.frombuffer(raw, np.uint8)
        if unit == 1:
            plane = np.unpackbits(plane, count=n)
        ids |= plane.astype(np.uint32) << np.uint32(unit * i)
    return ids


class Known(dict):
    """Ids by word; `find` gives those of a word that is not there yet."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__()
        self.find = find

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.find(word)
        return ids


class Encoder:
    """Ids of whole texts. A text is cut before single spaces between other characters, where byte-
    level pieces always end, and equal words are encoded once. Words of common characters go to the
    library's model piece by piece, which spares them its cutting and offsets; others go to it whole."""

    def __init__(self, tokenizer_file: str):
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model = self.tokenizer.model
        self.known = Known(self.word_ids)
        self.pieces: dict[str, bytes] = {}
        self.by_piece = plain_byte_level(self.tokenizer)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def words(self, text: str) -> list[str]:
        if (
            text[:1] == " "
            or text[-1:] == " "
            or "  " in text
            or " \n" in text
            or "\n " in text
            or _OTHER_SPACE.search(text)
        ):  # a space may stand beside white space: the text is encoded as a whole
            return [text] if text else []
        return text.replace(" ", "\x00 ").split("\x00") if text and "\x00" not in text else [text] * bool(text)

    def plain(self, word: str) -> bool:
        """Whether the word can go by its pieces."""
        return self.by_piece and _PLAIN.fullmatch(word) is not None and not any(a in word for a in self.added)

    def word_ids(self, word: str) -> bytes:
        """The ids of a word that is not known yet."""
        if not self.plain(word):
            found = self.tokenizer.encode_batch_fast([word], add_special_tokens=False)
            return array("I", found[0].ids).tobytes()
        known, out = self.pieces, []
        for piece in _PIECE.findall(word):
            ids = known.get(piece)
            if ids is None:
                signs = piece.encode().decode("latin-1").translate(_SIGNS)
                ids = array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()
                if len(known) >= PIECES:
                    known.clear()
                known[piece] = ids
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out, known = [], self.known
        for text in texts:
            out.append(np.frombuffer(b"".join(map(known.__getitem__, self.words(text))), "<u4"))
            if len(known) > MEMO:
                known.clear()
        return out


@functools.cache
def encoder(tokenizer_file: str) -> Encoder:
    """One for each worker process, which outlives a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's to give out
    return Encoder(tokenizer_file)


def chunk_rows(docs: DataFrame, tokenizer_file: str, unit: int) -> DataFrame:
    """Chunks of the documents of each partition, which is a shard, in the order of its rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        words, packer = encoder(tokenizer_file), zstandard.ZstdCompressor(level=LEVEL)
        held: list[np.ndarray] = []
        index: list[dict] = []
        count = chunk = ordinal = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            bits, planes = to_planes(ids, unit)
            row = [shard, chunk, len(ids), bits, unit, [packer.compress(p) for p in planes], list(index)]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, TYPES, strict=True)], NAMES
            )

        for batch in batches:
            for piece in pieces(batch, "text", TEXTS):
                keys = piece.column("doc_id").to_pylist()
                texts = [t or "" for t in piece.column("text").to_pylist()]
                for key, ids in zip(keys, words.encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(END)).astype(np.uint32)
                    part = at = 0
                    while at < len(ids):
                        n = min(CHUNK - count, len(ids) - at)
                        held.append(ids[at : at + n])
                        index.append({"doc_id": key, "ordinal": ordinal, "part": part, "n": n})
                        at, count, part = at + n, count + n, part + 1
                        if count == CHUNK:
                            yield flush()
                            held.clear()
                            index.clear()
                            count, chunk = 0, chunk + 1
                    ordinal += 1
        if held:
            yield flush()

    return docs.mapInArrow(run, CHUNKS)


NAMES = ["shard", "chunk", "n_ids", "bits", "width", "planes", "pieces"]
TYPES = [
    *[pa.int32()] * 5,
    pa.list_(pa.binary()),
    pa.list_(
        pa.struct(
            [("doc_id", pa.int64()), ("ordinal", pa.int64()), ("part", pa.int32()), ("n", pa.int32())]
        )
    ),
]


def write_tokens(docs: DataFrame, tokenizer_file: str, unit: int = 1) -> DataFrame:
    """Encode every whole text (null as empty), append the end id, and write the ids in ascending
    doc_id order, null doc_ids first and equal ones by text. The written set, read back."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return work_table(chunk_rows(ordered, tokenizer_file, unit), "tokens")


def read_pieces(files: DataFrame) -> DataFrame:
    """(shard, ordinal, part, doc_id, n, ids): the document pieces of a written set."""
    schema = "shard int, ordinal bigint, part int, doc_id bigint, n int, ids binary"

    def make():
        unpacker = zstandard.ZstdDecompressor()

        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for row in piece.to_pylist():
                planes = [unpacker.decompress(p) for p in row["planes"]]
                raw = from_planes(planes, row["n_ids"], row["width"]).astype("<u4").tobytes()
                at = 0
                for p in row["pieces"]:
                    ids = raw[4 * at : 4 * (at + p["n"])]
                    out.append((row["shard"], p["ordinal"], p["part"], p["doc_id"], p["n"], ids))
                    at += p["n"]
            types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                ["shard", "ordinal", "part", "doc_id", "n", "ids"],
            )

        return step

    flat = files.withColumn("raw", F.array_join(F.transform("planes", lambda p: F.lit("x")), ""))
    return map_pieces(flat, make, schema, "raw", 64)


def crc_after(first: int, second: int, size: int) -> int:
    """crc32 of a + b from those of a and b, and b's size in bytes: a's register is moved on by
    `size` zero bytes, squaring the one-bit step over GF(2)."""

    def times(m: list[int], v: int) -> int:
        out = 0
        for i in range(32):
            if v >> i & 1:
                out ^= m[i]
        return out

    step = [0xEDB88320, *[1 << i for i in range(31)]]  # the reflected polynomial of CRC-32
    bits = size * 8
    while bits:
        if bits & 1:
            first = times(step, first)
        step = [times(step, c) for c in step]
        bits >>= 1
    return first ^ second


def token_index(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a written set: `start` counts the
    ids of all documents before it. An empty set gives an empty result."""

    def make():
        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            crc = [zlib.crc32(x) for x in piece.column("ids").to_pylist()]
            names = ["shard", "ordinal", "part", "doc_id", "n"]
            return pa.RecordBatch.from_arrays(
                [*(piece.column(c) for c in names), pa.array(crc, pa.int64())], [*names, "crc"]
            )

        return step

    schema = "shard int, ordinal bigint, part int, doc_id bigint, n int, crc bigint"
    parts = map_pieces(read_pieces(files), make, schema, "ids")
    whole = parts.groupBy("shard", "ordinal").agg(
        F.first("doc_id").alias("doc_id"),
        F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("part", "n", "crc"))).alias("crcs"),
    )

    def joined(batches):
        for batch in batches:
            crcs = []
            for many in batch.column("crcs").to_pylist():
                crc = many[0]["crc"]
                for p in many[1:]:
                    crc = crc_after(crc, p["crc"], 4 * p["n"])
                crcs.append(crc)
            names = ["shard", "ordinal", "doc_id", "n_tokens"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(crcs, pa.int64())], [*names, "ids_crc32"]
            )

    done = whole.mapInArrow(
        joined, "shard int, ordinal bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint"
    )
    # Starts: of shards from the number of ids in each, a row a shard; in a shard from its documents.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (
        files.groupBy("shard")
        .agg(F.sum("n_ids").alias("ids"))
        .withColumn("base", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))
        .select("shard", "base")
    )
    inside = Window.partitionBy("shard").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return (
        done.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(shards, "shard")
        .select(
            "doc_id",
            (F.col("base") + F.col("before")).cast("bigint").alias("start"),
            "n_tokens",
            "ids_crc32",
        )
    )


def encoded_documents(docs: DataFrame, tokenizer_file: str, unit: int = 1) -> DataFrame:
    """Write `docs` (doc_id, text, any more) as bit planes and tell every document from the files.
    Repeated rows are documents of their own, one after another; other columns are not read."""
    return token_index(write_tokens(docs, tokenizer_file, unit))
