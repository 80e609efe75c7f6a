"""Language identification of web pages by fusing evidence:

    P(l | page) ~ P(text | l) * P(declared | l) * P(suffix | l) * P(l | host)

Text likelihoods come from byte trigrams of labelled documents. How far a declared language or an
address suffix can be trusted is learnt from the pages themselves, by summing what their texts say. The
prior of a host is smoothed by its domain's, that by all pages': each level adds `WEIGHT` pages of the
level above, and a page never counts for itself. Shares are summed as whole millionths, so sums do not
depend on their order.
"""

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.llm.batches import map_pieces
from stintwise.session import work_table

SAMPLE = 8000  # labelled documents the text model is fitted on, at most
LANGUAGES = SAMPLE  # all of theirs are kept, so there are no more
BUCKETS = 1 << 15
SMOOTH = 0.1
TRIGRAMS = 60  # a text tells no more than so many trigrams would: they are far from independent
WEIGHT = 10.0
UNIT = 1_000_000
TEXTS = 2_000_000

_DROP = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]+)", re.I)
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def visible(page: str) -> str:
    return html.unescape(_DROP.sub(" ", page))


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased words, each between spaces."""
    raw = (" " + " ".join(text.lower().split()) + " ").encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    code = (b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]) * np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(64 - 15)).astype(np.int64)


def text_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood of every trigram bucket in each) of a bounded sample of labelled
    documents, those with the least hash of their doc_id. All languages of the sample are kept. Only
    counts reach the driver, where a language takes BUCKETS of them."""
    real = docs.where("lang is not null and doc_id is not null")
    sample = (
        real.select("doc_id", "lang").distinct().orderBy(F.xxhash64("doc_id"), "lang").limit(SAMPLE)
    )

    def make():
        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            held: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(
                piece.column("lang").to_pylist(), piece.column("text").to_pylist(), strict=True
            ):
                held.setdefault(lang, []).append(trigrams(text or ""))
            langs, buckets, n = [], [], []
            for lang, grams in held.items():
                full, count = np.unique(np.concatenate(grams), return_counts=True)
                langs += [lang] * len(full)
                buckets.append(full)
                n.append(count)
            return pa.RecordBatch.from_arrays(
                [pa.array(langs), pa.array(np.concatenate(buckets), pa.int32()), pa.array(np.concatenate(n))],
                ["lang", "bucket", "n"],
            )

        return step

    rows = real.join(F.broadcast(sample), ["doc_id", "lang"]).select("lang", "text")  # SAMPLE rows
    counts = map_pieces(rows, make, "lang string, bucket int, n bigint")
    found = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    kept = sorted(r["lang"] for r in found.select("lang").distinct().collect())
    row = {lang: i for i, lang in enumerate(kept)}
    table = np.full((len(kept), BUCKETS), SMOOTH)
    for r in found.toLocalIterator() if kept else []:
        table[row[r["lang"]], r["bucket"]] += r["n"]
    return kept, np.log(table / table.sum(axis=1, keepdims=True))


def page_evidence(pages: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """(page_id, host, domain, suffix, declared, text): per page its address parts, the declared
    language ('none', 'other' beside those known) and the tempered log-likelihoods of its text."""
    shared = pages.sparkSession.sparkContext.broadcast(model.astype(np.float32))

    def make():
        table = shared.value.astype(np.float64)
        known = {"none", *languages}

        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for page, url, raw in zip(
                piece.column("page_id").to_pylist(),
                piece.column("url").to_pylist(),
                piece.column("html").to_pylist(),
                strict=True,
            ):
                m = _HOST.match(url or "")
                host = m.group(1).lower().rstrip(".") if m else ""
                labels = host.split(".")
                m = _DECLARED.search(raw or "")
                said = m.group(1).lower() if m else "none"
                grams = trigrams(visible(raw or ""))
                text = table[:, grams].mean(axis=1) * min(len(grams), TRIGRAMS) if len(grams) else table[:, 0] * 0
                out.append(
                    (
                        page,
                        host,
                        ".".join(labels[-2:]),
                        labels[-1],
                        said if said in known else "other",
                        (text - text.max()).tolist(),
                    )
                )
            types = [pa.int64(), *[pa.string()] * 4, pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                ["page_id", "host", "domain", "suffix", "declared", "text"],
            )

        return step

    rows = pages.select(
        F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")
    )
    return map_pieces(
        rows,
        make,
        "page_id bigint, host string, domain string, suffix string, declared string, text array<double>",
        "html",
        TEXTS,
    )


def normalized(logs: Column) -> Column:
    """Probabilities of an array of log-weights."""
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda x: x / total)


def added(*logs: Column) -> Column:
    out = logs[0]
    for more in logs[1:]:
        out = F.zip_with(out, more, lambda a, b: a + b)
    return out


def shares(rows: DataFrame, keys: list[str], probability: str, name: str, size: int) -> DataFrame:
    """(keys, name): the summed probabilities of a group, in millionths, by language."""
    sums = [
        F.sum(F.round(F.col(probability)[i] * UNIT).cast("bigint")).alias(f"_{i}") for i in range(size)
    ]
    return rows.groupBy(*keys).agg(*sums).select(
        *keys, F.array(*[F.col(f"_{i}") for i in range(size)]).alias(name)
    )


def likelihood(counts: DataFrame, key: str, name: str, size: int) -> DataFrame:
    """(key, name): log P(value | language) of a grouped table with counts `n`, smoothed by the
    value's own share of all pages."""
    total = counts.agg(*[F.coalesce(F.sum(F.col("n")[i]), F.lit(0)).alias(f"t{i}") for i in range(size)]).first()
    whole = float(sum(total)) or 1.0
    share = F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x) / F.lit(whole)
    logs = [
        F.log((F.col("n")[i] + UNIT * WEIGHT * (share + 1e-6)) / F.lit(float(total[i]) + UNIT * WEIGHT))
        for i in range(size)
    ]
    return counts.select(key, F.array(*logs).alias(name))


def languages_of(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, suffix, host) of every row of `pages`
    (page_id, url, html, any more); `docs` (doc_id, text, lang) have the labelled texts.

    A null or empty page has no text evidence and goes by the rest; a null or odd address has the
    host ''. Rows without page_id come out too, repeated rows each. Ties go to the language first in
    the alphabet. Without labelled texts lang, probability and text_lang are null. Other columns are
    not read."""
    languages, model = text_model(docs)
    n = len(languages)
    if not n:
        none = F.lit(None).cast("string")
        found = page_evidence(pages, [], np.zeros((1, BUCKETS)))
        return found.select(
            "page_id",
            none.alias("lang"),
            F.lit(None).cast("double").alias("probability"),
            none.alias("text_lang"),
            "declared",
            "suffix",
            "host",
        )
    pages_ = work_table(page_evidence(pages, languages, model), "pages")
    by_text = pages_.withColumn("p", normalized(F.col("text")))
    said = likelihood(shares(by_text, ["declared"], "p", "n", n), "declared", "l_declared", n)
    ends = likelihood(shares(by_text, ["suffix"], "p", "n", n), "suffix", "l_suffix", n)
    first = work_table(
        pages_.join(said, "declared")
        .join(ends, "suffix")
        .withColumn("logs", added(F.col("text"), F.col("l_declared"), F.col("l_suffix")))
        .withColumn("p", normalized(F.col("logs")))
        .select("page_id", "host", "domain", "suffix", "declared", "text", "logs", "p"),
        "fused",
    )
    hosts = work_table(shares(first, ["domain", "host"], "p", "c_host", n), "hosts")
    add = [F.sum(F.col("c_host")[i]).alias(f"_{i}") for i in range(n)]
    domains = hosts.groupBy("domain").agg(*add).select(
        "domain", F.array(*[F.col(f"_{i}") for i in range(n)]).alias("c_domain")
    )
    everything = hosts.agg(*add).first()
    top = [float(x or 0) + UNIT for x in everything]
    base = F.array(*[F.lit(x / sum(top)) for x in top])
    own = F.transform("p", lambda x: F.round(x * UNIT).cast("bigint"))

    def level(counts: Column, above: Column) -> Column:
        others = F.zip_with(counts, own, lambda c, o: (c - o).cast("double"))
        total = F.aggregate(others, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(
            others, above, lambda c, a: (c + F.lit(WEIGHT * UNIT) * a) / (total + F.lit(WEIGHT * UNIT))
        )

    names = F.array(*[F.lit(x) for x in languages])

    def best(values: Column) -> Column:
        return names[(F.array_position(values, F.array_max(values)) - 1).cast("int")]

    return (
        first.join(hosts, ["domain", "host"])
        .join(domains, "domain")
        .withColumn("prior", level(F.col("c_host"), level(F.col("c_domain"), base)))
        .withColumn("q", normalized(added(F.col("logs"), F.transform("prior", lambda x: F.log(x)))))
        .select(
            "page_id",
            best(F.col("q")).alias("lang"),
            F.array_max("q").alias("probability"),
            best(F.col("text")).alias("text_lang"),
            "declared",
            "suffix",
            "host",
        )
    )
