import math
from collections import defaultdict

import numpy as np
import pytest

from stintwise.llm import language
from stintwise.llm.language import languages_of, text_model, trigrams, visible

FOLDER = "/root/testdata/sf0.001"


def brute(rows, langs, model):
    n = len(langs)
    soft = lambda logs: [math.exp(x - max(logs)) / sum(math.exp(y - max(logs)) for y in logs) for x in logs]
    grain = lambda p: [round(x * 1e6) for x in p]
    model = model.astype(np.float32).astype(float)
    items = []
    for page, url, raw in rows:
        raw = raw or ""
        g = trigrams(visible(raw))
        text = (model[:, g].mean(axis=1) * min(len(g), 60)).tolist() if len(g) else [0.0] * n
        host = url.split("://")[1].split("/")[0] if url else ""
        said = raw.split('<html lang="')[1].split('"')[0] if '<html lang="' in raw else "none"
        said = said if said in [*langs, "none"] else "other"
        items.append([page, host, ".".join(host.split(".")[-2:]), host.split(".")[-1], said, text])

    def table(at):
        counts = defaultdict(lambda: [0] * n)
        for it in items:
            counts[it[at]] = [a + b for a, b in zip(counts[it[at]], grain(soft(it[5])), strict=True)]
        total = [sum(c[i] for c in counts.values()) for i in range(n)]
        return {
            k: [math.log((c[i] + 1e7 * (sum(c) / sum(total) + 1e-6)) / (total[i] + 1e7)) for i in range(n)]
            for k, c in counts.items()
        }

    said, ends = table(4), table(3)
    logs = [[a + b + c for a, b, c in zip(i[5], said[i[4]], ends[i[3]], strict=True)] for i in items]
    own = [grain(soft(x)) for x in logs]
    host, domain, whole = (defaultdict(lambda: [0] * n) for _ in range(3))
    for it, o in zip(items, own, strict=True):
        for d, k in ((host, (it[2], it[1])), (domain, it[2]), (whole, 0)):
            d[k] = [a + b for a, b in zip(d[k], o, strict=True)]
    base = [(x + 1e6) / (sum(whole[0]) + n * 1e6) for x in whole[0]]

    def level(c, o, above):
        rest = [a - b for a, b in zip(c, o, strict=True)]
        return [(r + 1e7 * a) / (sum(rest) + 1e7) for r, a in zip(rest, above, strict=True)]

    out = []
    for it, o, l in zip(items, own, logs, strict=True):
        prior = level(host[it[2], it[1]], o, level(domain[it[2]], o, base))
        q = soft([a + math.log(p) for a, p in zip(l, prior, strict=True)])
        out.append((it[0], langs[q.index(max(q))], max(q), it[4], it[3], it[1]))
    return out


def test_pages_equal_brute_force(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame(
        [(9001, None, None), (None, "http://a.example.de/x", ""), (9002, "nonsense", "<p>the of and</p>")],
        "page_id bigint, url string, html string",
    )
    both = pages.select("page_id", "url", "html").unionByName(odd)
    both = both.unionByName(both.where("page_id < 3")).withColumn("lang", both["url"])
    got = languages_of(both, docs).collect()
    rows = [(r["page_id"], r["url"] if r["url"] != "nonsense" else None, r["html"]) for r in both.collect()]
    langs, model = text_model(docs)
    want = brute(rows, langs, model)
    key = lambda r: (str(r[0]), r[1])
    got = sorted(
        ((r["page_id"], r["lang"], r["probability"], r["declared"], r["suffix"], r["host"]) for r in got), key=key
    )
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[2] == pytest.approx(b[2], abs=1e-9)
        assert (*a[:2], *a[3:]) == (*b[:2], *b[3:])


def test_texts_of_known_language(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    langs, model = text_model(docs)
    rows = docs.select("lang", "text").collect()
    right = [
        langs[int(model[:, trigrams(r["text"])].sum(axis=1).argmax())] == r["lang"]
        for r in rows
        if r["text"] and len(r["text"]) > 100
    ]
    assert np.mean(right) > 0.95


def test_every_language_of_the_sample_is_known(spark):
    letters = "bcdfghjklmnpqrstvwxz"
    texts = [(a + b, f"{a}a{b}e{a}i {b}o{a}u{b} " * 5) for a, b in zip(letters * 2, letters[1:] + letters[5:], strict=False)]
    texts = list(dict(texts).items())
    assert len(texts) > 32
    docs = spark.createDataFrame([(i, text, lang) for i, (lang, text) in enumerate(texts)], "doc_id bigint, text string, lang string")
    pages = spark.createDataFrame(
        [(i, None, f'<html lang="{lang}"><p>{text}</p></html>') for i, (lang, text) in enumerate(texts)],
        "page_id bigint, url string, html string",
    )
    got = {r["page_id"]: (r["lang"], r["text_lang"], r["declared"]) for r in languages_of(pages, docs).collect()}
    assert got == {i: (lang, lang, lang) for i, (lang, _) in enumerate(texts)}


def test_no_rows(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert languages_of(pages.limit(0), docs).collect() == []
    none = languages_of(pages.limit(5), docs.limit(0)).collect()
    assert len(none) == 5 and {r["lang"] for r in none} == {None}
    assert language.LANGUAGES >= 4
