"""Main text of web pages by maximum-scoring subsequence.

A page is read as one run of words and tags. Words score by what labelled pages say of words at such
places, tags score negative; one linear scan (the running sum starts anew where it would fall below
zero) finds the contiguous part of the page with the greatest sum. Its blocks are the main text.

Labelled pages are those that mark their article themselves, with one outermost `article` or `main`
element: words and tags inside are content, others are not. `weights` counts both by grouped sums over
a bounded sample of them (`SAMPLE` pages, those with the smallest hashes) and adds `PRIOR` counts, so
that places no labelled page has are scored by what HTML means them for.

Parts that HTML or their names set aside (menus, forms, sidebars, adverts, comments; `ASIDE`,
`ASIDE_NAMES`) hold no content wherever they stand: their words are left out and the part counts as its
tags, so that an advert inside an article does not cut it in two.
"""

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.llm.batches import map_pieces

SAMPLE = 2000

# Elements of HTML by what they are for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEAD = frozenset("base link meta noscript script style template title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr img".split()
)
TEXT = frozenset("p blockquote pre figcaption caption td dd h1 h2 h3 h4 h5 h6".split())
ASIDE = frozenset(
    "applet aside audio button canvas datalist dialog embed fieldset footer form head iframe input menu nav "
    "noembed noframes noscript object optgroup option script select style svg template textarea title video "
    "xmp".split()
)
ASIDE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status "
    "tablist toolbar".split()
)
ASIDE_NAMES = frozenset(
    "ad adbox ads adsense adslot advert advertisement advertising adverts alert aside banner breadcrumb "
    "breadcrumbs comment commentlist comments consent cookie cookies copyright disclaimer disqus footer gdpr "
    "hidden login masthead menu modal nav navbar navigation newsletter notice notices overlay pager "
    "pagination popup promo promoted promotion recommendations recommended related replies reply respond "
    "share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription toc toolbar "
    "topbar widget".split()
)
HEADER_NAMES = frozenset("header site-header page-header main-header global-header top-header".split())
NOT_ITSELF = frozenset("has no not with without".split())
CONTENT = frozenset({"article", "main"})
SIBLINGS = {
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}),
    "th": frozenset({"td", "th"}),
    "option": frozenset({"option"}),
}
"""Open elements that a start tag ends, inside the nearest of `HOLDERS`."""
HOLDERS = frozenset({"ul", "ol", "dl", "table", "select", "menu"})
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SCOPE = frozenset("table td th caption button object".split())
BLOCKS = SCOPE | frozenset("article aside body div nav section li".split())

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
MARK = re.compile(
    r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?![^\s=/>])\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""",
    re.I,
)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

PRIOR = 30.0
PLACES = {
    "text": (4.0, 1.0),
    "text_link": (1.5, 1.0),
    "item": (1.5, 1.0),
    "other": (2.0, 1.0),
    "link": (1.0, 4.0),
    "item_link": (1.0, 8.0),
}
"""Shares of words inside and outside of content that `PRIOR` counts stand for, by place."""
TAGS = {"p": 0.2, "br": 0.2, "inline": 0.2, "heading": 0.5, "list": 0.8, "table": 0.5, "block": 2.0}
"""What a tag costs where labelled pages say nothing against it, by kind."""
MOST = 4.0
EDGE, OUTSIDE, WITHIN = 40.0, 2.0, 0.001
"""On pages that mark their article: what its edge costs, what a word outside costs besides, and what a
tag inside costs."""


class Run(NamedTuple):
    """A stretch of text, or a tag if `text` is None. `place` tells where words stand or the kind of a
    tag, `words` their number, `block` the number of the block, `marked` whether it stands in a
    marked article."""

    place: str
    text: str | None
    words: int
    block: int
    marked: bool


class Element(NamedTuple):
    name: str
    aside: bool
    mark: bool


def set_aside(name: str, rest: str) -> bool:
    """Whether the start tag `name` with attributes `rest` opens a part that holds no content."""
    if name in ASIDE:
        return True
    if name in ("html", "body", "main"):
        return False
    for key, *values in MARK.findall(rest) if rest else ():
        key, value = key.lower(), "".join(values)
        if key in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in NAME.findall(one)]
                named = [w in ASIDE_NAMES for w in words]
                if any(named) and words[0] not in NOT_ITSELF and (all(named) or name != "article"):
                    return True
        elif key == "role":
            if value.lower() in ASIDE_ROLES:
                return True
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        elif key == "style" and UNSEEN.search(value):
            return True
    return False


def is_header(name: str, rest: str) -> bool:
    if name == "header":
        return True
    return any(
        k.lower() in ("class", "id") and not HEADER_NAMES.isdisjoint("".join(v).lower().split())
        for k, *v in (MARK.findall(rest) if "eader" in rest else ())
    )


def kind(name: str) -> str:
    if name in ("p", "br"):
        return name
    if name in INLINE:
        return "inline"
    if len(name) == 2 and name[0] == "h" and name[1] in "123456":
        return "heading"
    if name in ("ul", "ol", "li", "dl", "dt", "dd"):
        return "list"
    return "table" if name in ("table", "tr", "td", "th", "tbody", "thead", "tfoot") else "block"


class Reader:
    """Reads one page into runs, with the open elements on a stack."""

    def __init__(self) -> None:
        self.open: list[Element] = []
        self.count: Counter[str] = Counter()
        self.asides = self.marks = self.articles = self.block = 0
        self.runs: list[Run] = []

    def tag(self, name: str) -> None:
        if name not in INLINE:
            self.block += 1
        if not self.asides:
            self.runs.append(Run(kind(name), None, 0, self.block, self.marks > 0))

    def enter(self, element: Element) -> None:
        self.open.append(element)
        self.count[element.name] += 1
        self.asides += element.aside
        self.marks += element.mark

    def leave(self, names: frozenset[str], bounds: frozenset[str]) -> None:
        """The end of the nearest open element of `names` and of what is open in it; nothing if one of
        `bounds` is nearer."""
        if not any(self.count[n] for n in names):
            return
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at].name
            if name in names:
                while len(self.open) > at:
                    last = self.open.pop()
                    self.count[last.name] -= 1
                    self.asides -= last.aside
                    self.marks -= last.mark
                    self.tag(last.name)
                return
            if name in bounds:
                return

    def start(self, name: str, rest: str) -> None:
        if name not in HEAD and name not in ("html", "head"):
            self.leave(frozenset({"head"}), frozenset())
        if name in ENDS_P:
            self.leave(frozenset({"p"}), BLOCKS)
        if name in SIBLINGS:
            self.leave(SIBLINGS[name], HOLDERS)
        if name == "main" and self.asides or name == "article" and self.count["form"] and self.asides:
            # what a page's own article stands in is not set aside: a form or a named box round the page
            unsafe = frozenset() if name == "main" else ASIDE - {"form"}
            if not any(e.aside and (e.name in unsafe or name == "article" and e.name != "form") for e in self.open):
                self.open = [e._replace(aside=False) for e in self.open]
                self.asides = 0
        aside = set_aside(name, rest) or not self.marks and is_header(name, rest)
        mark = name in CONTENT and not aside and not self.asides
        self.articles += mark and not self.marks
        self.tag(name)
        if name not in VOID:
            self.enter(Element(name, aside, mark))

    def end(self, name: str) -> None:
        if name == "br" or name == "p" and not self.count["p"]:
            self.tag(name)
        else:
            bounds = BLOCKS if name in INLINE else SCOPE
            self.leave(frozenset({name}), bounds - {name})

    def words(self, text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        count = len(text.split())
        inner = next((e.name for e in reversed(self.open) if e.name not in INLINE), "")
        place = "text" if inner in TEXT else "item" if inner == "li" else "other"
        if self.count["a"]:
            place = {"text": "text_link", "item": "item_link", "other": "link"}[place]
        self.runs.append(Run(place, text, count, self.block, self.marks > 0))

    def read(self, page: str) -> "Reader":
        at = 0
        while at < len(page):
            found = TOKEN.match(page, at)
            at = found.end()
            if found["text"] is not None:
                if not self.asides:
                    self.words(found["text"])
            elif found["name"] is not None:
                name = found["name"].lower()
                if found["end"]:
                    self.end(name)
                    continue
                self.start(name, found["rest"])
                if name in RAW:
                    close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                    at = close.end() if close else len(page)
                    self.leave(frozenset({name}), frozenset())
        return self


def counted(page: str) -> Counter[tuple[str, bool, bool]]:
    """(place, is a word, is inside) of a labelled page's words and tags; nothing if it marks no article
    or several."""
    reader = Reader().read(page)
    counts: Counter[tuple[str, bool, bool]] = Counter()
    if reader.articles == 1:
        for run in reader.runs:
            counts[run.place, run.text is not None, run.marked] += 1 if run.text is None else run.words
    return counts


def sample(pages: DataFrame, size: int) -> DataFrame:
    """The labelled pages with the smallest hashes of their text, about `size` of all that hold the start
    of a marked article; ties of the last hash are all in."""
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    mark = F.xxhash64("html")
    last = marked.select(mark.alias("mark")).orderBy("mark").limit(size).agg(F.max("mark")).first()[0]
    return marked.where(mark <= F.lit(last)) if last is not None else marked.where("false")


def weights(pages: DataFrame, size: int = SAMPLE) -> tuple[dict[str, float], dict[str, float]]:
    """Scores of a word and of a tag by place, from at most about `size` labelled pages."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, bool, bool]] = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                counts.update(counted(page))
        keys = list(counts)
        yield pa.record_batch(
            {
                "place": pa.array([k[0] for k in keys], pa.string()),
                "word": pa.array([k[1] for k in keys], pa.bool_()),
                "inside": pa.array([k[2] for k in keys], pa.bool_()),
                "n": pa.array([counts[k] for k in keys], pa.int64()),
            }
        )

    parts = sample(pages, size).select("html").mapInArrow(run, "place string, word boolean, inside boolean, n bigint")
    rows = parts.groupBy("place", "word", "inside").agg(F.sum("n")).collect()
    return scores({(r[0], r[1], r[2]): r[3] for r in rows})


def scores(counts: dict[tuple[str, bool, bool], int]) -> tuple[dict[str, float], dict[str, float]]:
    """A word's score is the log of its odds to be content against those of all words, about 1 where
    labelled pages and `PLACES` agree. A tag's is negative: what `TAGS` says where tags of its kind are
    content, more where they are not."""

    def odds(place: str, word: bool, start: tuple[float, float]) -> float:
        a, b = (start[i] / sum(start) * PRIOR + counts.get((place, word, i == 0), 0) for i in (0, 1))
        return math.log(a / b)

    words = {p: max(-MOST, min(MOST, odds(p, True, s))) for p, s in PLACES.items()}
    tags = {t: -cost - max(0.0, min(MOST, -odds(t, False, (1.0, 1.0)))) for t, cost in TAGS.items()}
    return words, tags


def best(values: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous part with the greatest sum above zero, the first of equals; an empty
    one if there is none."""
    start = end = at = 0
    total = most = 0.0
    for i, value in enumerate(values):
        if total <= 0.0:
            total, at = 0.0, i
        total += value
        if total > most:
            most, start, end = total, at, i + 1
    return start, end


def extract(page: str | None, words: dict[str, float], tags: dict[str, float]) -> str:
    """The main text of one page. White space of a block, line breaks too, becomes one space; blocks
    are joined by one space."""
    if not page:
        return ""
    reader = Reader().read(page)
    runs: list[Run | None] = []  # None: the edge of a marked article
    values, before = [], False
    for run in reader.runs:
        value = tags[run.place] if run.text is None else words[run.place] * run.words
        if reader.articles:
            if run.marked:
                value = -WITHIN if run.text is None else max(value, run.words)
            else:
                value = min(value, 0.0) - OUTSIDE * run.words
            if run.marked != before:
                before = run.marked
                runs.append(None)
                values.append(-EDGE)
        runs.append(run)
        values.append(value)
    start, end = best(values)
    blocks: dict[int, list[str]] = {}
    for run in runs[start:end]:
        if run is not None and run.text is not None:
            blocks.setdefault(run.block, []).append(run.text)
    return " ".join(w for block in blocks.values() for w in "".join(block).split())


def main_texts(pages: DataFrame, size: int = SAMPLE) -> DataFrame:
    """page_id, url, text and n_chars of every row of `pages` (page_id, url, html).

    A null or empty page, and one without words that score above zero, has the empty text. Repeated rows
    each have a row. Character references are decoded. Of parts with equal sums the first counts. An
    empty table gives no rows. Other columns are not read. One page is held whole by one task.
    """
    words, tags = weights(pages, size)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [extract(p, words, tags) for p in batch.column("html").to_pylist()]
            return pa.record_batch(
                {
                    "page_id": batch.column("page_id"),
                    "url": batch.column("url"),
                    "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                }
            )

        return step

    read = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    return map_pieces(read, make, "page_id bigint, url string, text string, n_chars bigint", "html")
