"""Token counts of a unigram tokenizer without its ids.

Words (a space mark and what follows) are counted once each: an Aho-Corasick automaton lists the
vocabulary matches that end at every character, and dynamic programming carries the best score and the
piece count up to it. The rules are those of the `tokenizers` library's Unigram model behind its
Metaspace splitter: scores add up as doubles from the left, of equal scores the piece that starts
first (the longest) stays, a character without piece costs the least score less 10, runs of such
characters are one unknown piece, or their bytes if the vocabulary has them.
"""

import itertools

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.llm.batches import map_pieces

MARK = "▁"
UNKNOWN_COST = 10.0
MEMO = 200_000
TEXTS = 4_000_000
SHORT, TOGETHER = 48, 20_000  # characters of words that are walked together, and so many words at once
SEPARATOR = "\U0010fffe"  # no character


def unigram_vocabulary(model_file: str) -> tuple[list[tuple[str, float]], int]:
    """(pieces with scores, id of the unknown piece) of a SentencePiece file, scores as they stand."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.vocab_size())], sp.unk_id()


class Counter:
    """Pieces and score of words, known or worked out. Known words are kept in two generations: when the
    newer one is full it becomes the older, and words met again move over, so the frequent stay."""

    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int, byte_fallback: bool = True):
        kept = [(p, s) for i, (p, s) in enumerate(vocabulary) if i != unknown and p]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, (piece, _) in enumerate(kept):
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        last = {p: s for p, s in kept}  # of equal pieces the last counts, as the automaton keeps it
        self.length = np.array([len(p) for p, _ in kept], np.int64)
        self.score = np.array([last[p] for p, _ in kept], np.float64)
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_COST
        names = {p for p, _ in vocabulary}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        self.apart = not any(SEPARATOR in p for p in names)
        self.new: dict[str, tuple[int, float]] = {}
        self.old: dict[str, tuple[int, float]] = {}

    def known(self, words: list[str]) -> dict[str, tuple[int, float]]:
        """(pieces, score) of all `words`, and perhaps of others."""
        if len(self.new) >= MEMO:
            self.old, self.new = self.new, {}
        missing = set(words).difference(self.new)
        for w in missing.intersection(self.old):
            self.new[w] = self.old[w]
        missing.difference_update(self.new)
        short = [w for w in missing if len(w) <= SHORT and SEPARATOR not in w] if self.apart else []
        for start in range(0, len(short), TOGETHER):
            some = short[start : start + TOGETHER]
            self.new.update(zip(some, self.walked(some), strict=True))
        for w in missing.difference(short):
            self.new[w] = self.walk(w)
        return self.new

    def walk(self, word: str) -> tuple[int, float]:
        """One word, character by character."""
        n = len(word)
        best: list[float] = [0.0] * (n + 1)
        count = [0] * (n + 1)
        run = [False] * (n + 1)  # an unknown character ends here
        ends: list[list[int]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(word):
            ends[end].append(match)
        length, score = self.length, self.score
        for end in range(1, n + 1):
            # Longest first, as the automaton tells them, so that of equal scores the piece that starts
            # first stays.
            top, size, known = None, 0, False
            for match in ends[end - 1]:
                reach = int(length[match])
                whole = best[end - reach] + float(score[match])
                known |= reach == 1
                if top is None or whole > top:
                    top, size = whole, reach
            if not known:
                whole = best[end - 1] + self.unknown
                if top is None or whole > top:
                    top, size = whole, 0
            best[end] = top
            if size:
                count[end] = count[end - size] + 1
            elif self.bytes:
                count[end] = count[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
            else:
                count[end] = count[end - 1] + (not run[end - 1])
                run[end] = True
        return count[n], best[n]

    def walked(self, words: list[str]) -> list[tuple[int, float]]:
        """Many words at once, by the same steps: the automaton goes over all of them in one string, then
        all words are taken one character further together."""
        text = SEPARATOR.join(words)
        sizes = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(sizes + 1) - (sizes + 1)  # a word's node 0; node i is after its i-th character
        found = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(text)), np.int64)
        end, match = found[::2] + 1, found[1::2]
        reach, score = self.length[match], self.score[match]
        lone = np.ones(len(text) + 1, bool)  # no piece of one character ends here
        lone[end[reach == 1]] = False
        lone[first] = False
        bare = np.flatnonzero(lone)
        node = np.concatenate([end, bare])
        reach = np.concatenate([reach, np.ones(len(bare), np.int64)])
        score = np.concatenate([score, np.full(len(bare), self.unknown)])
        piece = np.concatenate([np.ones(len(end), bool), np.zeros(len(bare), bool)])
        place = np.arange(len(text) + 1) - np.repeat(first, sizes + 1)
        # by place, then by word, the longest piece first
        order = np.argsort(((place[node] << 32) + node << 6) - reach, kind="stable")
        node, reach, score, piece = node[order], reach[order], score[order], piece[order]
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        width = 1 + (codes > 0x7F) + (codes > 0x7FF).astype(np.int64) + (codes > 0xFFFF)
        best, count = np.zeros(len(text) + 1), np.zeros(len(text) + 1, np.int64)
        run = np.zeros(len(text) + 1, bool)
        steps = np.flatnonzero(np.diff(place[node], prepend=-1)).tolist()
        for a, b in zip(steps, [*steps[1:], len(node)], strict=True):
            here = node[a:b]
            whole = best[here - reach[a:b]] + score[a:b]
            new = np.ones(b - a, bool)
            new[1:] = here[1:] != here[:-1]
            group = np.cumsum(new) - 1
            top = np.maximum.reduceat(whole, np.flatnonzero(new))
            at = np.flatnonzero(whole == top[group])
            at = at[np.diff(group[at], prepend=-1) > 0]  # the first of equal ones is the longest
            to, back, known = here[at], here[at] - reach[a:b][at], piece[a:b][at]
            best[to] = top
            more = width[to - 1] if self.bytes else (~run[back]).astype(np.int64)
            count[to] = count[back] + np.where(known, 1, more)
            run[to] = ~known & (not self.bytes)
        last = first + sizes
        return list(zip(count[last].tolist(), best[last].tolist(), strict=True))


def marked_words(text: str | None) -> list[str]:
    """The words of a text: a mark in front of the text unless it starts with one, split before
    every mark."""
    if not text:
        return []
    if MARK not in text and SEPARATOR not in text:
        body = text if text[0] == " " else " " + text
        return body.replace(" ", SEPARATOR + MARK).split(SEPARATOR)[1:]
    marked = text.replace(" ", MARK)
    head, *rest = marked.split(MARK)
    return [MARK + w for w in (rest if marked.startswith(MARK) else [head, *rest])]


def token_counts(
    docs: DataFrame, vocabulary: list[tuple[str, float]], unknown: int, byte_fallback: bool = True
) -> DataFrame:
    """(doc_id, n_tokens, score) of every row of `docs` (doc_id, text, any more): the piece count and
    the score of the best segmentation of its whole text, without a special token.

    Null and empty texts have 0 pieces and score 0. Repeated rows each come out, rows without a
    doc_id too; other columns are not read. The vocabulary is a fixed table, sent to the executors."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, unknown, byte_fallback))

    def make():
        counter = Counter(*shared.value)

        def step(piece: pa.RecordBatch) -> pa.RecordBatch:
            split = [marked_words(t) for t in piece.column("text").to_pylist()]
            words = list(itertools.chain.from_iterable(split))
            known = counter.known(words)
            number = {w: i for i, w in enumerate(dict.fromkeys(words))}
            told = [known[w] for w in number] or [(0, 0.0)]
            at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            pieces = np.array([c for c, _ in told], np.int64)[at]
            scores = np.array([x for _, x in told], np.float64)[at]
            ends = np.cumsum([len(s) for s in split])
            upto = np.concatenate([[0], np.cumsum(pieces)])
            begins = np.concatenate([[0], ends[:-1]])
            score = [float(scores[a:b].sum()) for a, b in zip(begins, ends, strict=True)]
            return pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(upto[ends] - upto[begins]), pa.array(score)],
                ["doc_id", "n_tokens", "score"],
            )

        return step

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return map_pieces(rows, make, "doc_id bigint, n_tokens bigint, score double", "text", TEXTS)
