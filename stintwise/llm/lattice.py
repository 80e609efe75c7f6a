"""Lattices of a SentencePiece vocabulary over texts.

A text is cut where no piece can reach across (before runs of the space mark, around line ends), and
equal chunks share one lattice. Each edge holds its probability given its start: the piece's weight
times the weight of all ways on to the chunk's end, over those from its start. Walking edges by these
probabilities draws a segmentation with the probability the vocabulary gives it.
"""

import functools
import re

import numpy as np
import sentencepiece
import xxhash

from stintwise.llm.shingles import mix

SPACE = "▁"
EDGES = 2_000_000  # kept between pieces of a task; beyond, lattices are built anew
PENALTY = 10.0  # of a character without piece, below the least piece, for each of its bytes
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 16
_PREFIX_BITS = 18


class Vocabulary:
    """Pieces and natural-log probabilities of a model file. Merge ranks, as byte-pair models keep
    for scores (whole numbers from 0 down), are read by Zipf's law: the piece of rank r weighs
    1 / (r + 1)."""

    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        plain = [
            i
            for i in range(n)
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        ]
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        score = np.array([sp.get_score(i) for i in plain])
        if len(score) > 1 and (score == np.rint(score)).all() and score.max() <= 0:
            score = -np.log1p(-score)
            score -= np.log(np.exp(score).sum())
        self.byte = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        self.byte_ids = [self.byte.get(f"<0x{b:02X}>", sp.unk_id()) for b in range(256)]
        self.byte_score = float(score.min(initial=0.0)) - PENALTY
        self.ascii_ids = np.array(self.byte_ids[:128])
        self.raw = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            if f"<0x{b:02X}>" in self.byte:
                self.raw[i] = bytes([b])
        kept = [(self.pieces[i], i, s) for i, s in zip(plain, score.tolist(), strict=True)]
        self.longest = max((len(p) for p, *_ in kept), default=1)
        mark = re.compile(f"{SPACE}*[^{SPACE}]*")
        self.cut_spaces = all(mark.fullmatch(p) for p, *_ in kept)
        self.cut_lines = not any("\n" in p for p, *_ in kept)
        self.tables = []
        self.longer = []  # by length, whether a prefix with this fingerprint may begin a longer piece
        for length in range(1, self.longest + 1):
            own = [k for k in kept if len(k[0]) == length]
            heads = {p[:length] for p, *_ in kept if len(p) > length}
            h = prints(np.array([[ord(c) for c in p] for p in heads], np.uint32).reshape(-1, length))
            self.longer.append(np.zeros(1 << _PREFIX_BITS, bool))
            self.longer[-1][(h >> np.uint64(64 - _PREFIX_BITS)).astype(np.int64)] = True
            h = prints(np.array([[ord(c) for c in p] for p, *_ in own], np.uint32).reshape(-1, length))
            order = np.argsort(h)
            h = h[order]
            slots = (h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
            held = np.bincount(slots, minlength=1 << _SLOT_BITS)
            slot = np.minimum(np.cumsum(held) - held, max(len(h) - 1, 0)).astype(np.int32)
            ids = np.array([i for _, i, _ in own], np.int32)[order]
            scores = np.array([s for *_, s in own])[order]
            self.tables.append((h, ids, scores, slot, int(held.max())) if own else None)

    def chunks(self, text: str) -> list[str]:
        """The text's chunks, with the space mark in front as the model puts it; none of ''."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        if not self.cut_spaces:
            return [marked]
        if SPACE * 2 in marked or "\x01" in marked or not self.cut_lines:
            lines = "\n" if self.cut_lines else ""
            return re.findall(f"{SPACE}+[^{SPACE}{lines}]*|[^{SPACE}{lines}]+|\n", marked)
        parts = marked.replace(SPACE, "\x01" + SPACE).replace("\n", "\x01\n\x01").split("\x01")
        return [p for p in parts if p]

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids, without the space put in front."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw[1:] if raw[:1] == b" " else raw


def prints(codes: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of code points, as `Lattices.add` extends them symbol by symbol."""
    h = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        h = h * _STEP + mix(codes[:, k].astype(np.uint64) + np.uint64(1))
    return mix(h)


def uniforms(seeds: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for every seed."""
    x = mix(seeds ^ mix(np.full(1, salt, np.uint64) * _STEP + np.uint64(1)))
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for count[i] values each, one after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


class Lattices:
    """Lattices of distinct chunks in shared arrays: nodes are character positions, edges pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.start: dict[str, int] = {}
        self.nodes = self.edges = 0
        self.first, self.degree = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.end = np.zeros(1024, bool)
        self.source, self.to, self.piece = (np.zeros(4096, np.int32) for _ in range(3))
        self.log_q, self.upto = np.zeros(4096), np.zeros(4096)

    def _room(self, names: list[str], size: int) -> None:
        for name in names:
            old = getattr(self, name)
            if len(old) < size:
                new = np.zeros(max(size, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)

    def look_up(self, chunks: list[str]) -> np.ndarray:
        """The first node of every chunk's lattice."""
        if self.edges > EDGES:
            self.clear()
        new = set(chunks).difference(self.start)
        if new:
            self.add(list(new))
        return np.fromiter(map(self.start.__getitem__, chunks), np.int64, len(chunks))

    def add(self, chunks: list[str]) -> None:
        v = self.vocabulary
        lengths = np.array([len(c) for c in chunks], np.int64)
        ends = np.cumsum(lengths)
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        left = np.repeat(ends, lengths) - np.arange(len(codes))
        symbols = mix(codes.astype(np.uint64) + np.uint64(1))
        hits: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []
        single = np.zeros(len(codes), bool)
        h = np.zeros(0, np.uint64)
        live = np.arange(len(codes))
        for length, known in enumerate(v.tables, 1):
            stay = left[live] >= length
            live, h = live[stay], h[stay] if length > 1 else np.zeros(len(live), np.uint64)
            if not len(live):
                break
            h = h * _STEP + symbols[live + length - 1]
            whole = mix(h)
            on = v.longer[length - 1][(whole >> np.uint64(64 - _PREFIX_BITS)).astype(np.int64)]
            if known is None:
                live, h = live[on], h[on]
                continue
            table, ids, scores, slot, most = known
            near = slot[(whole >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)]
            hit = table[near] == whole
            for more in range(1, most):
                next_ = np.minimum(near + more, len(table) - 1)
                again = ~hit & (table[next_] == whole)
                near = np.where(again, next_, near)
                hit |= again
            here, near = live[hit], near[hit]
            hits.append((here, length, ids[near], scores[near]))
            if length == 1:
                single[here] = True
            live, h = live[on], h[on]
        bare = np.flatnonzero(~single)  # characters without piece: their bytes
        code = codes[bare]
        width = 1 + (code > 0x7F) + (code > 0x7FF).astype(int) + (code > 0xFFFF)
        own = np.where(code < 0x80, v.ascii_ids[np.minimum(code, 0x7F)], len(v.pieces) + code)
        hits.append((bare, 1, own.astype(np.int32), width * v.byte_score))

        # A chunk of n characters has nodes base..base + n; a node's edges go from long to short.
        base = self.nodes + np.cumsum(lengths + 1) - (lengths + 1)
        node = np.arange(len(codes)) + np.repeat(base - (ends - lengths), lengths) - self.nodes
        total = int((lengths + 1).sum())
        degree = np.zeros(total, np.int64)
        for here, *_ in hits:
            degree[node[here]] += 1
        first = np.cumsum(degree) - degree
        count = int(degree.sum())
        source, to = np.repeat(np.arange(total), degree), np.empty(count, np.int64)
        piece, score = np.empty(count, np.int32), np.empty(count)
        free = first + degree
        for here, length, ids, scores in hits:
            at = node[here]
            free[at] -= 1
            slot = free[at]
            to[slot], piece[slot], score[slot] = at + length, ids, scores
        beta = np.zeros(total)
        by_left = np.argsort(left, kind="stable")
        cuts = np.flatnonzero(np.diff(left[by_left], prepend=0))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by_left)], strict=True):
            here = node[by_left[a:b]]
            count = degree[here]
            edge = _spread(first[here], count)
            x = score[edge] + beta[to[edge]]
            begins = np.cumsum(count) - count
            top = np.maximum.reduceat(x, begins)
            beta[here] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, count)), begins))
        log_q = np.minimum(score + beta[to] - beta[source], 0.0)
        log_q[degree[source] == 1] = 0.0
        q = np.exp(log_q)
        upto = q.copy()
        many = np.flatnonzero(degree)
        for k in range(1, int(degree.max(initial=0))):
            many = many[degree[many] > k]
            upto[first[many] + k] += upto[first[many] + k - 1]
        some = np.flatnonzero(degree)
        upto[first[some] + degree[some] - 1] = 2.0  # the last edge takes what rounding leaves

        n0, e0 = self.nodes, self.edges
        n1, e1 = n0 + total, e0 + len(to)
        self._room(["first", "degree", "end"], n1)
        self._room(["source", "to", "piece", "log_q", "upto"], e1)
        self.first[n0:n1], self.degree[n0:n1], self.end[n0:n1] = first + e0, degree, degree == 0
        self.source[e0:e1], self.to[e0:e1], self.piece[e0:e1] = source + n0, to + n0, piece
        self.log_q[e0:e1], self.upto[e0:e1] = log_q, upto
        self.nodes, self.edges = n1, e1
        self.start.update(zip(chunks, base.tolist(), strict=True))

    def walk(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, edges): a drawn path from every node to its chunk's end, one after another."""
        steps = []
        live, here, t = np.arange(len(nodes)), nodes, 0
        while len(live):
            u = uniforms(seeds[live], t)
            edge = self.first[here]
            on = np.flatnonzero(u >= self.upto[edge])
            while len(on):
                edge[on] += 1
                on = on[u[on] >= self.upto[edge[on]]]
            steps.append((live, edge))
            here = self.to[edge]
            more = ~self.end[here]
            live, here, t = live[more], here[more], t + 1
        counts = np.zeros(len(nodes), np.int64)
        for live, _ in steps:
            counts[live] += 1
        begins = np.cumsum(counts) - counts
        edges = np.zeros(int(counts.sum()), np.int64)
        for t, (live, edge) in enumerate(steps):
            edges[begins[live] + t] = edge
        return counts, edges

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of a path; characters without piece give the ids of their bytes."""
        n = len(self.vocabulary.pieces)
        found = self.piece[edges]
        if len(found) == 0 or int(found.max()) < n:
            return found
        out: list[int] = []
        for p in found.tolist():
            if p < n:
                out.append(p)
            else:
                raw = chr(p - n).encode("utf-8", "surrogatepass")
                out += [self.vocabulary.byte_ids[b] for b in raw]
        return np.array(out, np.int32)


@functools.cache
def shared_lattices(model_file: str) -> Lattices:
    """One for each worker process, which outlives a task."""
    return Lattices(Vocabulary(model_file))


def row_seed(key: int | None, seed: int) -> int:
    return xxhash.xxh64_intdigest(str(key).encode(), seed)
