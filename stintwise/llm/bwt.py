"""The Burrows-Wheeler transform and longest common prefixes of a collection of short strings, built
column by column: each round puts one more symbol in front of every string's suffix. The transform
and the prefixes live in external files that a round reads and writes from front to back."""

import tempfile
from typing import BinaryIO

import numpy as np


def _put(file: BinaryIO, values: np.ndarray) -> None:
    """Over what the file has: files only grow, and cutting one short first would send it to disk."""
    file.seek(0)
    file.write(values.data)


def _get(file: BinaryIO) -> np.ndarray:
    file.seek(0)
    return np.frombuffer(file.read(), np.uint8)


def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low..high]) of each closed interval; intervals in ascending order of `low`."""
    if not len(low):
        return np.zeros(0, values.dtype)
    edges = np.empty(2 * len(low), np.int64)
    edges[::2], edges[1::2] = low, high + 1
    padded = np.append(values, values.dtype.type(255))
    return np.minimum.reduceat(padded, edges)[::2]


def ranks(order: np.ndarray, starts: np.ndarray, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The ranks of `rows`, which hold `symbols`, in the stable order of a transform: `order` has each
    symbol's rows in ascending order from `starts[symbol]` on."""
    out = np.empty(len(rows), np.int64)
    by = np.argsort(symbols, kind="stable")
    cuts = np.flatnonzero(np.diff(symbols[by].astype(np.int64), prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(by)], strict=True):
        some = by[a:b]
        symbol = int(symbols[some[0]])
        first = int(starts[symbol])
        out[some] = first + np.searchsorted(order[first : int(starts[symbol + 1])], rows[some])
    return out


def collection_bwt(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bwt, lcp, row) of the strings that `text` (bytes) holds one after another.

    Rows are the suffixes of all strings in order, each string's end mark below every byte and below
    the marks of later strings; `bwt` has byte + 1, 0 for "starts its string", `lcp` the common
    prefix with the row before (255 at most), `row` the row of each whole string."""
    n = len(ends)
    lengths = np.diff(ends, prepend=0)
    symbol = text.astype(np.uint8) + np.uint8(1)  # no byte of UTF-8 is 255

    def before(strings: np.ndarray, size: int) -> np.ndarray:
        """The symbol in front of the suffix of `size` bytes."""
        more = lengths[strings] > size
        at = np.where(more, ends[strings] - size - 1, 0)
        return np.where(more, symbol[at] if len(symbol) else np.uint8(0), np.uint8(0))

    with tempfile.TemporaryFile() as bwt_file, tempfile.TemporaryFile() as lcp_file:
        _put(bwt_file, before(np.arange(n), 0))
        _put(lcp_file, np.zeros(n, np.uint8))
        row = np.arange(n)
        for size in range(1, int(lengths.max(initial=0)) + 1):
            strings = np.flatnonzero(lengths >= size)
            bwt, lcp = _get(bwt_file), _get(lcp_file)
            old = len(bwt)
            order = np.argsort(bwt, kind="stable")
            starts = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=256))])
            zeros = int(starts[1])
            at = ranks(order, starts, bwt[row[strings]], row[strings])
            place = at - zeros + n  # the last-to-first mapping: marks come first
            # Prefixes change at the new rows and at the rows that come to stand behind them.
            touch = np.zeros(old + 1, bool)
            touch[at] = touch[at + 1] = True
            touched = np.flatnonzero(touch[:old])
            here, prior = order[touched], order[touched - 1]
            same = (touched > 0) & (bwt[here] == bwt[prior])
            met = here[same]
            by = np.argsort(met, kind="stable")
            low, high = prior[same][by] + 1, met[by]
            found = np.zeros(len(touched), np.uint8)
            slots = np.flatnonzero(same)[by]
            found[slots] = np.minimum(_least_between(lcp, low, high), 254) + 1
            total = old + len(strings)
            is_new = np.zeros(total, bool)
            is_new[place] = True
            new_bwt, new_lcp = np.empty(total, np.uint8), np.empty(total, np.uint8)
            stay = ~is_new
            new_bwt[stay], new_lcp[stay] = bwt, lcp
            new_bwt[place] = before(strings, size)
            new_lcp[touched - zeros + n] = found
            _put(bwt_file, new_bwt)
            _put(lcp_file, new_lcp)
            # Whole strings keep their row, moved up by the rows put in before it.
            put = np.sort(place)
            row += np.searchsorted(put - np.arange(len(put)), row, side="right")
            row[strings] = place
        return _get(bwt_file), _get(lcp_file), row


def first_to_last(bwt: np.ndarray, n: int) -> np.ndarray:
    """For every row the row of its suffix without the first symbol; -1 for the `n` end marks."""
    order = np.argsort(bwt, kind="stable")
    zeros = int((bwt == 0).sum())
    shorter = np.full(len(bwt), -1, np.int64)
    shorter[n:] = order[zeros:]
    return shorter
