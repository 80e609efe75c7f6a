"""Inversions of a sequence of ranks: counted, or listed at a cost of what is listed.

One pass a bit, from the highest: elements that agree above the bit stand together, in their order; an
element with the bit set before one without it is an inversion that no other pass sees.
"""

import numpy as np


def ranks_of(values: np.ndarray) -> np.ndarray:
    """0, 1, ... in the order of the values, equal for equal ones."""
    return np.unique(values, return_inverse=True)[1]


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for count[i] numbers each, one after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


def passes(ranks: np.ndarray):
    """For each bit (order, ones, first): the elements in the order of the pass, whether the bit is set,
    and for each where the run of its equals above the bit starts."""
    order = np.arange(len(ranks))
    for bit in range(int(ranks.max(initial=0)).bit_length() - 1, -1, -1):
        above = ranks[order] >> (bit + 1)
        ones = ((ranks[order] >> bit) & 1).astype(bool)
        new = np.ones(len(order), bool)
        new[1:] = above[1:] != above[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        yield order, ones, first
        order = order[np.argsort((above << 1) | ones, kind="stable")]


def inversion_weight(ranks: np.ndarray, weights: np.ndarray) -> int:
    """Sum of weights[i] * weights[j] over i < j with ranks[i] > ranks[j]."""
    total = 0
    for order, ones, first in passes(ranks):
        w = weights[order]
        upto = np.concatenate([[0], np.cumsum(np.where(ones, w, 0))])
        before = upto[:-1] - upto[first]
        total += int((np.where(ones, 0, w) * before).sum())
    return total


def inversion_pairs(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all i < j with ranks[i] > ranks[j]."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for order, ones, first in passes(ranks):
        held = order[ones]
        upto = np.concatenate([[0], np.cumsum(ones)])
        start, count = upto[first][~ones], (upto[:-1] - upto[first])[~ones]
        left.append(held[spread(start, count)])
        right.append(np.repeat(order[~ones], count))
    return np.concatenate(left), np.concatenate(right)
