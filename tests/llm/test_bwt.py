import random
import tempfile

import numpy as np
import pytest

from stintwise.llm.bwt import collection_bwt, first_to_last


def brute(strings):
    rows = []
    for i, s in enumerate(strings):
        for k in range(len(s) + 1):
            rows.append((list(s[k:]), i, k))
    # end marks stand below every byte and in the order of the strings
    rows.sort(key=lambda r: [x + 1000 for x in r[0]] + [r[1]])
    bwt = [strings[i][k - 1] + 1 if k else 0 for _, i, k in rows]
    lcp = [0]
    for (a, *_), (b, *_) in zip(rows, rows[1:], strict=False):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        lcp.append(n)
    whole = {i: r for r, (_, i, k) in enumerate(rows) if k == 0}
    return bwt, lcp, [whole[i] for i in range(len(strings))]


@pytest.mark.parametrize("seed", range(25))
def test_transform_prefixes_and_rows_equal_sorted_suffixes(seed):
    rng = random.Random(seed)
    strings = [
        bytes(rng.choices(b"ab\xf4" if seed % 2 else b"abcdefgh ", k=rng.randint(0, 14)))
        for _ in range(rng.randint(1, 12))
    ]
    strings += rng.choices(strings, k=2)
    text = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum([len(s) for s in strings])
    bwt, lcp, row = collection_bwt(text, ends)
    want = brute(strings)
    assert (bwt.tolist(), lcp.tolist(), row.tolist()) == want
    shorter = first_to_last(bwt, len(strings))
    for s, r in zip(strings, row.tolist(), strict=True):
        for _ in s:
            r = int(shorter[r])
        assert 0 <= r < len(strings)


def test_rounds_write_over_their_files(monkeypatch):
    """A file that is cut short and written anew goes to disk each time; a round writes over it."""
    opened, make = [], tempfile.TemporaryFile
    monkeypatch.setattr(tempfile, "TemporaryFile", lambda *a, **b: opened.append(1) or make(*a, **b))
    strings = [b"banana", b"ananas", b"nab"]
    bwt, lcp, row = collection_bwt(
        np.frombuffer(b"".join(strings), np.uint8), np.cumsum([len(s) for s in strings])
    )
    assert (bwt.tolist(), lcp.tolist(), row.tolist()) == brute(strings)
    assert len(opened) == 2
