"""Similarity by matching blocks, for many pairs of texts at once.

The longest block that two texts share, the first one at ties, cuts both into a
part before and a part after, which are searched in turn; the ratio is twice the
characters in blocks over all characters. In a second text of 200 characters or
more, a character on over one place in a hundred starts no block, but extends
one. All open parts of all pairs of a batch are searched side by side: a round
fills one row of every table of common suffixes by array steps, so its cost in
Python depends on the length of the texts, not on their number.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np

#: Second texts from this length on have popular characters: those on more than length // 100 + 1 places.
LONG = 200
#: Up to this many pieces are tried in every order.
PERMUTED = 6
#: Entries of one row of tables that is held at once.
CELLS = 1 << 18
#: What stands beyond the end of a first and of a second text; no code point, and not equal.
END_A, END_B = 0xFFFFFFFF, 0xFFFFFFFE


class Codes:
    """Texts as code points, one after the other."""

    def __init__(self, texts: list[str]):
        held = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        self.size = np.array([len(x) for x in held], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.all = np.concatenate([*held, np.zeros(1, np.uint32)])

    def part(self, text: np.ndarray, low: np.ndarray, high: np.ndarray, end: int, values: np.ndarray | None = None) -> np.ndarray:
        """Characters low to high of each text, padded with ``end`` to equal length."""
        at = np.arange(max(1, int((high - low).max(initial=1))))
        inside = at < (high - low)[:, None]
        places = np.where(inside, (self.first[text] + low)[:, None] + at, len(self.all) - 1)
        return np.where(inside, (self.all if values is None else values)[places], np.array(end, np.uint32 if values is None else values.dtype))


def _popular(b: Codes) -> np.ndarray:
    """True for each place of a long text whose character is popular in that text."""
    out = np.zeros(len(b.all), bool)
    for i in np.flatnonzero(b.size >= LONG).tolist():
        low, high = int(b.first[i]), int(b.first[i] + b.size[i])
        _, number, count = np.unique(b.all[low:high], return_inverse=True, return_counts=True)
        out[low:high] = count[number] > (high - low) // 100 + 1
    return out


def _longest(a: Codes, b: Codes, popular: np.ndarray, pair: np.ndarray, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in a, start in b and length of the longest block of each part, the first in a and then in b at ties; length 0 without one."""
    left, right = a.part(pair, alo, ahi, END_A), b.part(pair, blo, bhi, END_B)
    seed = np.where(b.part(pair, blo, bhi, False, popular), END_B, right) if popular.any() else right
    rows = np.arange(len(pair))
    size, i, j = (np.zeros(len(pair), np.int64) for _ in range(3))
    suffix = np.zeros((len(pair), right.shape[1] + 1), np.int32)
    for at in range(left.shape[1]):
        suffix[:, 1:] = np.where(seed == left[:, at, None], suffix[:, :-1] + 1, 0)
        end = suffix.argmax(axis=1)
        k = suffix[rows, end]
        more = k > size
        size[more], i[more], j[more] = k[more], at + 1 - k[more], end[more] - k[more]
    i, j = alo + i, blo + j
    if popular.any():
        # Equal neighbours join the block, whatever they are; without a block the part has none before its start.
        last = len(a.all) - 1, len(b.all) - 1
        char = lambda codes, at: codes.all[np.minimum(codes.first[pair] + at, last[0] if codes is a else last[1])]
        while True:
            more = (i > alo) & (j > blo) & (char(a, np.maximum(i - 1, 0)) == char(b, np.maximum(j - 1, 0)))
            if not more.any():
                break
            i, j, size = i - more, j - more, size + more
        while True:
            more = (i + size < ahi) & (j + size < bhi) & (char(a, i + size) == char(b, j + size))
            if not more.any():
                break
            size = size + more
    return i, j, size


def ratios(first: list[str], second: list[str]) -> np.ndarray:
    """The ratio of each pair of texts; the order of the two matters. Two empty texts have 1."""
    a, b = Codes(first), Codes(second)
    popular = _popular(b)
    matched = np.zeros(len(first), np.int64)
    pair = np.arange(len(first))
    parts = np.stack([pair, np.zeros_like(pair), a.size, np.zeros_like(pair), b.size])
    parts = parts[:, (a.size > 0) & (b.size > 0)]
    while parts.shape[1]:
        # Parts of like size are searched together, so that little is padded.
        width = np.maximum(parts[2] - parts[1], parts[4] - parts[3])
        parts = parts[:, np.argsort(width, kind="stable")]
        width = np.sort(width)
        opened, low = [], 0
        while low < len(width):
            high = int(np.searchsorted(width, max(2 * width[low], 8), side="right"))
            high = min(high, low + max(1, CELLS // int(width[high - 1] + 1)))
            p, alo, ahi, blo, bhi = parts[:, low:high]
            i, j, k = _longest(a, b, popular, p, alo, ahi, blo, bhi)
            np.add.at(matched, p, k)
            for some in ((p, alo, i, blo, j), (p, i + k, ahi, j + k, bhi)):
                some = np.stack(some)
                opened.append(some[:, (k > 0) & (some[2] > some[1]) & (some[4] > some[3])])
            low = high
        parts = np.concatenate(opened, axis=1)
    total = a.size + b.size
    return np.where(total > 0, 2.0 * matched / np.maximum(total, 1), 1.0)


def best_orders(targets: list[str], pieces: list[list[str]], held: int = 1 << 14) -> tuple[list[str], np.ndarray]:
    """Of each target the concatenation of its non-empty pieces that is most similar to it, and that ratio.

    Up to ``PERMUTED`` pieces are tried in every order, the first best order
    wins; more are taken as they are. Without a piece the text is empty and the
    ratio 0. Orders that give one text are tried once; ``held`` orders or a few
    more are compared at a time.
    """
    texts, scores = [""] * len(targets), np.zeros(len(targets))
    row: list[int] = []
    tried: list[str] = []

    def close() -> None:
        if not row:
            return
        at = np.array(row)
        found = ratios([targets[i] for i in row], tried)
        # The first of the best: rows are in order, and so are the orders of a row.
        order = np.lexsort((np.arange(len(at)), -found, at))
        top = order[np.r_[True, at[order][1:] != at[order][:-1]]]
        for t in top.tolist():
            texts[row[t]], scores[row[t]] = tried[t], found[t]
        row.clear()
        tried.clear()

    for i, given in enumerate(pieces):
        used = [p for p in given if p]
        if used:
            joined = list(dict.fromkeys(map("".join, permutations(used)))) if len(used) <= PERMUTED else ["".join(used)]
            row += [i] * len(joined)
            tried += joined
            if len(row) >= held:
                close()
    close()
    return texts, scores
