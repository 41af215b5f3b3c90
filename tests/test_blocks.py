"""Matching blocks of many pairs at once against the standard library, one pair at a time."""

import difflib
import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkframe.functions import blocks


def plain(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab é🙂", max_size=12), st.text("ab é🙂", max_size=12)), max_size=12))
def test_ratios_of_short_texts(pairs):
    got = blocks.ratios([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [plain(a, b) for a, b in pairs]


@pytest.mark.parametrize("cells", [1, 1 << 18])
def test_ratios_of_long_texts(monkeypatch, cells):
    """Popular characters of long second texts start no block, but extend one."""
    monkeypatch.setattr(blocks, "CELLS", cells)
    rng = random.Random(3)
    pairs = [("a" * 300, "a" * 300), ("", "b" * 250), ("x" + "a" * 250, "a" * 250 + "x"), ("ab" * 150 + "q", "q" + "ab" * 150)]
    for n in (199, 200, 201, 450):
        x = "".join(rng.choice("abcdefghij    ") for _ in range(n))
        y = "".join(c if rng.random() < 0.9 else rng.choice("xyz#") for c in x)
        pairs += [(x, y), (y, x), (x[50:], y[:-30])]
    assert blocks.ratios(*map(list, zip(*pairs, strict=True))).tolist() == [plain(a, b) for a, b in pairs]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=8), st.lists(st.text("abc", max_size=3), max_size=5)), max_size=6), st.sampled_from([1, 1000]))
def test_best_orders(rows, held):
    texts, scores = blocks.best_orders([t for t, _ in rows], [p for _, p in rows], held)
    for (target, pieces), text, score in zip(rows, texts, scores, strict=True):
        best = ("", 0.0) if not any(pieces) else ("", -1.0)
        for order in itertools.permutations([p for p in pieces if p]) if any(pieces) else ():
            if plain(target, "".join(order)) > best[1]:
                best = "".join(order), plain(target, "".join(order))
        assert (text, score) == best


def test_many_pieces_stay_in_order():
    assert blocks.best_orders(["abcdefg"], [list("gfedcba")])[0] == ["gfedcba"]
