"""Vector codes, near-duplicate vectors and hard negatives against plain loops, on small and awkward tables."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkframe.llm import codes, negatives, subspace
from inkframe.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int"
INF, NAN = float("inf"), float("nan")


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def rows_of(spark, folder):
    return [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def clustered(seed, n=160, width=16, groups=6, spread=0.05):
    """Clusters with exact copies, scaled copies, near copies, rows of no use, and null labels."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, width))
    rows = []
    for i in range(n):
        g = int(rng.integers(groups))
        rows.append((i, (centres[g] + spread * rng.standard_normal(width)).tolist(), int(rng.integers(3)) if rng.random() > 0.1 else None))
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(40)]
    rows += [(1100 + i, [x * (2.0 + i) for x in rows[1][1]], rows[1][2]) for i in range(5)]
    odd = [None, [], [0.0] * width, [None] + [1.0] * (width - 1), [INF] + [1.0] * (width - 1), [NAN] + [1.0] * (width - 1), [-0.0] * width]
    return rows + [(1200 + i, v, 1) for i, v in enumerate(odd)]


# ---- vector codes ------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = sorted(((i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if usable(v)), key=lambda r: (r[0], r[1]))
    if not kept:
        return [], ""
    step = len(kept[0][1]) // parts
    cut = lambda v, p: tuple(v[p * step : (p + 1) * step])
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v, entry, strict=True)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        sums = defaultdict(lambda: ([0] * step, [0]))
        for _, v, _ in kept:
            for p in range(parts):
                total, n = sums[p, nearest(cut(v, p), p)[1]]
                n[0] += 1
                for i, x in enumerate(cut(v, p)):
                    total[i] += x
        for (p, e), (total, n) in sums.items():
            books[p][e] = tuple(x // n[0] for x in total)
    out, of_label = [], Counter()
    for i, v, label in kept:
        found = [nearest(cut(v, p), p) for p in range(parts)]
        error = sum(d for d, _ in found)
        of_label[label] += error
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, label))
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return sorted((i, c, e, of_label[label]) for i, c, e, label in out), hashlib.sha256(text.encode()).hexdigest()


def op11(spark, data, monkeypatch):
    """The query over a given table."""
    from inkframe.llm import queries

    monkeypatch.setattr(queries, "table", lambda *_: data)
    got = QUERIES["op11_vector_codes"](spark, "").collect()
    return sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), {r["codebooks_sha256"] for r in got}


@pytest.mark.parametrize("case", ["clustered", "few", "copies"])
def test_codes_against_a_plain_loop(spark, monkeypatch, case):
    rows = clustered(1)
    if case == "few":
        rows = rows[:5] + rows[-3:]
    if case == "copies":  # every row is one of two vectors, and one value fills whole parts
        rows = [(i, rows[i % 2][1] if i % 3 else [-0.30001] * 16, None if i % 2 else 4) for i in range(90)]
    got, sha = op11(spark, frame(spark, rows), monkeypatch)
    want, digest = plain_codes(rows)
    assert got == want and sha == {digest}


def test_codes_of_hot_parts(spark):
    """With every part hot, and with none, the codes are the same."""
    rows = frame(spark, clustered(2))
    a, b = (codes.compress(rows, s=codes.Settings(hot_share=h)) for h in (1, 10**6))
    plain = lambda c: sorted((r["vec_id"], tuple(r["codes"]), r["error"]) for r in c.rows.collect())
    assert plain(a) == plain(b) and (a.books == b.books).all()


def test_codes_decode_to_their_entries(spark):
    made = codes.compress(frame(spark, clustered(3)))
    vectors = {r["vec_id"]: r["embedding"] for r in frame(spark, clustered(3)).collect()}
    for r in made.decode().collect():
        steps = [x * 4096 for x in r["decoded"]]
        assert sum((math.floor(4096 * a) - b) ** 2 for a, b in zip(vectors[r["vec_id"]], steps, strict=True)) == r["error"]


def test_codes_edge_cases(spark, monkeypatch):
    assert op11(spark, frame(spark, []), monkeypatch) == ([], set())
    assert op11(spark, frame(spark, [(1, None, 1), (2, [NAN] * 8, 1)]), monkeypatch) == ([], set())
    rows = [(None, [1.0] * 8, 1), (3, [0.5] * 8, None), (3, [0.25] * 8, 2), (4, [1.0] * 8, 1), (5, [1.0] * 3, 1)]
    clash = frame(spark, rows).withColumns({c: F.lit("x") for c in ("row", "part", "position", "weight", "code", "error", "id", "v", "codes", "n")})
    made = codes.compress(clash)
    assert sorted((r["vec_id"] is None, r["vec_id"], r["error"]) for r in made.rows.collect())[:3] == [(False, 3, 0), (False, 3, 0), (False, 4, 0)]
    assert made.books[0].ravel().tolist() == [1024, 2048, 4096, 4096]  # ids 3, 3, 4 and the null id last
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(frame(spark, [(1, [1.0] * 9, 1)]))
    with pytest.raises(ValueError, match="too large"):
        codes.compress(frame(spark, [(1, [1e30] * 8, 1)]))


def test_ties_go_to_the_lower_code():
    book = np.array([[0], [2], [2]])
    assert codes.nearest(np.array([[1], [2], [3]]), book)[0].tolist() == [0, 1, 1]


# ---- near-duplicate vectors --------------------------------------------------------


def plain_links(rows, cosine=0.93):
    """Each row's links, least reachable id and verdict, in the rows' order; rows are nodes."""
    n = len(rows)
    widths = Counter(len(v) for _, v, label in rows if label is not None and usable(v) and any(v))
    width = min(widths, key=lambda w: (-widths[w], w)) if widths else 0
    part = [i for i, (_, v, label) in enumerate(rows) if label is not None and usable(v) and any(v) and len(v) == width]
    unit = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in part}
    unit = {i: x / np.sqrt(x @ x) for i, x in unit.items()}
    near = {i: [j for j in part if j != i and rows[i][2] == rows[j][2] and (rows[i][1] == rows[j][1] or unit[i] @ unit[j] >= cosine)] for i in part}
    top = [None] * n
    for i in range(n):
        if top[i] is None:
            seen, todo = {i}, [i]
            while todo:
                for j in near.get(todo.pop(), ()):
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
            for j in seen:
                top[j] = (least,)
    return sorted(((rows[i][0], len(near.get(i, ())), top[i][0], rows[i][0] is not None and rows[i][0] == top[i][0]) for i in range(n)), key=repr)


def links(data, **chosen):
    got = subspace.near_vectors(data, s=subspace.Settings(**chosen))
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got.collect()), key=repr)


@pytest.mark.parametrize("chosen", [{}, {"chunk": 16, "blocks": 4}, {"chunk": 7, "blocks": 3, "most_cells": 2, "sample": 20}])
def test_links_against_all_pairs(spark, chosen):
    rows = clustered(4, spread=0.28)
    want = plain_links(rows)
    assert 3 < len({r[2] for r in want if r[1]}) and any(0 < r[1] < 5 for r in want)
    assert links(frame(spark, rows), **chosen) == want


def test_links_of_a_large_group_and_a_chain(spark):
    """A group of near copies over many chunks, and a chain that only neighbours link."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(12)
    rows = [(i, (centre + 0.03 * rng.standard_normal(12)).tolist(), 1) for i in range(300)]
    rows += [(1000 - i, [math.cos(0.3 * i), math.sin(0.3 * i)] + [0.0] * 10, 2) for i in range(10)]
    got = links(frame(spark, rows), chunk=32)
    assert got == plain_links(rows)
    assert all(r[1] == 299 and r[2] == 0 for r in got if r[0] < 300)
    assert {r[2] for r in got if 900 < r[0]} == {991}


def test_links_edge_cases(spark):
    assert links(frame(spark, [])) == []
    assert links(frame(spark, [(1, None, 1), (2, [1.0], None)])) == [(1, 0, 1, True), (2, 0, 2, True)]
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (6, [1.0, 0.1], 1), (7, [0.1, 1.0], 1), (None, [1.0, 0.05], 1), (None, [-1.0, 0.0], 1),
            (8, [1e200, 0.0], 1), (9, [5e-324, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0, 0.0], 1), (2, [0.0, 0.0], 1), (10, [1.0, 0.0], 1), (10, [1.0, 0.0], 1)]
    clash = frame(spark, rows).withColumns({c: F.lit("x") for c in ("c", "g", "n", "k", "cell", "size", "least", "id", "v", "a", "b", "p", "kept", "component")})
    assert links(clash) == plain_links(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 24), st.integers(1, 8), st.integers(0, 10**6), st.floats(0.5, 0.999))
def test_no_link_is_beyond_every_budget(width, blocks, seed, cosine):
    """Pairs at that cosine exactly, and nearer, are candidates; so are the chunks that hold them."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((20, width))
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    other = rng.standard_normal((20, width))
    other -= (other * x).sum(axis=1, keepdims=True) * x
    other /= np.sqrt((other**2).sum(axis=1, keepdims=True))
    angle = rng.uniform(0, math.acos(cosine), (20, 1))
    angle[0] = math.acos(cosine)
    y = np.cos(angle) * x + np.sin(angle) * other
    bounds = np.linspace(0, width, min(blocks, width) + 1).astype(int).tolist()
    space = subspace.Space(subspace.random_rotation(width, seed), bounds, rng.standard_normal((3, width)), 2 - 2 * cosine)
    assert np.diag(space.candidates(x @ space.rotation, y @ space.rotation)).all()
    a, b = np.zeros(20, int), np.full(20, 2)
    assert space.may_meet(a, space.reach(x @ space.rotation, a), b, space.reach(y @ space.rotation, b)).all()


def test_blocks_spare_far_chunks():
    """Chunks of two tight clusters never meet, and hardly a pair within one chunk is verified beyond its links."""
    rng = np.random.default_rng(6)
    space = subspace.Space(np.eye(64), list(range(0, 65, 8)), rng.standard_normal((2, 64)) / 8, 0.14)
    cell = np.array([0, 1])
    assert not space.may_meet(cell[:1], np.full((1, 8), 0.01), cell[1:], np.full((1, 8), 0.01)).any()
    x = rng.standard_normal((400, 64))
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    assert space.candidates(x, x).mean() < 0.02


# ---- hard negatives ----------------------------------------------------------------


def plain_negatives(rows, every=50, positives=5, negatives_=3, scale=256):
    least = {}
    for i, v, label in rows:
        if i is not None and label is not None and usable(v):
            one = (label, [math.floor(scale * x) for x in v])
            least[i] = min(least.get(i, one), one)
    out = []
    for a in sorted(least):
        if a % every:
            continue
        scores = [(-sum(p * q for p, q in zip(least[a][1], v, strict=True)), i, label == least[a][0]) for i, (label, v) in least.items() if i != a]
        for s, p, _ in sorted(x for x in scores if x[2])[:positives]:
            fit = sorted(x for x in scores if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s)[:negatives_]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(data, every=50, **chosen):
    got = negatives.mine(data, f"id % {every} = 0", s=negatives.Settings(**chosen))
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())


@pytest.mark.parametrize("chosen", [{}, {"tree": 20, "leaf": 3, "anchors": 4}, {"tree": 64, "leaf": 1, "anchors": 1}])
def test_negatives_against_all_pairs(spark, chosen):
    rng = np.random.default_rng(7)
    rows = [(i, v, label) for i, v, label in clustered(8, n=260, spread=0.4)]
    rows += [(2000 + i, rows[int(rng.integers(100))][1], int(rng.integers(3))) for i in range(60)]  # copies under other labels: ties
    want = plain_negatives(rows, every=10)
    assert len(want) > 60
    assert mined(frame(spark, rows), every=10, **chosen) == want


def test_negatives_edge_cases(spark):
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(1, [1.0, 2.0], 1)])) == []
    assert mined(frame(spark, [(50, [1.0, 2.0], 1)])) == []
    rows = [(0, [1.0, 0.0], 1), (50, [-1.0, 0.0], 1), (100, [0.0, 0.0], 1), (1, [0.7, 0.0], 2), (2, [0.7, 0.0], 3), (3, [0.5, 9.0], 2), (4, [-0.7, 0.0], 2), (5, [1.0, 0.0], 1),
            (6, [0.0, 0.0], 2), (7, None, 1), (8, [1.0, 1.0], None), (None, [0.7, 0.0], 2), (9, [1.0, None], 2), (10, [INF, 0.0], 2), (2, [0.8, 0.0], 2), (12, [0.7], 2)]
    clash = frame(spark, rows).withColumns({c: F.lit("x") for c in ("id", "v", "l", "n", "copy", "slice", "bucket", "block", "name", "low", "high", "rank", "score", "anchor", "questions")})
    assert mined(clash) == plain_negatives([r for r in rows if r[0] != 12])
    with pytest.raises(ValueError, match="too large"):
        negatives.mine(frame(spark, [(1, [1e30], 1)]), "id = 1")


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 90), st.integers(1, 6), st.integers(1, 8), st.integers(1, 4), st.integers(0, 10**6), st.booleans())
def test_a_tree_answers_as_a_scan_does(n, width, leaf, k, seed, same):
    rng = np.random.default_rng(seed)
    x, ids, labels = rng.integers(-4, 5, (n, width)).astype(float), rng.permutation(n), rng.integers(0, 3, n)
    tree = negatives.build(x, ids, labels, leaf)
    assert sorted(tree.ids.tolist()) == list(range(n))
    q, own = rng.integers(-4, 5, (5, width)).astype(float), rng.integers(0, 3, 5)
    anchor = rng.integers(0, 5, 9)
    low = rng.integers(-20, 10, 9).astype(float)
    asked = negatives.Asked(q, np.arange(5), own, anchor, low, low + rng.integers(0, 30, 9), same)
    best, _ = negatives.search(tree, asked, k)
    for i, a in enumerate(anchor):
        fit = [(-(q[a] @ x[j]), ids[j]) for j in range(n) if (labels[j] == own[a]) == same and ids[j] != a and low[i] <= q[a] @ x[j] <= asked.high[i]]
        found = [(-s, j) for s, j in zip(best.score[i], best.ids[i], strict=True) if j != negatives.NONE]
        assert found == sorted(fit)[:k]


def test_bounds_prune_both_ways():
    """Of 64 clusters, a search enters few leaves: those within the window, best first."""
    rng = np.random.default_rng(9)
    centre = rng.standard_normal((64, 24)) * 20
    x = np.repeat(centre, 64, axis=0) + rng.standard_normal((4096, 24))
    x = np.floor(x * 256)
    tree = negatives.build(x, np.arange(4096), np.zeros(4096, int), 64)
    anchors = x[[0]]
    scores = np.sort(x @ anchors[0])[::-1]
    for low, high in ((-np.inf, np.inf), (scores[2000] * 0.98, scores[2000]), (scores[64] * 0.5, scores[64])):
        asked = negatives.Asked(anchors, np.array([-1]), np.array([1]), np.array([0]), np.array([low]), np.array([high]), False)
        best, scored = negatives.search(tree, asked, 3)
        inside = scores[(scores >= low) & (scores <= high)][:3]
        assert best.score[0, : len(inside)].tolist() == inside.tolist()
        assert scored < 40


def test_new_query_columns(spark, small):
    assert QUERIES["op11_vector_codes"](spark, small).dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]
    assert QUERIES["op12_subspace_near_dedup"](spark, small).dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert QUERIES["op13_ball_tree_negatives"](spark, small).dtypes == [(c, "int" if c == "rank" else "bigint") for c in names]
