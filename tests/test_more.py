"""Raster overlap, hooks and hash-ordered sampling."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkframe.functions.raster import polygon_mask, rect_polygon_iom
from inkframe.operators import sampling
from pyspark.sql import functions as F

from inkframe.plans import catalog, plugins


def test_raster_of_boxes_and_triangles():
    square = [(0, 0), (9, 0), (9, 9), (0, 9)]
    assert polygon_mask(square, 10, 10).all()
    assert rect_polygon_iom((0, 0, 9, 9), square) == 1.0
    assert rect_polygon_iom((0, 0, 9, 9), square[:2]) == 0.0
    assert rect_polygon_iom((20, 20, 30, 30), square) == 0.0
    triangle = [(0, 0), (20, 0), (0, 20)]
    assert 0.45 < polygon_mask(triangle, 21, 21).mean() < 0.6
    with pytest.raises(ValueError):
        rect_polygon_iom((0, 0, 9000, 9000), [(0, 0), (9000, 0), (0, 9000)])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=3, max_size=6), st.integers(0, 15), st.integers(0, 15))
def test_raster_share_is_a_share(points, x, y):
    assert 0.0 <= rect_polygon_iom((x, y, x + 12, y + 9), points) <= 1.0


def test_ranker_registry(spark):
    plugins.register_ranker("first", lambda features, text: features[:, 0])
    rows = spark.createDataFrame([(0, 1, [0.5], ""), (0, 2, [0.7], "")], "q int, c int, f array<double>, t string")
    got = plugins.score_queries(rows, ["q"], "c", "f", "t", "first")
    assert {(r["c"], r["score"]) for r in got.collect()} == {(1, 0.5), (2, 0.7)}
    with pytest.raises(ValueError):
        plugins.score_queries(rows, ["q"], "c", "f", "t", "none")


def test_client_retries(spark):
    def client(prompt):
        if prompt == "no":
            raise ValueError("refused")
        return prompt.upper()

    rows = spark.createDataFrame([(1, "hi"), (2, "no")], "id int, prompt string")
    got = {r["id"]: (r["response"], r["status"], r["attempts"]) for r in plugins.ask(rows, client, unit=0.001).collect()}
    assert got == {1: ("HI", "ok", 1), 2: (None, "failed", 1)}


def test_inference_hook(spark):
    rows = spark.range(5)
    got = plugins.infer(rows, lambda: lambda part: part.assign(y=part["id"] * 2.0), "id long, y double")
    assert sorted(r["y"] for r in got.collect()) == [0.0, 2.0, 4.0, 6.0, 8.0]


def test_batches_hold_like_shapes(spark):
    pages = spark.range(100).selectExpr("id AS key", "100 AS width", "100 + id % 3 * 50 AS height", "id % 4 AS dialogues", "id % 5 AS candidates")
    got = sampling.bucketed_batches(pages, "key", 1, 0, 10)
    sizes = [r["count"] for r in got.groupBy("batch").count().collect()]
    assert sum(sizes) == 100 and max(sizes) <= 10
    assert sampling.repeated_trials(spark.range(2), 3, (1, 5), ("a",)).count() == 12


def test_batches_of_all_orders(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    got = catalog.QUERIES["bucketed_batches"](spark, small)
    assert got.select("key").exceptAll(orders.select("o_orderkey")).isEmpty() and got.count() == orders.count() > 0


def test_hash_numbers(spark):
    rows = spark.range(9000).union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    got = sampling.hash_numbers(rows, sampling.hash_order(3, "id"), "id", "n").orderBy("n").collect()
    want = [None, *sorted(range(9000), key=lambda i: hashlib.md5(f"3|{i}".encode()).hexdigest())]
    assert [r["id"] for r in got] == want and [r["n"] for r in got] == list(range(9001))


def test_whole_groups_are_put_together():
    import pandas as pd

    from inkframe.operators.streams import whole_groups

    frame = pd.DataFrame({"k": [1, 1, 2, 2, 2, 2, 3, 4, 4], "v": range(9)})
    for cuts in ([9], [3, 6], [1, 2, 3, 4, 5, 6, 7, 8], [2], [6, 7], [0, 4]):
        parts = [frame.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, 9], strict=True)]
        got = list(whole_groups(iter(parts), ["k"]))
        assert pd.concat(got)["v"].tolist() == list(range(9))
        seen = [set(g["k"]) for g in got]
        assert sum(map(len, seen)) == 4


def test_bands_fold_as_they_do_in_a_loop(spark):
    import random

    from inkframe.operators import ranking

    rng = random.Random(2)
    rows = []
    for page in range(40):
        for key in range(rng.randrange(1, 9)):
            y, x = rng.randrange(900), rng.randrange(900)
            rows.append((page, key, y, y + rng.randrange(0, 500), x))
    found = {}
    for r in ranking.panel_order(spark.createDataFrame(rows, "page int, key long, y1 int, y2 int, x2 int"), "page", "key", "y1", "y2", "x2").collect():
        found.setdefault(r["page"], {})[r["panel_rank"]] = r["panel"]
    for page in range(40):
        want = ranking.panel_bands([(k, float(a), float(b), float(x)) for p, k, a, b, x in rows if p == page])
        assert [found[page][i] for i in range(len(want))] == want


def test_average_linkage_against_a_plain_loop():
    import numpy as np

    from inkframe.operators import cluster

    rng = np.random.default_rng(6)
    for n in (1, 2, 9, 17):
        x = cluster.normalize(rng.normal(size=(n, 3)))
        groups = [[i] for i in range(n)]
        while len(groups) > 1:
            rated = [(np.mean([x[a] @ x[b] for a in g for b in h]), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j]
            score, i, j = max(rated)
            if score < 0.5:
                break
            groups[i] += groups.pop(j)
        got = cluster.average_linkage(x @ x.T, 0.5)
        assert sorted(sorted(g) for g in groups) == sorted(np.flatnonzero(got == c).tolist() for c in set(got.tolist()))


def test_vectors_without_a_kept_token(spark):
    from inkframe.operators.vectors import masked_mean

    rows = spark.createDataFrame([([[3.0, 4.0], [1.0, 1.0]], [1.0, 0.0]), ([[3.0, 4.0], [1.0, 1.0]], [0.0, 0.0])], "t array<array<double>>, m array<double>")
    assert [r[0] for r in rows.select(masked_mean(F.col("t"), F.col("m"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_long_numbers_by_range(spark):
    from inkframe.operators import sampling

    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    assert [(r["k"], r["n"]) for r in sampling.range_numbers(keys, "k", "n").orderBy("k").collect()] == [(3 * i, i) for i in range(1000)]
    assert sampling.range_numbers(keys.limit(0), "k", "n").count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(-6, 25), st.integers(-6, 25)), max_size=7), min_size=1, max_size=8), st.integers(-4, 12), st.integers(-4, 12))
def test_spans_count_as_rasters_do(spark, polygons, x, y):
    """Triangles, concave and crossing polygons, off the page and of too few points: the fold over spans counts what two rasters hold."""
    from inkframe.functions.raster import raster_iom

    rows = [(i, [{"x": float(a), "y": float(b) + (0.5 if i % 2 else 0.0)} for a, b in p]) for i, p in enumerate(polygons)]
    frame = spark.createDataFrame(rows, "id int, p array<struct<x double, y double>>")
    rect = (x, y, x + 9.5, y + 7)
    got = {r["id"]: r["v"] for r in frame.select("id", raster_iom(*(F.lit(float(v)) for v in rect), F.col("p")).alias("v")).collect()}
    for i, p in rows:
        assert got[i] == rect_polygon_iom(rect, [(q["x"], q["y"]) for q in p])


def test_spans_of_concave_polygons():
    """A notch that reaches inside is left out, its edges are not."""
    notched = [(0, 0), (10, 0), (10, 10), (5, 4), (0, 10)]
    mask = polygon_mask(notched, 11, 11)
    assert mask[4].all() and mask[10].tolist() == [True] + [False] * 9 + [True]
    assert mask[7].tolist() == [True] * 3 + [False] * 5 + [True] * 3  # the edges cross the row at 2.5 and 7.5
