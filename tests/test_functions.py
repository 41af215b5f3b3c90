"""Golden cases of text, geometry and answer columns."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkframe.functions import answers, geometry as G, text as T
from inkframe.functions.geometry import Box


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "normal", "core"),
    [("ｶﾞｰﾝ！", "ガーン!", "ガーン"), ("ドドド　…", "ドドド...", "ドドド"), ("ザッ〜", None, "ザッ"), ("A b C①", "AbC1", None), (None, "", ""), ("", "", "")],
)
def test_normal_forms(spark, raw, normal, core):
    value = F.lit(raw).cast("string")
    if normal is not None:
        assert one(spark, T.normalize(value)) == normal
    if core is not None:
        assert one(spark, T.core_text(value)) == core


@pytest.mark.parametrize(("a", "b", "score"), [("ドドドン", "ドドン", 6 / 7), ("abcd", "bcde", 0.75), ("", "", 1.0), ("tide", "diet", 0.25), ("diet", "tide", 0.5)])
def test_similarity_and_its_order(spark, a, b, score):
    assert one(spark, T.similarity(F.lit(a), F.lit(b))) == pytest.approx(score)


def test_best_concatenation_keeps_the_first_best(spark):
    assert T.best_concat("ザワザワ", ["ワザワ", "ザ"]) == ("ザワザワ", 1.0)
    assert T.best_concat("x", []) == ("", 0.0)
    assert T.best_concat("abcdefg", list("gfedcba"))[0] == "gfedcba"  # over six pieces: order as given
    row = one(spark, T.best_concat_match(F.lit("ザワザワ"), F.array(F.lit("ワザワ"), F.lit("ザ"))))
    assert row["joined"] == "ザワザワ"


def test_labels_and_names(spark):
    assert one(spark, T.clean_label(F.lit("a\r\nb\tc"))) == "ab c"
    assert one(spark, T.file_safe(F.lit("../é b"))) == "b"
    assert one(spark, T.file_safe(F.lit("é"))) == "item"
    assert one(spark, T.code_point(F.lit("ガ"))) == "U+30AC"
    assert one(spark, T.character_name(F.lit("A"))) == "LATIN CAPITAL LETTER A"
    assert one(spark, T.percent(F.lit(None).cast("double"))) == "?"
    assert one(spark, T.signed_points(F.lit(0.01226))) == "+1.23 pp"
    assert one(spark, F.size(T.characters(F.lit("a😀")))) == 2


@pytest.mark.parametrize(
    ("raw", "value", "error"),
    [("0.5", 0.5, None), ("85%", 0.85, None), (None, None, "missing"), (" ", None, "empty"), ("true", None, "boolean"), ("high", None, "not numeric"), ("1.5", None, "outside"), ("nan", None, "outside")],
)
def test_confidence(spark, raw, value, error):
    got = one(spark, answers.confidence(F.lit(raw).cast("string"), "c"))
    assert got["value"] == value
    assert (got["error"] is None) == (error is None)
    assert error is None or error in got["error"]


@pytest.mark.parametrize(
    ("raw", "index", "confidence", "bad"),
    [('x {"choice": "b", "confidence": 70} y', 1, 0.7, False), ('{"choice": "NONE"}', None, 0.0, False), ('{"choice": "E", "confidence": 1}', None, 0.0, True), ("no json", None, 0.0, True), ('{"choice": "A", "confidence": "?"}', 0, 0.0, False)],
)
def test_option(spark, raw, index, confidence, bad):
    got = one(spark, answers.option(F.lit(raw), F.lit(4)))
    assert (got["index"], got["confidence"], got["error"] is not None) == (index, confidence, bad)


def box(x1, y1, x2, y2):
    return Box(*(F.lit(float(v)) for v in (x1, y1, x2, y2)))


def test_overlap_measures(spark):
    a, b = box(0, 0, 10, 10), box(5, 0, 15, 10)
    assert one(spark, G.iou(a, b)) == pytest.approx(50 / 150)
    assert one(spark, G.iom(a, b)) == 0.5
    assert one(spark, G.overlaps(a, box(10, 0, 20, 10))) is False
    assert one(spark, G.iom(a, box(3, 3, 3, 3))) == 0.0
    assert one(spark, G.gap_distance(a, box(13, 14, 20, 20))) == 5.0


def test_polygons(spark):
    rect = G.rectangle(box(0, 0, 4, 3))
    assert one(spark, G.polygon_area(rect)) == 12.0
    assert one(spark, G.polygon_area(F.slice(rect, 1, 2))) == 0.0
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    messy = F.array(corner(0.5, 0), corner(0, 0), corner(1.5, 0), corner(99, 7), corner(0, 0))
    assert [(p["x"], p["y"]) for p in one(spark, G.clean_polygon(messy, F.lit(10), F.lit(5)))] == [(0, 0), (2, 0), (9, 4)]


def test_rays(spark):
    z, one_ = F.lit(0.0), F.lit(1.0)
    assert one(spark, G.ray_hit(z, z, one_, z, box(2, -1, 4, 1))) == 2.0
    assert one(spark, G.ray_hit(z, z, one_, z, box(2, 1, 4, 3))) is None
    assert one(spark, G.ray_hit(z, z, one_, z, box(-4, -1, -2, 1))) is None
    assert one(spark, G.ray_hit(z, z, one_, z, box(-1, -1, 2, 1))) == 0.0
    assert one(spark, G.ray_exit(z, z, one_, z, box(-1, -1, 3, 1))) == 3.0
    seg = one(spark, G.tail_segment(box(10, 0, 14, 4), box(0, 0, 4, 4)))
    assert (seg["root_x"], seg["tip_x"], seg["tip_y"]) == (10.0, 14.0, 2.0)
    best = one(spark, G.diagonal_segments(box(10, 10, 14, 14), box(0, 0, 4, 4)))[0]
    assert best["cosine"] == pytest.approx(1.0) and best["tip_x"] == 14.0


def test_tail_with_the_centre_of_its_text(spark):
    seg = one(spark, G.tail_segment(box(10, 0, 14, 4), box(11, 1, 13, 3)))
    assert tuple(seg) == (12.0, 2.0, 12.0, 2.0)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=8, max_size=8))
def test_overlap_properties(spark, v):
    a = box(min(v[0], v[2]), min(v[1], v[3]), max(v[0], v[2]), max(v[1], v[3]))
    b = box(min(v[4], v[6]), min(v[5], v[7]), max(v[4], v[6]), max(v[5], v[7]))
    row = spark.range(1).select(G.iou(a, b).alias("p"), G.iou(b, a).alias("q"), G.iom(a, b).alias("m")).first()
    assert row["p"] == row["q"] and 0 <= row["p"] <= 1 and 0 <= row["m"] <= 1 and not math.isnan(row["p"])
