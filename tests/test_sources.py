"""Files are written by the test and read back."""

import json

import numpy as np

from inkframe.sources import readers, writers

BOOK = """<book><characters><character id="c1" name="Ann"/><character id="c2"/></characters><pages>
<page index="0" width="100" height="200">
 <text id="t1" xmin="1" ymin="2" xmax="3" ymax="4"> hi </text>
 <face id="f1" character="c1" xmin="1.7" ymin="2" xmax="3" ymax="4"/>
 <body id="b1" character="c1" xmin="1" ymin="2" xmax="30" ymax="40"/>
 <frame id="r1" xmin="0" ymin="0" xmax="100" ymax="100"/>
 <onomatopoeia id="o1" x0="0" y0="0" x1="4" y1="0" x2="4" y2="3">bam</onomatopoeia>
 <onomatopoeia id="o2" x0="0" y0="0" x1="4" y1="0" x3="9" y3="9">two</onomatopoeia>
</page><page index="1" width="100" height="200"><text id="t2" xmin="1" ymin="2" xmax="3" ymax="4">he <b>said</b></text></page></pages></book>"""


def test_xml(spark, tmp_path):
    (tmp_path / "Book.xml").write_text(BOOK)
    path = f"file://{tmp_path}/Book.xml"
    texts = {r["id"]: r for r in readers.read_rectangles(spark, path).collect()}
    assert texts["t1"]["text"] == "hi" and texts["t1"]["book"] == "Book" and texts["t1"]["x2"] == 3.0 and len(texts["t1"]["polygon"]) == 4
    polygons = readers.read_polygons(spark, path).collect()
    assert [(r["id"], len(r["polygon"]), r["x2"], r["y2"]) for r in polygons] == [("o1", 3, 4.0, 3.0)]
    objects = {r["id"]: (r["cls"], r["character_id"], r["x1"]) for r in readers.read_objects(spark, path).collect()}
    assert objects == {"f1": ("face", "c1", 1), "b1": ("body", "c1", 1), "r1": ("frame", None, 0)}
    assert {tuple(r) for r in readers.read_character_names(spark, path).collect()} == {("Book", "c1", "Ann"), ("Book", "c2", "")}
    assert {r["id"]: r["text"] for r in readers.read_nested_texts(spark, path).collect()}["t2"] == "he said"
    assert {r["id"]: r["text"] for r in readers.read_transcripts(spark, path).collect()}["t1"].strip() == "hi"


def test_json_and_lists(spark, tmp_path):
    page = {"image": "a.jpg", "width": 5, "height": 6, "detections": [{"class_id": 0, "class_name": "text", "score": 0.5, "box": [1, 2, 3, 4], "area": 4}]}
    (tmp_path / "d.json").write_text(json.dumps({"images": [page]}))
    assert [(r["image"], r["ord"], r["box"]) for r in readers.read_detections(spark, f"file://{tmp_path}/d.json").collect()] == [("a.jpg", 0, [1.0, 2.0, 3.0, 4.0])]
    (tmp_path / "rows.jsonl").write_text('{"key": "a", "n": 1}\n\n{"key": "a", "n": 2}\n')
    assert [tuple(r) for r in readers.read_lines(spark, f"file://{tmp_path}/rows.jsonl", "key string, n int", "key", "n").collect()] == [("a", 2)]
    (tmp_path / "list.txt").write_text("﻿one\n# no\n\n two \n")
    assert sorted(r["value"] for r in readers.read_list(spark, f"file://{tmp_path}/list.txt").collect()) == ["one", "two"]
    (tmp_path / "dict.txt").write_text("a\nbc\n\n")
    assert {r["token"]: r["single"] for r in readers.read_dictionary(spark, f"file://{tmp_path}/dict.txt").collect()} == {"a": True, "bc": False, " ": True}


def test_vectors_and_images(spark, tmp_path):
    np.savez(tmp_path / "p.npz", embeddings=np.arange(6, dtype=np.float16).reshape(2, 3))
    got = readers.read_vectors(spark, f"file://{tmp_path}/p.npz", ("embeddings",)).orderBy("ord").collect()
    assert [(r["key"], r["ord"], r["vec"]) for r in got] == [("p", 0, [0.0, 1.0, 2.0]), ("p", 1, [3.0, 4.0, 5.0])]
    png = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")
    (tmp_path / "x.png").write_bytes(png)
    assert [(r["stem"], r["width"], r["height"]) for r in readers.list_images(spark, f"file://{tmp_path}").collect()] == [("x", 7, 9)]


def test_writers(spark, tmp_path):
    frame = spark.createDataFrame([(1, "é", ["a", "b"])], "id int, name string, ids array<string>").coalesce(1)
    writers.write_csv(frame, f"file://{tmp_path}/csv", ["id", "name", "ids"])
    part = next((tmp_path / "csv").glob("part-*.csv")).read_text(encoding="utf-8")
    assert part.startswith("﻿id") and "a|b" in part
    writers.write_json(frame, f"file://{tmp_path}/json")
    assert "é" in next((tmp_path / "json").glob("part-*.txt")).read_text(encoding="utf-8")
    pages = spark.createDataFrame([(1, "a.jpg"), (2, "b.jpg")], "page int, image string")
    notes = spark.createDataFrame([(1, 0, "hi", [1])], "page int, ord int, transcription string, points array<int>")
    lines = sorted(r["value"] for r in writers.detector_labels(pages, notes, "page", "image").collect())
    assert lines == ['a.jpg\t[{"transcription":"hi","points":[1]}]', "b.jpg\t[]"]
    assert "?" in writers.markdown([{"a": None}], ["a"]) and "&lt;" in writers.report("t", [{"a": "<"}], ["a"])
    writers.write_vectors(spark.createDataFrame([(1, [1.0])], "id int, vec array<double>"), f"file://{tmp_path}/vec", "s1")
    assert spark.read.parquet(f"file://{tmp_path}/vec").first()["signature"] == "s1"


def test_side_files_of_images(spark, tmp_path):
    (tmp_path / "ocr").mkdir()
    (tmp_path / "ocr" / "p1.json").write_text('\ufeff{"ocr_lines": [{"box": [1, 2, 3, 4.5], "text_for_review_only": "a"}, {"box": [1, 2, 3]}, {"box": [0, 0, 1, 1]}]}', encoding="utf-8")
    (tmp_path / "ocr" / "p2.json").write_text("{}")
    images = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "stem string")
    got = {r["stem"]: [(x["box"], x["text"]) for x in r["lines"]] for r in readers.ocr_lines(images, f"file://{tmp_path}/ocr").collect()}
    assert got == {"p1": [([1.0, 2.0, 3.0, 4.5], "a"), ([0.0, 0.0, 1.0, 1.0], "")], "p2": [], "p3": []}
    for folder in (None, f"file://{tmp_path}/none"):
        assert {len(r["lines"]) for r in readers.ocr_lines(images, folder).collect()} == {0}
        assert {len(r["tails"]) for r in readers.tail_boxes(images, folder).collect()} == {0}
    (tmp_path / "tails").mkdir()
    (tmp_path / "tails" / "p1_v3_all.json").write_text('{"tails": [{"box": [1, 2, 3, 4]}, {"box": [1]}, {"box": null}]}')
    (tmp_path / "tails" / "p1.json").write_text('{"tails": [{"box": [9, 9, 9, 9]}]}')
    (tmp_path / "tails" / "p2.json").write_text('{"tails": [{"box": [5, 6, 7, 8]}]}')
    got = {r["stem"]: r["tails"] for r in readers.tail_boxes(images, f"file://{tmp_path}/tails", ("_v3_all", "")).collect()}
    assert got == {"p1": [[1.0, 2.0, 3.0, 4.0]], "p2": [[5.0, 6.0, 7.0, 8.0]], "p3": []}
