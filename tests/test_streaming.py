"""Pages that land twice are handled once, also after a restart."""

import json

from inkframe.streaming import landing


def test_landing(spark, tmp_path):
    folder, state, seen = tmp_path / "in", f"file://{tmp_path}/state", []
    folder.mkdir()
    page = lambda name: {"image": name, "width": 1, "height": 1, "detections": []}

    def handle(frame, _):
        seen.extend(r["image"] for r in frame.collect())

    def go():
        landing.run(landing.landed_pages(spark, f"file://{folder}"), handle, state).awaitTermination(120)

    (folder / "1.json").write_text(json.dumps({"images": [page("a.jpg"), page("a.jpg"), page("x.exe")]}))
    go()
    (folder / "2.json").write_text(json.dumps({"images": [page("a.jpg"), page("b.PNG")]}))
    go()
    assert sorted(seen) == ["a.jpg", "b.PNG"]


def test_unique_names(spark):
    frame = spark.createDataFrame([("a.jpg", 1), ("a.jpg", 2), ("b", 3), ("b", 4)], "name string, n int")
    assert [r["stored"] for r in landing.unique_names(frame, "name", "n").orderBy("n").collect()] == ["a.jpg", "a_1.jpg", "b", "b_1"]
