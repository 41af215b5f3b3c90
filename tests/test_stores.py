"""Packs of arrays and replaced versions: round trips, pruning, failed tasks, writers that meet."""

import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkframe.sources import packs
from inkframe.sources.versions import Conflict, Versions

SAMPLE = {
    "page1": {"geometry": np.arange(12, dtype=np.float32).reshape(2, 3, 2) / 7, "labels": np.array([[True, False, True], [False] * 3]), "half": np.array([0.5, 1e-3], np.float16)},
    "page2": {"geometry": np.zeros((0, 3, 2), np.float32), "labels": np.zeros((0, 3), bool), "ids": np.array(["t1", "ü", ""])},
    "page3": {"geometry": np.array(3.5), "labels": np.array([1, -(2**40)], np.int64)},
}


def rows_of(sample):
    return [r for pack, arrays in sample.items() for r in packs.batch_of(pack, arrays).to_pylist()]


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in packs.ARROW.names) for r in rows], packs.SCHEMA)


def found(frame):
    return {(r["pack"], r["array"]): packs.array_of(r.asDict()) for r in frame.collect()}


def test_packs_come_back(spark, tmp_path):
    path = f"file://{tmp_path}/packs"
    packs.write_packs(frame(spark, rows_of(SAMPLE)), path)
    assert sorted(os.listdir(tmp_path / "packs")) == ["page1.npz", "page2.npz", "page3.npz"]
    with np.load(tmp_path / "packs" / "page1.npz") as held:  # as any other program reads it
        assert held["geometry"].dtype == np.float32 and (held["geometry"] == SAMPLE["page1"]["geometry"]).all()
    got = found(packs.read_packs(spark, path))
    assert got.keys() == {(p, a) for p, arrays in SAMPLE.items() for a in arrays}
    for (p, a), x in got.items():
        assert x.dtype.kind == SAMPLE[p][a].dtype.kind and x.shape == SAMPLE[p][a].shape and (x == SAMPLE[p][a]).all()


def test_packs_are_pruned(spark, tmp_path):
    path = f"{tmp_path}/packs"
    packs.write_packs(frame(spark, rows_of(SAMPLE)), path)
    (tmp_path / "packs" / "page9.npz").write_bytes(b"no pack")  # must not be opened
    some = packs.read_packs(spark, path).filter("pack IN ('page1', 'page2') AND array = 'labels'")
    assert found(some).keys() == {("page1", "labels"), ("page2", "labels")}
    (tmp_path / "packs" / "page9.npz").unlink()
    assert found(packs.read_packs(spark, path, ("labels",))).keys() == {(p, "labels") for p in SAMPLE}
    with pytest.raises(Exception, match="has no array"):
        packs.read_packs(spark, path, ("labels", "half")).collect()
    reader = packs.Reader({"path": path, "partitionbytes": "1"})
    assert [r.names for r in reader.partitions()] == [["page1"], ["page2"], ["page3"]]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/packs"
    packs.write_packs(frame(spark, rows_of(SAMPLE)), path)
    bad = rows_of({"page4": {"a": np.ones(2)}, "page5": {"b": np.ones(2)}})
    bad[1]["kind"] = "complex"
    with pytest.raises(Exception, match="unknown kind"):
        packs.write_packs(frame(spark, bad), path)
    assert sorted(os.listdir(path)) == ["page1.npz", "page2.npz", "page3.npz"]
    spark.dataSource.register(packs.ArrayPacks)
    apart = frame(spark, rows_of({"page6": {"a": np.ones(2), "b": np.ones(2)}})).repartition(2, "array")
    if apart.rdd.getNumPartitions() == 2 and apart.select(F.spark_partition_id()).distinct().count() == 2:
        with pytest.raises(Exception, match="two tasks"):
            apart.write.format("arraypack").mode("append").save(path)
        assert not (tmp_path / "packs" / "page6.npz").exists()


def test_packs_are_replaced(spark, tmp_path):
    path = f"{tmp_path}/packs"
    packs.write_packs(frame(spark, rows_of(SAMPLE)), path)
    packs.write_packs(frame(spark, rows_of({"page3": {"a": np.ones(2)}, "page7": {"a": np.ones(1)}})), path, "overwrite")
    assert sorted(os.listdir(path)) == ["page3.npz", "page7.npz"]
    assert found(packs.read_packs(spark, path)).keys() == {("page3", "a"), ("page7", "a")}


def test_writers_that_meet(spark, tmp_path):
    """Four writers add to a counter twenty times in all; every one counts, and readers see whole versions."""
    store = Versions(spark, f"file://{tmp_path}/counter")
    assert store.current() == 0
    with pytest.raises(FileNotFoundError):
        store.read()
    errors = []

    def add():
        try:
            mine = Versions(spark, f"file://{tmp_path}/counter")
            for _ in range(3):
                mine.publish(lambda old: spark.range(1).selectExpr("1 AS n") if old is None else old.selectExpr("n + 1 AS n"), tries=50)
        except Exception as error:  # told to the test below
            errors.append(error)

    writers = [threading.Thread(target=add) for _ in range(4)]
    for w in writers:
        w.start()
    seen = []
    while any(w.is_alive() for w in writers):
        if store.current():
            seen.append(store.read().first()["n"])
    for w in writers:
        w.join()
    assert errors == [] and store.current() == 12 and store.read().first()["n"] == 12
    assert seen == sorted(seen)
    assert [store.read(v).first()["n"] for v in store.versions()] == list(range(1, 13))
    names = os.listdir(tmp_path / "counter")
    assert sum(n.startswith("data-") for n in names) == 12 and not any(n.startswith("pending") for n in names)
    store.expire(2)
    assert store.versions() == [11, 12] and sum(n.startswith("data-") for n in os.listdir(tmp_path / "counter")) == 2


def test_a_taken_number(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/one")
    assert store.publish_if(spark.range(3), 0, "first") and not store.publish_if(spark.range(4), 0, "late")
    assert store.read().count() == 3
    assert [tuple(r) for r in store.history().collect()] == [(1, "first", 3)]
    with pytest.raises(Conflict):
        store.publish(lambda _: spark.range(1), tries=0)
