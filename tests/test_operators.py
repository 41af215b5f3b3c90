"""Operators on small tables with results worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkframe.operators import checks, cluster, curate, decide, graph, lifecycle, matching, metrics, ranking, review, sampling, vectors


def rows(frame, *order):
    return [tuple(r) for r in (frame.orderBy(*order) if order else frame).collect()]


def test_greedy_match_takes_pairs_once_in_order(spark):
    pairs = spark.createDataFrame([(0, 1, 1, 0.1), (0, 1, 2, 0.2), (0, 2, 1, 0.3), (0, 2, 2, 0.4)], "g int, a int, b int, d double")
    got = matching.greedy_match(pairs, ["g"], "a", "b", [F.col("d")])
    assert rows(got, "a") == [(0, 1, 1), (0, 2, 2)]


def test_components_are_a_partition(spark):
    edges = spark.createDataFrame([(0, 1, 2), (0, 3, 2), (0, 4, 5)], "p int, a long, b long")
    got = graph.page_components(edges, "p", "a", "b").collect()
    groups = {}
    for r in got:
        groups.setdefault(r["component"], set()).add((r["side"], r["member"]))
    assert sorted(map(sorted, groups.values())) == [[("a", 1), ("a", 3), ("b", 2)], [("a", 4), ("b", 5)]]


def test_clustering_metrics_golden(spark):
    data = [(0, t, p) for t, p in zip((0, 0, 0, 1, 1, 2), (0, 0, 1, 1, 1, 2), strict=True)]
    got = metrics.clustering_metrics(spark.createDataFrame(data, "book int, truth int, pred int"), "book", "truth", "pred").first()
    assert got["b_precision"] == pytest.approx(7 / 9) and got["b_f1"] == pytest.approx(7 / 9)
    assert got["pair_f1"] == pytest.approx(0.5) and got["ari"] == pytest.approx(0.3181818181) and got["nmi"] == pytest.approx(0.6853314789)
    same = metrics.clustering_metrics(spark.createDataFrame([(0, i, i + 5) for i in (1, 1, 2)], "book int, truth int, pred int"), "book", "truth", "pred").first()
    assert (same["b_f1"], same["ari"]) == (1.0, 1.0)


def test_percentile_and_softmax(spark):
    four = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,)], "v double")
    assert rows(four.agg(metrics.percentile(F.col("v"), 50), metrics.percentile(F.col("v"), 90))) == [(1.5, pytest.approx(2.7))]
    assert rows(four.filter("v > 9").agg(metrics.percentile(F.col("v"), 50))) == [(0.0,)]
    scores = spark.createDataFrame([(0, 2.0), (0, 1.0), (0, 0.0)], "g int, s double")
    got = [r[0] for r in scores.select(ranking.softmax_share(["g"], F.col("s"))).collect()]
    assert sorted(got, reverse=True) == [pytest.approx(x, abs=1e-6) for x in (0.665241, 0.244728, 0.090031)]


def test_average_precision(spark):
    edges = spark.createDataFrame([(0, 0, i, float(-i), i in (1, 3)) for i in range(4)], "page int, query int, candidate int, score double, label boolean")
    got = metrics.listwise_metrics(edges, "page", "query", "candidate", "score", "label").first()
    assert got["average_precision"] == 0.5 and got["reciprocal_rank"] == 0.5 and got["top1"] == 0


def test_reading_order_bands():
    # Two panels side by side, one below; the right one is read first.
    frames = [(1, 0.0, 100.0, 50.0), (2, 10.0, 90.0, 120.0), (3, 200.0, 300.0, 120.0)]
    assert ranking.panel_bands(frames) == [2, 1, 3]


def test_context_mask(spark):
    page = spark.createDataFrame([(0, i, f"t{i}") for i in range(3)], "page int, n int, text string")
    got = rows(ranking.context(page, "page", "n", "text"), "n")
    assert [r[-1] for r in got] == [[False, True, True], [True, True, True], [True, True, False]]
    assert got[0][2] is None and got[0][4] == "t1"


def test_density_clusters_find_separate_groups():
    rng = np.random.default_rng(0)
    centres = np.eye(6)[:3] * 10
    x = np.concatenate([c + 0.05 * rng.normal(size=(12, 6)) for c in centres])
    truth = np.repeat([0, 1, 2], 12)
    for method in ("eom", "leaf"):
        labels = cluster.hdbscan(x, 4, 2, method)
        assert all(len(set(labels[truth == t].tolist()) - {-1}) == 1 for t in range(3))
        assert len(set(labels.tolist()) - {-1}) == 3
    assert set(cluster.hdbscan(x[:2], 4, 2, "eom").tolist()) == {-1}
    assert cluster.whiten(x[:1], 3).tolist() == x[:1].tolist()


def test_small_books_use_average_linkage():
    x = cluster.normalize(np.array([[1, 0.02], [1, 0], [0, 1], [0.02, 1]]))
    assert cluster.cluster_book(x).tolist() == [1, 1, 2, 2]
    assert cluster.cluster_book(x[:1]).tolist() == [1]
    assert cluster.merge_seeds(x, np.array([0, 1, -1, -1]), 0.9, 0.99, 0.0).tolist() == [0, 0, 1, 2]


def test_mutual_neighbours(spark):
    data = [(0, i, v) for i, v in enumerate(([1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.1, 0.9]))]
    frame = spark.createDataFrame(data, "book int, id long, vec array<double>")
    edges = graph.mutual_edges(graph.nearest_neighbours(frame, "book", "id", "vec", 1), "book", "id")
    assert [(r["left"], r["right"]) for r in edges.orderBy("left").collect()] == [(0, 1), (2, 3)]
    found = graph.threshold_clusters(frame, edges, "book", "id", 0.5)
    assert [r["cluster"] for r in found.orderBy("id").collect()] == [0, 0, 1, 1]


def test_checks_find_planted_faults(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k int, owner string")
    assert rows(checks.duplicates(frame, ["k"])) == [(1, 2)]
    assert rows(checks.shared_members(frame, ["k"], "owner")) == [(1, 2)]
    with pytest.raises(checks.IntegrityError):
        checks.require(checks.duplicates(frame, ["k"]), "duplicate keys")
    checks.require(checks.duplicates(frame, ["k", "owner"]), "duplicate keys")
    vec = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [1.0, 2.0]), (3, None)], "k int, v array<double>")
    assert [r[0] for r in rows(checks.bad_vectors(vec, "v", 2), "k")] == [1, 3]


def test_component_categories(spark):
    data = [
        (0, 0, "a", 1, "ドドド"), (0, 0, "b", 2, "ドドド！"),
        (0, 1, "a", 3, "ザワザワ"), (0, 1, "b", 4, "ザ"), (0, 1, "b", 5, "ワザワ"),
        (0, 2, "a", 6, "abc"), (0, 2, "b", 7, "xyz"),
        (0, 3, "a", 8, "x"), (0, 3, "a", 9, "y"), (0, 3, "b", 10, "x"), (0, 3, "b", 11, "y"),
    ]
    found = curate.classify(spark.createDataFrame(data, "page_id int, component int, side string, member int, text string"))
    assert [r["category"] for r in found.orderBy("component").collect()] == ["exact_duplicate", "group_duplicate", "different_overlap", "many_to_many"]
    a = spark.createDataFrame([(0, i, "t") for i in (1, 3, 6, 8, 9, 20)], "page_id int, id int, text string")
    b = spark.createDataFrame([(0, i, "t") for i in (2, 4, 5, 7, 10, 11)], "page_id int, id int, text string")
    got = curate.apply_components(a, b, found)
    assert sorted((r["source"], r["id"]) for r in got.collect()) == [("first", 6), ("first", 20), ("merged", 2), ("merged", 4), ("merged", 5), ("second", 7)]


def test_edits_fold_to_the_last(spark):
    base = spark.createDataFrame([(1, "cluster_001", True), (2, "cluster_007", True)], "id int, cluster string, member boolean")
    log = spark.createDataFrame([(1, 1, "delete", ""), (2, 1, "move", "cluster_009"), (3, 2, "delete", "")], "seq int, id int, action string, target string")
    assert rows(review.fold_edits(base, log, "id", "seq"), "id") == [(1, "cluster_009", True), (2, "unassigned", False)]
    assert review.next_cluster(base).first()[0] == "cluster_008"
    named = spark.createDataFrame([("cluster_001", "character_1", True, False)], "cluster string, name string, member boolean, excluded boolean")
    assert [r["problem"] for r in review.confirm_problems(named).collect()] == ["not named"]


def test_decisions(spark):
    columns = "has_response boolean, type string, type_confidence double, requires_link boolean, link_confidence double, choice string, speaker_confidence double, has_evidence boolean, choice_valid boolean"
    data = [
        (False, None, None, None, None, None, None, None, None),
        (True, "narration", 0.9, False, 0.9, "", None, False, False),
        (True, "dialogue", 0.9, True, 0.9, "offscreen", 0.9, True, False),
        (True, "dialogue", 0.9, True, 0.9, "B1", 0.9, True, True),
        (True, "dialogue", 0.9, True, 0.9, "B1", None, True, True),
    ]
    got = [r[0] for r in spark.createDataFrame(data, columns).coalesce(1).select(decide.panel_decision()).collect()]
    assert got == ["fallback", "filtered_non_dialogue", "offscreen", "accepted", "fallback"]


def test_prototypes_and_retrieval(spark):
    data = [(0, "a", i, v) for i, v in enumerate(([1.0, 0.0], [0.8, 0.6], [0.6, 0.8]))] + [(0, "b", 9, [0.0, 1.0])]
    frame = spark.createDataFrame(data, "book int, name string, id long, vec array<double>")
    bank = vectors.prototypes(frame, ["book", "name"], "vec")
    a = bank.filter("name = 'a'").first()["prototype"]
    assert a == pytest.approx((np.array([2.4, 1.4]) / np.hypot(2.4, 1.4)).tolist())
    scored = vectors.scores(frame.select("book", "id", "vec"), bank, "book", "vec")
    best = vectors.nearest_prototype(scored, ["id"], "name", 0.99)
    assert [r["name"] for r in best.orderBy("id").collect()] == [None, "a", None, "b"]
    split = vectors.gallery_split(frame, ["book", "name"], "id", 1, 5)
    assert sorted(r["role"] for r in split.collect()) == ["gallery", "gallery", "query"]


def test_resume_and_recovery(spark):
    wanted = spark.createDataFrame([(1,), (2,)], "k int")
    done = spark.createDataFrame([(1, "v1")], "k int, config string")
    assert rows(lifecycle.pending(wanted, done, ["k"], "v1")) == [(2,)]
    with pytest.raises(ValueError):
        lifecycle.pending(wanted, done, ["k"], "v2")
    text = spark.createDataFrame([('{"a": 1}{"b": 2}',), ("{",), (None,)], "t string").coalesce(1)
    got = [tuple(r[0]) for r in text.select(lifecycle.first_document("t")).collect()]
    assert got == [('{"a": 1}', True), (None, False), (None, False)]


def test_dense_ids_and_groups(spark):
    frame = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "x string")
    assert rows(sampling.dense_ids(frame, "x"), "id") == [("a", 0), ("b", 1)]
    sizes = spark.createDataFrame([(7, 2), (8, 0), (9, 1)], "g int, n int")
    lines = spark.range(3).withColumnRenamed("id", "position")
    assert rows(matching.regroup(lines, sizes, "g", "position").select("position", "g"), "position") == [(0, 7), (1, 7), (2, 9)]
