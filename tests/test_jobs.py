"""Job states: the stream, over several batches, is the fold over the whole table."""

from datetime import datetime, timedelta

from inkframe.streaming import jobs

START = datetime(2024, 1, 1)
SCHEMA = "job long, request long, at timestamp, wanted string"


def at(minutes):
    return START + timedelta(minutes=minutes)


LOG = [
    (1, 1, at(0), "queued"), (1, 2, at(1), "completed"), (1, 3, at(2), "running"), (1, 4, at(3), "review"), (1, 5, at(4), "queued"), (1, 6, at(5), "running"), (1, 7, at(6), "completed"), (1, 8, at(7), "queued"),
    (2, 10, at(0), "running"), (2, 11, at(1), "queued"), (2, 12, at(2), "running"), (2, 13, at(60), "running"), (2, 14, at(121), "queued"),
    (3, 20, at(1), "queued"), (3, 21, at(2), "running"),
    (4, 30, at(5), "queued"), (4, 31, at(150), "running"), (4, 32, at(155), None), (4, 33, at(159), "failed"),
]
WANT = {
    (1, 1): (None, True), (1, 2): ("queued", False), (1, 3): ("queued", True), (1, 4): ("running", True), (1, 5): ("review", True), (1, 6): ("queued", True), (1, 7): ("running", True), (1, 8): ("completed", False),
    (2, 10): (None, False), (2, 11): (None, True), (2, 12): ("queued", True), (2, 13): ("running", False), (2, None): ("running", True), (2, 14): ("failed", True),
    (3, 20): (None, True), (3, 21): ("queued", True), (3, None): ("running", True),
    (4, 30): (None, True), (4, 31): ("queued", True), (4, 32): ("running", False), (4, 33): ("running", True),
}


def found(frame):
    rows = [((r["job"], r["request"]), (r["before"], r["granted"]), r["at"], r["stale"]) for r in frame.collect()]
    assert len(rows) == len({k for k, *_ in rows})
    assert all((k[1] is None) == stale for k, _, _, stale in rows)
    stale = {k[0]: when for k, _, when, s in rows if s}
    assert stale == {2: at(102), 3: at(102)}
    return {k: v for k, v, *_ in rows}


def test_a_table_of_requests(spark):
    assert found(jobs.transitions(spark.createDataFrame(LOG, SCHEMA), timedelta(minutes=100))) == WANT
    assert jobs.transitions(spark.createDataFrame([], SCHEMA), timedelta(minutes=100)).collect() == []


def test_a_stream_in_batches(spark, tmp_path):
    """Batches end in the middle of jobs, and the stream is stopped and goes on at its checkpoint."""
    folder = f"file://{tmp_path}/in"
    stream = lambda: jobs.stream_transitions(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), timedelta(minutes=100))
    for low, high in ((0, 3), (3, 61), (61, 158), (158, 200)):
        rows = [r for r in LOG if at(low) <= r[2] < at(high)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        got = jobs.drain(stream(), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    assert found(got) == WANT
