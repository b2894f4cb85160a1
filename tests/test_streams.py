import datetime as dt

import pytest

EVENTS = "job_id string, event_id long, status string, ts timestamp"


def at(minute):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minute)


@pytest.fixture
def stream(spark, tmp_path):
    """Writes events as a file and runs the query over what is new; each call is a restart from the checkpoint."""
    from patchloom.streaming.jobs import jobs

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    source, place, sink = (str(tmp_path / n) for n in ("in", "state", "out"))

    def run(*events):
        if events:
            spark.createDataFrame(events, EVENTS).coalesce(1).write.mode("append").parquet(source)
        read = spark.readStream.schema(EVENTS).parquet(source)
        query = jobs(read, "1 minute", 600.0).writeStream.format("parquet").option("checkpointLocation", place).option("path", sink).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(240)
        return sorted((r.job_id, r.seq or 0, r.status, r.accepted, r.note) for r in spark.read.parquet(sink).collect())

    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_jobs_over_restarts(stream):
    first = stream(("a", 1, "queued", at(0)), ("a", 3, "completed", at(1)), ("a", 2, "running", at(1)), ("b", 4, "queued", at(1)), ("c", 5, "running", at(1)), (None, 6, "queued", at(1)))
    assert first == [("a", 1, "queued", True, None), ("a", 2, "running", True, None), ("a", 3, "completed", True, None), ("b", 1, "queued", True, None), ("c", 0, "running", False, "not after nothing")]
    # the restarted query goes on with the same numbers and states
    second = stream(("a", 7, "failed", at(2)), ("b", 8, "running", at(3)), ("c", 9, "queued", at(3)))
    assert [r for r in second if r not in first] == [("a", 0, "failed", False, "not after completed"), ("b", 2, "running", True, None), ("c", 1, "queued", True, None)]
    # time goes on past the limit of b and c, which fail once
    third = stream(("d", 10, "queued", at(30)))
    fourth = stream(("d", 11, "running", at(31)), ("b", 12, "completed", at(31)))
    new = [r for r in fourth if r not in second]
    assert ("b", 3, "failed", True, "stuck while running") in new and ("c", 2, "failed", True, "stuck while queued") in new
    assert [r for r in new if r[0] == "b" and r[1]] == [("b", 3, "failed", True, "stuck while running")]
    assert [r[:3] for r in new if r[0] == "d"] == [("d", 1, "queued"), ("d", 2, "running")] and third
