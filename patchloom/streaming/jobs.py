"""Jobs as a stream: a state machine and a gapless sequence for each, kept in Spark's state store with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What may follow a job's state; a job begins queued, and the last two are final (fixed values).
NEXT = {None: ("queued",), "queued": ("running", "failed"), "running": ("completed", "failed"), "completed": (), "failed": ()}
STATE = "status string, seq long, due long"
OUT = "job_id string, seq long, status string, ts timestamp, accepted boolean, note string"


def prepare(spark: SparkSession) -> SparkSession:
    """Timers and several values a key need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def step(status: str | None, to: str) -> bool:
    return to in NEXT.get(status, ())


class JobMachine(StatefulProcessor):
    """One job's state, the number of its last accepted event, and when it counts as stuck."""

    def __init__(self, stuck_after: float):
        self.stuck_after = stuck_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def known(self) -> tuple[str | None, int, int | None]:
        row = self.job.get() if self.job.exists() else None
        return (row[0], int(row[1]), row[2]) if row else (None, 0, None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, seq, due = self.known()
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for e in events.itertuples():
            if step(status, e.status):
                status, seq = e.status, seq + 1
                out.append((key[0], seq, status, e.ts, True, None))
                if due is not None:
                    self.handle.deleteTimer(due)
                    due = None
                if NEXT[status]:
                    due = int(e.ts.timestamp() * 1000 + self.stuck_after * 1000)
                    self.handle.registerTimer(due)
            else:
                out.append((key[0], None, e.status, e.ts, False, f"not after {status or 'nothing'}"))
        self.job.update((status, seq, due))
        yield frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, seq, due = self.known()
        if due is not None and due <= expiredTimerInfo.getExpiryTimeInMs() and NEXT.get(status):
            self.job.update(("failed", seq + 1, None))
            yield frame([(key[0], seq + 1, "failed", pd.Timestamp(due, unit="ms"), True, f"stuck while {status}")])
        else:
            yield frame([])

    def close(self) -> None:
        pass


def frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["job_id", "seq", "status", "ts", "accepted", "note"])
    return out.astype({"seq": "Int64", "ts": "datetime64[us]", "accepted": "bool"})


def jobs(events: DataFrame, late: str = "10 minutes", stuck_after: float = 3600.0) -> DataFrame:
    """events (job_id, event_id, status, ts) to what became of each: job_id, seq, status, ts, accepted, note.

    Accepted events are numbered without gaps within a job, over all batches and restarts, as number and state are one
    value of the state store. Events that may not follow are handed on with accepted = false and change nothing. A job
    that isn't final ``stuck_after`` seconds after its last accepted event, by the watermark, fails by its timer. Events
    later than the watermark are dropped, rows of null job_id or ts too. A job's state is one small row.
    """
    prepare(events.sparkSession)
    timed = events.where("job_id is not null and ts is not null").select("job_id", "event_id", "status", "ts").withWatermark("ts", late)
    return timed.groupBy("job_id").transformWithStateInPandas(JobMachine(stuck_after), OUT, "Append", "EventTime")
