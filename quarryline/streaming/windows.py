"""Event-time windows: tumbling, sliding and session totals of events, declared once for batches and streams.

follow() takes the files that no run has taken, adds to the state its checkpoint keeps and appends each window once no more
rows are waited for: when the watermark, the latest time seen less the delay, has passed its end. closed() gives the same
rows from a table in one go. Both agree however the rows are dealt over files, as long as no row comes later than the delay; rows that
do are left out by follow() and counted in what it returns, and closed() over all files gives the windows with them.

Rows without a time belong to no window. A null value counts as a row and adds nothing; null keys make up a group of their own;
repeated rows count each; an empty table gives no rows. Other columns are not read. Times without a zone are read as UTC, so
windows do not depend on the session's zone. Totals are aggregated before they are shuffled, sessions merged before too, so that a
frequent key costs no more rows than it has sessions a partition. State lies in RocksDB, on disk.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "ts timestamp_ntz, user_id long, event_type string, value double"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


@dataclass(frozen=True)
class Windows:
    """size alone: tumbling; with slide: sliding; gap: sessions that end after a gap without rows. by: the keys of a group."""

    by: tuple[str, ...]
    size: str = ""
    slide: str = ""
    gap: str = ""
    delay: str = "1 hour"

    def __post_init__(self):
        if bool(self.size) == bool(self.gap) or (self.gap and self.slide):
            raise ValueError("give a size, a size and a slide, or a gap")

    def column(self) -> Column:
        return F.session_window("ts", self.gap) if self.gap else F.window("ts", self.size, self.slide or self.size)


def timed(events: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """ts as an instant, the keys and value."""
    ts = F.col("ts")
    if dict(events.dtypes)["ts"] == "timestamp_ntz":
        ts = F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts))
    return events.select(ts.alias("ts"), *by, "value")


def totals(rows: DataFrame, w: Windows) -> DataFrame:
    """start, end, the keys, n, total, least and most of each window of timed rows."""
    found = rows.groupBy(w.column().alias("w"), *w.by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most")
    )
    return found.select("w.start", "w.end", *w.by, "n", "total", "least", "most")


def closed(events: DataFrame, w: Windows) -> DataFrame:
    """The windows that end before the latest time less the delay; times of a watermark are whole milliseconds."""
    rows = timed(events, w.by)
    latest = rows.agg(F.date_trunc("MILLISECOND", F.max("ts")).alias("t")).select(F.unix_micros(F.col("t") - F.expr(f"INTERVAL {w.delay}"))).first()[0]
    if latest is None:
        return totals(rows, w).limit(0)
    return totals(rows, w).where(F.unix_micros("end") <= latest)


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """A stream keeps the settings it starts with, so they are put back at once."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def follow(spark: SparkSession, source: str, out: str, checkpoint: str, w: Windows, schema: str = EVENTS, files_a_batch: int = 1000) -> dict[str, int]:
    """Take the new Parquet files of source (a folder or pattern) into the windows and append those that are closed to out;
    returns the rows read and how many came too late, where rows of a window and key that a task has summed already count as one."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    rows = timed(stream, w.by).withWatermark("ts", w.delay)
    with settings(spark, SETTINGS):
        query = totals(rows, w).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out, format="parquet")
    query.awaitTermination()
    seen = query.recentProgress
    return {"rows": sum(p["numInputRows"] for p in seen), "late": sum(o["numRowsDroppedByWatermark"] for p in seen for o in p["stateOperators"])}


def read(spark: SparkSession, out: str, w: Windows, schema: str = EVENTS) -> DataFrame:
    """The windows that follow() has closed so far."""
    empty = totals(timed(spark.createDataFrame([], schema), w.by), w)
    return spark.read.schema(empty.schema).parquet(out)
