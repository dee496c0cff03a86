"""Incremental arrival of files: bounded micro-batches, running totals, expiry and progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def arriving(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_trigger: int = 8) -> DataFrame:
    """New files of a folder as a stream, at most so many in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def drain(df: DataFrame, out: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append all that is there now, remember it, and stop; the next call takes what has come since."""
    return df.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)


def running_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """Totals for each key so far; write in update or complete mode, order of arrival does not matter."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total"))


def live_tasks(df: DataFrame, time: str = "ts", keep: str = "1 hour") -> DataFrame:
    """Tasks seen in windows of ``keep``; the watermark lets state older than that go."""
    return df.withWatermark(time, keep).groupBy(F.window(time, keep), "task_id").agg(F.max_by("status", time).alias("status"))


class Progress(StreamingQueryListener):
    """Tells a callback (rows so far, message) at each micro-batch, only when something has changed."""

    def __init__(self, tell: Callable[[int, str], None]) -> None:
        self.tell, self.rows = tell, 0

    def onQueryStarted(self, event) -> None:
        self.tell(0, "started")

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows:
            self.rows += event.progress.numInputRows
            self.tell(self.rows, f"batch {event.progress.batchId}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell(self.rows, "failed" if event.exception else "done")


def with_cancel(spark: SparkSession, group: str, job: Callable[[], object]) -> object:
    """Run a job under a name by which ``spark.sparkContext.cancelJobGroup`` stops it."""
    spark.sparkContext.setJobGroup(group, group, interruptOnCancel=True)
    return job()
