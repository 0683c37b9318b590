"""Structured Streaming: a dump folder watched for changes, and usage counters over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import changes, partial_allowed
from ..plans.settle import settle
from ..sources.dump import read_files



def watch(spark: SparkSession, root: str, checkpoint: str, partial: Callable[[DataFrame], None], full: Callable[[], None], known: Callable[[], DataFrame], seconds: int = 5, once: bool = False) -> StreamingQuery | None:
    """Hand new and changed files of ``root`` to ``partial``, or call ``full`` where a partial rebuild will not do.

    A stream of files tells neither of removals nor of files written anew, so the stream is a clock: at each tick the
    folder's listing is compared with ``known()``, the stored snapshot ``(path, size, mtime)`` of ``read_files``, and the
    gate decides on what really changed. Listing opens no file; ``partial`` gets the changed files alone, whose number the
    gate bounds. With ``once`` there is one comparison and no stream.
    """

    def tick(_: DataFrame | None = None, __: int = 0) -> None:
        now = read_files(spark, root).select("path", "size", "mtime")
        changed = settle(changes(known(), now))
        if changed.isEmpty():
            return
        if partial_allowed(changed, now):
            partial(read_files(spark, root, paths=[r["path"] for r in changed.select("path").toLocalIterator()]))
        else:
            full()

    if once:
        tick()
        return None
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    every = f"{max(1, min(seconds, 86_400))} seconds"
    return clock.writeStream.option("checkpointLocation", checkpoint).foreachBatch(tick).trigger(processingTime=every).start()


def usage_counters(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes", time: str = "ts", target: str = "event_type") -> DataFrame:
    """Uses per target and tumbling window of event time, for streams and tables alike (an addition, not parity)."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, window).alias("w"), target).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), target, "n")
