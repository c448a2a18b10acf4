"""Changes of live bytes per heap over a stream of events."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions import scalars


def live_byte_changes(events: DataFrame, lateness: str = "1 second", bucket: int = scalars.BUCKET) -> DataFrame:
    """bucket, heap, change from a stream of (ts in clocks, heap, delta).

    Clocks stand for microseconds of event time, so tumbling windows are the timeline's
    buckets; rows later than the watermark are left out, and LateRows counts them. A running sum over the result,
    one row for each bucket and heap, is the timeline.
    """
    timed = events.withColumn("_time", F.timestamp_micros(F.col("ts"))).withWatermark("_time", lateness)
    summed = timed.groupBy(F.window("_time", f"{bucket} microseconds"), "heap").agg(F.sum("delta").alias("change"))
    return summed.select(F.expr(f"unix_micros(window.start) div {bucket}").alias("bucket"), "heap", "change")


class LateRows(StreamingQueryListener):
    """Counts, by query name, the rows that came after the watermark and so are lost; add it with spark.streams.addListener.

    Spark counts them where state is updated, after rows of one bucket and batch have been added up.
    """

    def __init__(self):
        self.lost: Counter = Counter()

    def onQueryProgress(self, event) -> None:
        self.lost[event.progress.name] += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
