"""What each reading of a watched source means, as a keyed state machine over a stream and as one query of a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Failures of which two in a row are worth a review; other errors aren't.
FAILURES = ("unreachable", "blocked")
OUTCOME = "key string, at long, field string, old_value string, new_value string"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Watcher(StatefulProcessor):
    """Readings of a source in time order: its last status, the content of its last good reading, and what is overdue.

    A failed read keeps the content; the second failure in a row is an outcome and so is each one after it.
    The first good read is a baseline, later ones are outcomes when the content differs. A source that
    isn't read for ``remind`` microseconds is due for a reminder, once; after ``forget`` nothing of it is kept.
    """

    def __init__(self, remind: int, forget: int):
        self.remind, self.forget = remind, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string, at long, reminded boolean")
        self.content = handle.getValueState("content", "content string")

    def _reset(self) -> None:
        self.status.clear()
        self.content.clear()

    def _wake(self, at: int, fresh: bool) -> None:
        for t in () if fresh else list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        for wait in (self.remind, self.forget):
            self.handle.registerTimer(-(-(at + wait) // 1000))  # timers count whole milliseconds

    def _steps(self, key: str, own: list[tuple], last: tuple | None, known: str | None, out: list[tuple]) -> tuple[tuple | None, str | None]:
        """(last, known) after the readings, whose outcomes go to ``out``."""
        for at, _, status, content in own:
            at = int(at)
            if last is not None:
                if at < last[1]:
                    continue  # read before what is known already
                if at - last[1] > self.remind and not last[2]:
                    out.append((key, last[1] + self.remind, "overdue", last[0], None))
                if at - last[1] > self.forget:
                    last = known = None
            if status != "ok":
                if last is not None and last[0] in FAILURES and status in FAILURES:
                    out.append((key, at, "unreachable", last[0], status))
            else:
                if known is not None and known != content:
                    out.append((key, at, "content", known, content))
                if content is not None:
                    known = content
            last = (status, at, False)
        return last, known

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Each call to the state is a message to the JVM, so it is read once and written once, however many readings there are.
        out, own = [], sorted(r for f in rows for r in zip(f["at"].tolist(), f["reading"].tolist(), f["status"].tolist(), f["content"].tolist()))
        if not own:
            return
        old = self.status.get()
        content = None if old is None else self.content.get()
        known = content and content[0]
        last, new = self._steps(key[0], own, old and tuple(old), known, out)
        self.status.update(last)
        if new is None and known is not None:
            self.content.clear()
        elif new != known:
            self.content.update((new,))
        self._wake(last[1], old is None)
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "field", "old_value", "new_value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, last = expiredTimerInfo.getExpiryTimeInMs() * 1000, self.status.get()
        if last is None:
            return
        if now >= last[1] + self.forget:
            self._reset()
        elif not last[2]:
            self.status.update((last[0], last[1], True))
            yield pd.DataFrame([(key[0], last[1] + self.remind, "overdue", last[0], None)], columns=["key", "at", "field", "old_value", "new_value"])

    def close(self) -> None:
        pass


def watch_stream(readings: DataFrame, remind_hours: int = 6, forget_hours: int = 72, late: str = "1 hour") -> DataFrame:
    """OUTCOME rows of a stream of readings (key, ts, reading, status, content).

    State is two small values and two timers for each source, and goes when the source isn't read any more.
    ``reading`` orders readings of equal time. A null content is never a change. The session needs the
    state store of STATE_STORE.
    """
    rows = readings.where("key IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    rows = rows.select(F.col("key").cast("string").alias("key"), "ts", F.unix_micros("ts").alias("at"), F.col("reading").cast("long").alias("reading"), F.coalesce("status", F.lit("error")).alias("status"), F.coalesce("content", F.lit("")).alias("content"))
    return rows.groupBy("key").transformWithStateInPandas(Watcher(remind_hours * 3_600_000_000, forget_hours * 3_600_000_000), OUTCOME, "Append", "EventTime")


def watch_table(readings: DataFrame, remind_hours: int = 6, forget_hours: int = 72, late_hours: int = 1) -> DataFrame:
    """The OUTCOME rows that ``watch_stream`` gives for the same readings, as windows over a table.

    A source's time is cut where it was forgotten; within a part each reading sees the status of the one
    before it and the last content. The end of the stream is the latest time less the watermark's delay.
    """
    remind, forget = remind_hours * 3_600_000_000, forget_hours * 3_600_000_000
    rows = readings.where("key IS NOT NULL AND ts IS NOT NULL").select(
        F.col("key").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("reading").cast("long").alias("reading"), F.coalesce("status", F.lit("error")).alias("status"), F.coalesce("content", F.lit("")).alias("content"),
    )
    order = Window.partitionBy("key").orderBy("at", "reading")
    rows = rows.withColumn("before", F.lag("at").over(order)).withColumn("after", F.lead("at").over(order))
    rows = rows.withColumn("part", F.sum(F.when(F.col("at") - F.col("before") > forget, 1).otherwise(0)).over(order))
    within = Window.partitionBy("key", "part").orderBy("at", "reading")
    good = F.when(F.col("status") == "ok", F.col("content"))
    rows = rows.withColumn("old_status", F.lag("status").over(within)).withColumn("known", F.last(good, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1)))
    end = F.broadcast(rows.agg((F.max("at") - late_hours * 3_600_000_000).alias("end")))  # one row
    rows = rows.crossJoin(end)
    null = F.lit(None).cast("string")
    failed = F.when(F.col("status").isin(*FAILURES) & F.col("old_status").isin(*FAILURES), F.struct("at", F.lit("unreachable").alias("field"), F.col("old_status").alias("old_value"), F.col("status").alias("new_value")))
    changed = F.when((F.col("status") == "ok") & (F.col("known") != F.col("content")), F.struct("at", F.lit("content").alias("field"), F.col("known").alias("old_value"), F.col("content").alias("new_value")))
    due = F.coalesce(F.col("after") - F.col("at") > remind, F.ceil((F.col("at") + remind) / 1000) * 1000 <= F.floor(F.col("end") / 1000) * 1000)
    overdue = F.when(due, F.struct((F.col("at") + remind).alias("at"), F.lit("overdue").alias("field"), F.col("status").alias("old_value"), null.alias("new_value")))
    return rows.select("key", F.explode(F.array_compact(F.array(failed, changed, overdue))).alias("o")).select("key", "o.*")
