"""The daily refresh as Structured Streaming: report-day totals, late revisions, the soil bucket as keyed state, alerts."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from envgrid.functions.timebuckets import TZ, expected_hours, report_day, window_end
from envgrid.operators.moisture import INTERCEPT, KEEP_DAYS, REARM, SOAK_MM, SPIN_UP


def unique_reports(stream: DataFrame, keys: list[str], time: str, late: str = "2 days") -> DataFrame:
    """Without reports that came before, as far back as the watermark reaches."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def report_day_totals(stream: DataFrame, key: str, time: str = "time", value: str = "value", late: str = "2 days", tz: str = TZ) -> DataFrame:
    """(window_end, key, total, n_hours): windows of 23, 24 or 25 hours, emitted when the watermark passes their end.

    The grouping column is the window's end itself, which carries the watermark; hours that came twice count once.
    """
    day = report_day(F.col(time), "wall7_right", tz)
    ended = stream.withColumn("window_end", window_end(day, tz)).withWatermark("window_end", late).dropDuplicates(["window_end", key, time])
    return ended.groupBy("window_end", key).agg(F.sum(value).alias("total"), F.count(value).alias("n_hours"))


def trailing_totals(stream: DataFrame, key: str, days: int = 21, day: str = "day", value: str = "value", late: str | None = "2 days") -> DataFrame:
    """Sliding totals of the last days; late is None where the stream has its watermark already."""
    w = F.window(day, f"{days} days", "1 day")
    return (stream.withWatermark(day, late) if late else stream).groupBy(w, key).agg(F.sum(value).alias("total"))


def basin_days(stream: DataFrame, weights: DataFrame, key: str = "basin_id", time: str = "time", value: str = "value", late: str = "2 days", tz: str = TZ) -> DataFrame:
    """(window_end, report_date, key, mean, cover_frac, n_hours) of polygons from a stream of hourly cells (row, col, time, value).

    Hours become report days for each cell first, then cells become polygons by their stored area weights; both aggregations
    follow the same watermark, so a day is given once, when it is over. Beside its sum a cell carries which of its hours had a
    value, a bit for each; a polygon's valid hours are the bits that any of its cells has. weights is (row, col, key, area, poly_area).
    """
    day = report_day(F.col(time), "wall7_right", tz)
    ended = stream.withColumn("window_end", window_end(day, tz)).withWatermark("window_end", late).dropDuplicates(["window_end", "row", "col", time])
    hour = F.expr(f"shiftleft(1, cast((unix_seconds(window_end) - unix_seconds(`{time}`)) / 3600 AS int))")
    cells = ended.groupBy("window_end", "row", "col").agg(F.sum(value).alias("_v"), F.bit_or(F.when(F.col(value).isNotNull(), hour).otherwise(0)).alias("_h"))
    have = F.sum(F.when(F.col("_v").isNotNull(), F.col("area")))
    basins = cells.join(weights, ["row", "col"]).groupBy("window_end", key).agg(
        (F.sum(F.col("area") * F.col("_v")) / F.nullif(have, F.lit(0.0))).alias("mean"), (F.coalesce(have, F.lit(0.0)) / F.max("poly_area")).alias("cover_frac"), F.bit_count(F.bit_or("_h")).cast("long").alias("n_hours")
    )
    return basins.withColumn("report_date", F.to_date(F.from_utc_timestamp("window_end", tz)))


def gap_alerts(totals: DataFrame, tz: str = TZ) -> DataFrame:
    """Closed windows with fewer hours than they have."""
    day = F.to_date(F.from_utc_timestamp("window_end", tz))
    return totals.withColumn("report_date", day).withColumn("expected", expected_hours(day, tz)).where(F.col("n_hours") < F.col("expected"))


def upsert_batches(path: str, day: str = "report_date"):
    """A foreachBatch function: the dates that a batch holds replace those of the table, the others stay."""
    def write(batch: DataFrame, _: int) -> None:
        (batch.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path))

    return write


DAY_MS = 86_400_000
#: Days of a cell that wait within its state.
NEAR = 64


class SoilBucket(StatefulProcessor):
    """The soil fold for one cell: days that are next are folded as they come, others are kept until they are.

    Input: key, n (day number), p, pet, cap and, if timed, day (the timestamp of day n). Output: one row for each folded day with
    the state after it. If timed, a day that the watermark has passed is missing for good: a timer at its date lets the fold
    go on with the next day that is there, as a fold over the days of a table does. A day that comes after that is refused. So the
    days that wait are those within the watermark's delay.

    A cell's state is read and written once a batch, whatever the number of its days: the next NEAR days that wait are in it,
    four numbers each. Only those beyond are rows of their own, each written, read and removed once; the state knows how many.
    """

    def __init__(self, timed: bool = False):
        self.timed = timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "next int, s double, armed boolean, wet int, soak int, k array<double>, origin bigint, timer bigint, held int, near array<double>")
        self.waiting = handle.getMapState("waiting", "n int", "p double, pet double, cap double")

    def held(self) -> tuple:
        return self.state.get() or (0, None, True, None, None, [], None, None, 0, [])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.held()
        at, origin = before[0], before[6]
        passed = timerValues.getCurrentWatermarkInMs() if self.timed else 0
        number = lambda v: math.nan if v is None else float(v)
        fresh = {}
        for r in rows:
            if origin is None and self.timed:
                origin = int(pd.Timestamp(r.day).timestamp() * 1000) - r.n * DAY_MS
            if r.n >= at and not (self.timed and origin + r.n * DAY_MS <= passed):
                fresh[r.n] = (number(r.p), number(r.pet), None if r.cap is None or r.cap != r.cap else float(r.cap))
        return self.folded(key, (*before[:6], origin, *before[7:]), fresh, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = self.held()
        return self.folded(key, (*before[:7], None, *before[8:]), {}, timerValues)

    def folded(self, key, before: tuple, fresh: dict[int, tuple], timerValues) -> Iterator[Row]:
        """Folds the days that are next, over missing ones that the watermark has passed; fresh ones that are not next wait."""
        at, s, armed, wet, soak, k, origin, timer, held, near = before
        k, ahead, out = list(k), None, []
        fresh = {int(near[j]): tuple(near[j + 1 : j + 4]) for j in range(0, len(near), 4)} | fresh
        passed = timerValues.getCurrentWatermarkInMs() if self.timed and origin is not None else None
        while True:
            day, old = fresh.pop(at, None), self.waiting.getValue((at,)) if held else None
            if old is not None:
                self.waiting.removeKey((at,))
                held -= 1
                day = day or old  # a day that comes again takes the place of the one that waits
            if day is None:
                if passed is None or not (held or fresh):
                    break
                if ahead is None:
                    ahead = sorted({*fresh, *((n for (n,) in self.waiting.keys()) if held else ())})
                last = min((passed - origin) // DAY_MS + 1, ahead[bisect_left(ahead, at)])
                if last <= at:
                    break
                at = last
                continue
            p, pet, cap = day
            if s is None and cap is not None:
                s = 0.5 * cap
            armed = armed or (cap is not None and s / cap < REARM)
            hit = p >= SOAK_MM
            if hit and armed:
                armed, wet = False, at
            if hit and at >= SPIN_UP:
                soak = at
            if cap is not None:
                full = min(s + INTERCEPT * p, cap)
                s = max(full - pet * full / cap, 0.0)
            if at >= SPIN_UP:
                k = [*k, None if cap is None else s / cap][-KEEP_DAYS:]
            out.append(Row(cell=key[0], n=at, s=None if s != s else s, armed=armed, wet=wet, soak=soak))
            at += 1
        waits = sorted(fresh)
        for n in waits[NEAR:]:
            held += not (held and self.waiting.containsKey((n,)))
            self.waiting.updateValue((n,), fresh[n])
        near = [float(x) if x is not None else None for n in waits[:NEAR] for x in (n, *fresh[n])]
        if self.timed and origin is not None and (held or near):
            due = origin + at * DAY_MS
            if timer != due:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)
                timer = due
        self.state.update((at, s, armed, wet, soak, k, origin, timer, held, near))
        return iter(out)

    def close(self) -> None:
        pass


def soil_stream(stream: DataFrame, key: str = "cell", day: str | None = None, late: str = "2 days") -> DataFrame:
    """State of each cell after each day; needs the RocksDB state store provider.

    With day, the column of the days' dates, days that don't come are passed over once the watermark says so; without it the fold waits for each day.
    """
    rows = stream if day is None else stream.withColumnRenamed(day, "day").withWatermark("day", late)
    return rows.groupBy(key).transformWithState(SoilBucket(day is not None), f"cell {stream.schema[key].dataType.simpleString()}, n int, s double, armed boolean, wet int, soak int", "append", "none" if day is None else "eventTime")
