"""Cron expressions of five fields, on datetimes and on timestamp columns.

A field is a comma-separated list of *, */n, a-b or a. A time matches if all five fields do, day of month and
weekday both; weekday 0 and 7 are Sunday.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGES = {"minute": (0, 59), "hour": (0, 23), "day": (1, 31), "month": (1, 12), "weekday": (0, 7)}


def _values(text: str, low: int, high: int) -> frozenset[int]:
    found: set[int] = set()
    for part in (p.strip() for p in text.split(",")):
        if part == "*":
            a, b, step = low, high, 1
        elif part.startswith("*/"):
            a, b, step = low, high, int(part[2:])
        else:
            first, dash, last = part.partition("-")
            a, step = int(first), 1
            b = int(last) if dash else a
        if step <= 0 or a > b or a < low or b > high:
            raise ValueError(f"invalid cron field {part!r}")
        found.update(range(a, b + 1, step))
    return frozenset(found)


@dataclass(frozen=True)
class Cron:
    minute: frozenset[int]
    hour: frozenset[int]
    day: frozenset[int]
    month: frozenset[int]
    weekday: frozenset[int]

    @staticmethod
    def parse(text: str) -> Cron:
        parts = text.split()
        if len(parts) != 5:
            raise ValueError(f"a cron expression has five fields: {text!r}")
        read = {n: _values(p, *_RANGES[n]) for p, n in zip(parts, _RANGES, strict=True)}
        read["weekday"] = frozenset(x % 7 for x in read["weekday"])
        return Cron(**read)

    def _day_matches(self, t: dt.datetime) -> bool:
        return t.day in self.day and t.month in self.month and t.isoweekday() % 7 in self.weekday

    def matches(self, t: dt.datetime) -> bool:
        return t.minute in self.minute and t.hour in self.hour and self._day_matches(t)

    def next_after(self, t: dt.datetime) -> dt.datetime:
        """The first match after t, within a year."""
        start = t.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
        day = start
        for _ in range(367):
            if self._day_matches(day):
                for hour in sorted(self.hour):
                    for minute in sorted(self.minute):
                        at = day.replace(hour=hour, minute=minute)
                        if at >= start:
                            return at
            day = (day + dt.timedelta(days=1)).replace(hour=0, minute=0)
        raise ValueError("no match within a year")

    def column(self, ts: Column) -> Column:
        """Whether timestamps match."""
        weekday = F.dayofweek(ts) - 1  # Spark's Sunday is 1
        return (
            F.minute(ts).isin(sorted(self.minute))
            & F.hour(ts).isin(sorted(self.hour))
            & F.dayofmonth(ts).isin(sorted(self.day))
            & F.month(ts).isin(sorted(self.month))
            & weekday.isin(sorted(self.weekday))
        )

    def fires_between(self, spark, start: dt.datetime, end: dt.datetime):
        """ts of each match in [start, end): one row a minute is generated and filtered on the executors."""
        minutes = int((end - start).total_seconds() // 60)
        base = start.replace(second=0, microsecond=0)
        seconds = int(base.replace(tzinfo=base.tzinfo or dt.UTC).timestamp())
        ts = F.timestamp_seconds(F.lit(seconds) + F.col("id") * 60)
        return spark.range(minutes).select(ts.alias("ts")).where(self.column(F.col("ts")))
