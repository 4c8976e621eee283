"""Time windows: bounds of the five window types, in any zone (TW1 to TW7).

Bounds are computed on the driver and go into scans as literals, so that they are pushed down. `now` is
always a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from enum import IntEnum
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_ZONE = "Asia/Shanghai"
LONGEST = timedelta(days=365)


class WindowType(IntEnum):
    ROLLING_3D = 1
    ROLLING_7D = 2
    MONTH_TO_DATE = 3
    YEAR_TO_DATE = 4
    CUSTOM = 5


class WindowError(ValueError):
    """The request names no valid window."""


@dataclass(frozen=True)
class Window:
    start: datetime  # both in UTC; rows at either bound belong to the window
    end: datetime

    @property
    def from_ms(self) -> int:
        return round(self.start.timestamp() * 1000)

    @property
    def to_ms(self) -> int:
        return round(self.end.timestamp() * 1000)


def _hour(x: datetime) -> datetime:
    return x.replace(minute=0, second=0, microsecond=0)


def window(kind: int, now: datetime, tz: str = "", custom: tuple[int, int] | None = None) -> Window:
    """Bounds in UTC. Days are calendar days of the zone; the current hour, not over yet, is left out.

    now: aware. custom: epoch milliseconds from and to, floored to the hour; up to 365 days.
    """
    try:
        zone = ZoneInfo(tz or DEFAULT_ZONE)
    except Exception as e:
        raise WindowError(f"unknown time zone {tz!r}") from e
    local = now.astimezone(zone).replace(tzinfo=None)
    aware = lambda x: x.replace(tzinfo=zone).astimezone(UTC)
    end = _hour(local)
    if kind in (WindowType.ROLLING_3D, WindowType.ROLLING_7D):
        start = end - timedelta(days=3 if kind == WindowType.ROLLING_3D else 7)
    elif kind == WindowType.MONTH_TO_DATE:
        start = end.replace(day=1, hour=0)
    elif kind == WindowType.YEAR_TO_DATE:
        start = end.replace(month=1, day=1, hour=0)
    elif kind == WindowType.CUSTOM:
        if custom is None:
            raise WindowError("a custom window needs bounds")
        first, last = (datetime.fromtimestamp(ms / 1000, UTC).astimezone(zone) for ms in custom)
        if first > last:
            raise WindowError("the window ends before it starts")
        start, end = (_hour(x).astimezone(UTC) for x in (first, last))
        if end - start > LONGEST:
            raise WindowError("the window is longer than 365 days")
        return Window(start, end)
    else:
        raise WindowError(f"unknown window type {kind}")
    return Window(aware(start), aware(end))


def ntz(x: datetime) -> Column:
    """A literal without zone, in UTC."""
    return F.lit(x.astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def within(df: DataFrame, w: Window, column: str = "recorded_at") -> DataFrame:
    """Rows of the window, both bounds included (SRC1)."""
    return df.where((F.col(column) >= ntz(w.start)) & (F.col(column) <= ntz(w.end)))
