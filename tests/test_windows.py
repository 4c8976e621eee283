from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pytest

from quillstream.operators.windows import Window, WindowError, WindowType, window, within


def local(tz, *at):
    return datetime(*at, tzinfo=ZoneInfo(tz))


@pytest.mark.parametrize(
    ("kind", "tz", "start"),
    [
        (WindowType.ROLLING_3D, "Asia/Shanghai", (2024, 3, 7, 15)),
        (WindowType.ROLLING_7D, "Asia/Shanghai", (2024, 3, 3, 15)),
        (WindowType.MONTH_TO_DATE, "Asia/Shanghai", (2024, 3, 1)),
        (WindowType.YEAR_TO_DATE, "Asia/Shanghai", (2024, 1, 1)),
        (WindowType.ROLLING_3D, "America/New_York", (2024, 3, 7, 15)),
        (WindowType.ROLLING_3D, "Asia/Kolkata", (2024, 3, 7, 15)),
    ],
)
def test_bounds(kind, tz, start):
    w = window(kind, local(tz, 2024, 3, 10, 15, 45, 30), tz)
    assert w.end == local(tz, 2024, 3, 10, 15)
    assert w.start == local(tz, *start)


def test_days_are_calendar_days():
    w = window(WindowType.ROLLING_3D, local("America/New_York", 2024, 3, 10, 15, 45), "America/New_York")
    assert (w.end - w.start).total_seconds() == 71 * 3600


def test_half_hour_zone():
    assert window(WindowType.ROLLING_3D, local("Asia/Kolkata", 2024, 3, 10, 15, 45), "Asia/Kolkata").end.minute == 30


def test_month_that_has_just_begun():
    w = window(WindowType.MONTH_TO_DATE, datetime(2024, 3, 1, 0, 20, tzinfo=UTC), "UTC")
    assert w.start == w.end == datetime(2024, 3, 1, tzinfo=UTC)


def test_default_zone():
    now = datetime(2024, 3, 10, 15, 45, tzinfo=UTC)
    assert window(3, now, "") == window(3, now, "Asia/Shanghai")


def ms(*at):
    return round(datetime(*at, tzinfo=UTC).timestamp() * 1000)


def test_custom():
    now = datetime(2024, 3, 10, tzinfo=UTC)
    w = window(5, now, "UTC", (ms(2024, 3, 1, 10, 59), ms(2024, 3, 1, 12, 59)))
    assert (w.from_ms, w.to_ms) == (ms(2024, 3, 1, 10), ms(2024, 3, 1, 12))
    assert window(5, now, "UTC", (ms(2023, 3, 1), ms(2024, 2, 29)))  # 365 days
    same = window(5, now, "UTC", (ms(2024, 3, 1), ms(2024, 3, 1)))
    assert same.start == same.end


@pytest.mark.parametrize(
    ("kind", "tz", "custom"),
    [(5, "UTC", None), (5, "UTC", (2, 1)), (9, "UTC", None), (1, "Nowhere/Town", None), (5, "UTC", (ms(2023, 3, 1), ms(2024, 2, 29, 1)))],
)
def test_errors(kind, tz, custom):
    with pytest.raises(WindowError):
        window(kind, datetime(2024, 3, 10, tzinfo=UTC), tz, custom)


def test_both_bounds_belong_to_the_window(spark):
    w = Window(datetime(2024, 3, 1, 10, tzinfo=UTC), datetime(2024, 3, 1, 12, tzinfo=UTC))
    rows = spark.sql("""select cast(x as timestamp_ntz) as recorded_at from values ('2024-03-01 10:00:00'), ('2024-03-01 12:00:00'),
        ('2024-03-01 09:59:59.999999'), ('2024-03-01 12:00:00.000001') as t(x)""")
    assert within(rows, w).count() == 2
    assert "PushedFilters" in within(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), w, "ts")._jdf.queryExecution().toString()
