"""Dates and windows as Column expressions. Windows are [start, end): the end is exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _days(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def _bin(k: Column, start: Column, end: Column) -> Column:
    return F.struct(k.cast("int").alias("k"), start.alias("start"), end.alias("end"))


def year_window(year: Column) -> Column:
    """The calendar year as ``struct(start, end)``."""
    return F.struct(F.make_date(year, F.lit(1), F.lit(1)).alias("start"), F.make_date(year + 1, F.lit(1), F.lit(1)).alias("end"))


def window_of(mode: Column, year: Column, start: Column, end: Column) -> Column:
    """``range`` passes its dates, ``year`` is the calendar year, null means the default season of 2022."""
    default = F.struct(F.lit("2022-06-01").cast("date").alias("start"), F.lit("2022-09-01").cast("date").alias("end"))
    return F.when(mode == "year", year_window(year)).when(mode == "range", F.struct(start.alias("start"), end.alias("end"))).otherwise(default)


def valid_window(start: Column, end: Column) -> Column:
    return F.coalesce(start < end, F.lit(False))


def equal_bins(start: Column, end: Column, n: int) -> Column:
    """``n`` bins of equal days; a bin of no width becomes one day, or goes where that leaves the window."""
    days = _days(start, end)
    # Whole-day arithmetic: days * i div n, exact in integers.
    at = lambda i: F.date_add(start, F.floor((days * i) / F.lit(n)).cast("int"))

    def one(i: Column) -> Column:
        s = at(i)
        e = F.when(i == n - 1, end).otherwise(at(i + 1))
        return _bin(i, s, F.when(e > s, e).otherwise(F.least(end, F.date_add(s, 1))))

    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one), lambda b: b["start"] < b["end"])


def fixed_bins(start: Column, end: Column, stride_days: int, max_bins: int | None = None) -> Column:
    """Bins of ``stride_days`` anchored at the start, the last cut at the end; at most ``max_bins``."""
    n = F.ceil(_days(start, end) / stride_days).cast("int")
    if max_bins is not None:
        n = F.least(n, F.lit(max_bins))
    one = lambda i: _bin(i, F.date_add(start, i * stride_days), F.least(end, F.date_add(start, (i + 1) * stride_days)))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), one)).otherwise(F.array().cast("array<struct<k:int,start:date,end:date>>"))


def fixed_or_equal_bins(start: Column, end: Column, stride_days: int, max_bins: int) -> Column:
    """``struct(bins, stretched)``: fixed bins if they leave less than a stride uncovered, else ``max_bins`` equal ones."""
    fixed = fixed_bins(start, end, stride_days, max_bins)
    covers = _days(F.element_at(fixed, -1)["end"], end) < stride_days
    return F.struct(F.when(covers, fixed).otherwise(equal_bins(start, end, max_bins)).alias("bins"), (~covers).alias("stretched"))


def midpoint(start: Column, end: Column) -> Column:
    return F.date_add(start, F.floor(_days(start, end) / 2).cast("int"))


def auto_frames(start: Column, end: Column, max_frames: int = 4, stride_days: int = 28) -> Column:
    """How many frames a window is worth: one per stride, from 1 to ``max_frames``."""
    return F.least(F.greatest(F.floor(_days(start, end) / stride_days).cast("int"), F.lit(1)), F.lit(max_frames))


def day_of_year0(d: Column) -> Column:
    """0 to 364: the last two days of a leap year are one."""
    return F.least(F.lit(364), F.dayofyear(d) - 1)


def month0(d: Column, override: Column | None = None) -> Column:
    """0 to 11; an override is a month from 1, clamped to the year."""
    own = F.month(d) - 1
    return own if override is None else F.coalesce(F.greatest(F.least(override, F.lit(12)), F.lit(1)) - 1, own)


def calendar_parts(d: Column) -> Column:
    """``struct(day, month0, year)``; the first of January 2022 for null."""
    d = F.coalesce(d, F.lit("2022-01-01").cast("date"))
    return F.struct(F.dayofmonth(d).alias("day"), (F.month(d) - 1).alias("month0"), F.year(d).alias("year"))


def cyclic_time(ts: Column) -> Column:
    """ISO week and hour as sines and cosines: ``[sin week, cos week, sin hour, cos hour]``."""
    week, hour = F.weekofyear(ts) * (2 * F.pi() / 52), F.hour(ts) * (2 * F.pi() / 24)
    return F.array(F.sin(week), F.cos(week), F.sin(hour), F.cos(hour))


def temporal_meta(mode: Column, start: Column, end: Column) -> Column:
    return F.struct(mode.alias("mode"), F.date_format(start, "yyyy-MM-dd").alias("start"), F.date_format(end, "yyyy-MM-dd").alias("end"), F.when(mode == "year", F.year(start)).alias("year"))


def year_doy(d: Column) -> Column:
    """``struct(year, doy)``, the day of the year from 1."""
    return F.struct(F.year(d).alias("year"), F.dayofyear(d).alias("doy"))


def start_year(mode: Column, year: Column, start: Column, default: int = 2021) -> Column:
    """The year of a window: its own, or that of a range's start; the default for none."""
    return F.when(mode == "year", year.cast("int")).when(mode == "range", F.year(start)).otherwise(F.lit(default))


def utc_text(ts: Column) -> Column:
    """A UTC timestamp as ISO text with both the offset and the letter, as export manifests have it. The session's time
    zone is UTC."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00Z"))


def window_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """``struct(start, end)`` that two windows have in common; null if they have none."""
    s, e = F.greatest(a_start, b_start), F.least(a_end, b_end)
    return F.when(s < e, F.struct(s.alias("start"), e.alias("end")))


def sampling_warnings(stretched: Column, n_bins: Column, n_dropped: Column) -> Column:
    """What is to be said of a series: bins wider than wanted, bins without a scene."""
    said = F.array(
        F.when(stretched, F.concat(F.lit("window stretched over "), n_bins, F.lit(" bins"))),
        F.when(n_dropped > 0, F.concat(n_dropped, F.lit(" of "), n_bins, F.lit(" bins dropped"))),
    )
    return F.array_compact(said)
