"""Minutes of the day, local time and weekdays as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerolith.functions.geo import col

DAY_NAMES = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def circ_diff(a, b) -> Column:
    """Distance of two minutes on the circle of a day."""
    return F.abs(F.pmod(col(a) - col(b) + 720, F.lit(1440)) - 720)


def hhmm(minute) -> Column:
    m = col(minute)
    return F.when(m.isNotNull(), F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int")))


def local_time(epoch, tz) -> Column:
    """Local wall time of an epoch second; null if the zone is null."""
    return F.from_utc_timestamp(F.timestamp_seconds(col(epoch)), col(tz))


def local_minute(epoch, tz) -> Column:
    t = local_time(epoch, tz)
    return F.hour(t) * 60 + F.minute(t)


def local_day(epoch, tz) -> Column:
    return F.to_date(local_time(epoch, tz))


def weekday(day) -> Column:
    """0 is Monday."""
    return F.weekday(col(day))


def weekday_times(weekdays) -> Column:
    """[{day, dep, arr}] Monday first, from a map of weekday to struct(dep, arr); empty for null."""
    names = F.array(*map(F.lit, DAY_NAMES))
    entries = F.array_sort(F.map_entries(col(weekdays)))
    named = F.transform(entries, lambda e: F.struct(F.element_at(names, e["key"] + 1).alias("day"), hhmm(e["value"]["dep"]).alias("dep"), hhmm(e["value"]["arr"]).alias("arr")))
    return F.coalesce(named, F.array().cast("array<struct<day:string,dep:string,arr:string>>"))


def block_minutes(day, dep_min, dep_tz, arr_min, arr_tz) -> Column:
    """Minutes from a local departure to a local arrival on a date, modulo a day."""
    utc = lambda m, tz: F.unix_timestamp(F.to_utc_timestamp(F.to_timestamp(col(day)) + F.make_dt_interval(mins=col(m)), col(tz)))
    return F.pmod(((utc(arr_min, arr_tz) - utc(dep_min, dep_tz)) / 60).cast("int"), F.lit(1440))


def own_slot(weekdays, day, dep_min) -> Column:
    """The weekday's own departure if the flight keeps one, else the pooled one."""
    return F.coalesce(F.try_element_at(col(weekdays), weekday(day))["dep"], col(dep_min))


def weekdays_apart(weekdays, dep_min, apart: int = 30) -> Column:
    """Weekday slots that a published departure has not absorbed; null if none is left."""
    kept = F.map_filter(col(weekdays), lambda k, v: circ_diff(v["dep"], col(dep_min)) > apart)
    return F.when(col(weekdays).isNull() | col(dep_min).isNull(), col(weekdays)).when(F.cardinality(kept) > 0, kept)


def cadence(days, window_days) -> Column:
    """How often a flight is seen, in words; empty where either figure is missing or zero."""
    d, w = col(days), col(window_days)
    per_week, per_month = d / (w / 7), d / (w / 30)
    words = lambda n, unit: F.concat(F.floor(n + 0.5).cast("string"), F.lit(unit))
    known = (F.coalesce(d, F.lit(0)) > 0) & (F.coalesce(w, F.lit(0)) > 0)
    return F.when(~known, "").when(per_week >= 6.5, "daily").when(per_week >= 1, words(per_week, "× a week")).when(per_month >= 1, words(per_month, "× a month")).otherwise("rarely")


def weekly_cadence(per_week) -> Column:
    """The same for a leg's flights a week."""
    w = col(per_week)
    daily = F.floor(w / 7 + 0.5)
    return F.when(F.coalesce(w, F.lit(0)) <= 0, "").when((w >= 6.5) & (daily > 1), F.concat(daily.cast("string"), F.lit("× daily"))).when(w >= 6.5, "daily").when(w >= 0.9, F.concat(F.floor(w + 0.5).cast("string"), F.lit("× a week"))).otherwise("occasional")
