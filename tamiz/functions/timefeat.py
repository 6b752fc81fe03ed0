"""Timestamps from text, and the ten temporal features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamiz.functions.text import cell

# Date shapes and, after them, what a time of day looks like. Hours may have one digit.
DATES = ((r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"), (r"\d{2}/\d{2}/\d{4}", "dd/MM/yyyy"), (r"\d{4}/\d{2}/\d{2}", "yyyy/MM/dd"))
SECONDS, MINUTES = r" \d{1,2}:\d{2}:\d{2}([.,]\d{1,9})?", r" \d{1,2}:\d{2}"
#: Names of the features, in vector order.
FEATURES = ("hour", "weekday", "month", "weekend", "business", "night", "hour_sin", "hour_cos", "weekday_sin", "weekday_cos")


def _at(v: Column, shape: str, layout: str) -> Column:
    """Wall clock of ``v`` if it has exactly this shape and exists, else null."""
    return F.when(v.rlike(f"^{shape}$"), F.try_to_timestamp(v, F.lit(layout)).cast("timestamp_ntz"))


def parse_stamp(c: Column) -> Column:
    """A timestamp (without zone) in one of ten layouts, or null. Values with an offset keep their local wall clock."""
    v = cell(c)
    tried = []
    for shape, layout in DATES:
        whole = F.regexp_replace(v, r"[.,]\d{1,9}$", "")
        fraction = F.rpad(F.regexp_extract(v, r"[.,](\d{1,9})$", 1), 6, "0").try_cast("int")
        base = F.when(v.rlike(f"^{shape}{SECONDS}$"), F.try_to_timestamp(whole, F.lit(f"{layout} H:mm:ss")))
        tried.append((base + F.make_dt_interval(secs=F.coalesce(fraction, F.lit(0)) / F.lit(1000000).cast("decimal(18,6)"))).cast("timestamp_ntz"))
        tried.append(_at(v, shape + MINUTES, f"{layout} H:mm"))
        tried.append(_at(v, shape, layout))
    zoned = r"^(\d{4}-\d{2}-\d{2})T(\d{1,2}:\d{2}:\d{2})([.,]\d{1,9})?(Z|[+-]\d{2}:\d{2})$"
    wall = F.regexp_replace(v, zoned, "$1 $2")
    tried.append(F.when(v.rlike(zoned), F.try_to_timestamp(wall, F.lit("yyyy-MM-dd H:mm:ss")).cast("timestamp_ntz")))
    return F.coalesce(*tried)


def parse_clock(c: Column) -> Column:
    """Seconds since midnight of ``H:M`` or ``H:M:S`` (parts after the third ignored), or null if any is out of range."""
    parts = F.split(cell(c), ":")
    part = lambda i: F.when(F.get(parts, F.lit(i)).rlike(r"^[ \t]*[+-]?\d{1,9}[ \t]*$"), F.trim(F.get(parts, F.lit(i))).try_cast("int"))
    h, m = part(0), part(1)
    s = F.when(F.size(parts) > 2, part(2)).otherwise(0)
    ok = h.between(0, 23) & m.between(0, 59) & s.between(0, 59)
    return F.when(ok, h * 3600 + m * 60 + s)


def stamp_or_day(stamp: Column, day: Column, clock: Column) -> Column:
    """The stamp if it parses, else the day with its clock, else the day alone, else null."""
    from tamiz.functions.cleaning import parse_day

    date = parse_day(day).cast("timestamp_ntz")
    seconds = F.coalesce(parse_clock(clock), F.lit(0))
    return F.coalesce(parse_stamp(stamp), date + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")))


def temporal_features(ts: Column) -> list[Column]:
    """Ten doubles; all 0 without a timestamp. Weeks start on Sunday (0)."""
    hour, week = F.hour(ts), F.dayofweek(ts) - 1
    weekend = week.isin(0, 6)
    turn = lambda x, n: F.lit(6.283185307179586) * x / n
    values = (
        hour / 23.0, week / 6.0, F.month(ts) / 12.0, weekend.cast("double"), (~weekend & (hour >= 8) & (hour < 18)).cast("double"), ((hour < 5) | (hour >= 22)).cast("double"),
        F.sin(turn(hour, 24.0)), F.cos(turn(hour, 24.0)), F.sin(turn(week, 7.0)), F.cos(turn(week, 7.0)),
    )
    return [F.coalesce(v, F.lit(0.0)).alias(n) for v, n in zip(values, FEATURES, strict=True)]
