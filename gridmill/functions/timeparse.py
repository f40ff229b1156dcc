"""Market time as column expressions: parsing, hour endings, the target and issue axes, day and month arithmetic.

Three rules turn an hour ending (1 to 24) into a time. ``he_begin`` is the hour's beginning and the
rule for analysis; ``he_sort`` is the hour itself, 24 being 23:59, and only orders rows; ``he_wrap``
takes 24 for 0 of the same day and exists to reproduce old plots. All times are TIMESTAMP_NTZ; a text
that carries an offset is converted to UTC. Nothing raises on bad text: it becomes null.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Column names that hold times, as fixed values in order of preference.
TIMESTAMP_NAMES = ["scedtimestamp", "scedtimestamputc", "deliveryinterval", "intervalending", "intervalend", "intervaltime", "datetime", "timestamp", "postingtime", "postdatetime", "hourendingdatetime", "deliverydatetime"]
TIMESTAMP_PAIRS = [("deliverydate", "hourending"), ("delivery_date", "hour_ending"), ("operday", "hourending"), ("deliverydate", "deliveryhour")]
TARGET_NAMES = ["deliveryinterval", "intervalending", "intervalend", "intervaltime", "hourendingdatetime", "deliverydatetime", "scedtimestamp", "scedtimestamputc", "datetime", "timestamp"]
TARGET_PAIRS = [("deliverydate", "hourending"), ("delivery_date", "hour_ending"), ("deliverydate", "deliveryhour"), ("operday", "hourending"), ("operatingday", "hourending"), ("marketday", "hourending"), ("date", "hourending")]
ISSUE_NAMES = ["postingtime", "postdatetime", "publishdatetime", "issuetime", "issue_datetime", "forecastissuedatetime", "createdatetime", "createdat"]
ISSUE_DATES = ["postingdate", "publishdate", "issuedate", "issue_date"]
TARGET_HINTS = ["deliveryinterval", "intervalending", "intervalend", "intervaltime", "hourendingdatetime", "deliverydatetime", "deliverydate", "delivery_date", "operday", "operatingday", "marketday", "hourending", "hour_ending", "deliveryhour"]

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"


def _text(c: Column | str) -> Column:
    return F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))


def _ntz(c: Column, pattern: str) -> Column:
    return F.try_to_timestamp(c, F.lit(pattern)).cast("timestamp_ntz")


def parse_iso(c: Column | str) -> Column:
    """ISO time, with ``Z`` or an offset converted to UTC; null if it isn't one."""
    t = _text(c)
    return F.when(t.rlike(_ISO), F.try_to_timestamp(F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(Z|[+-].*)?$", "$1:00$2"))).cast("timestamp_ntz")


def _two_digit_year(t: Column) -> Column:
    """m/d/yy, of which 69 to 99 are in the 1900s."""
    year = F.regexp_extract(t, r"/(\d{2})$", 1)
    full = F.concat(F.regexp_extract(t, r"^(\d{1,2}/\d{1,2}/)\d{2}$", 1), F.when(year >= "69", "19").otherwise("20"), year)
    return F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), _ntz(full, "M/d/yyyy"))


def parse_date(c: Column | str) -> Column:
    """Y-m-d, m/d/Y, m/d/y, else ISO; the time of day is kept where ISO has one."""
    t = _text(c)
    return F.coalesce(
        F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), _ntz(t, "yyyy-M-d")),
        F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), _ntz(t, "M/d/yyyy")),
        _two_digit_year(t),
        parse_iso(t),
    )


def parse_sort_date(c: Column | str) -> Column:
    """The date of m/d/Y, Y-m-d, m/d/y, else the UTC date of ISO: the order in which sort keys are read."""
    t = _text(c)
    return F.coalesce(
        F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), _ntz(t, "M/d/yyyy")),
        F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), _ntz(t, "yyyy-M-d")),
        _two_digit_year(t),
        parse_iso(t),
    ).cast("date")


def infer_time(c: Column | str) -> Column:
    """A time in whichever of the known forms a text has: with a time of day, else a date, also Y/m/d and Ymd; null for others."""
    t = _text(c)
    return F.coalesce(
        parse_datetime(t),
        parse_date(t),
        F.when(t.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), _ntz(t, "yyyy/M/d")),
        F.when(t.rlike(r"^\d{8}$"), _ntz(t, "yyyyMMdd")),
    )


def parse_day(c: Column | str) -> Column:
    """The date of a text that may go on with a time: cut at ``T`` or a space; also Y/m/d."""
    t = F.split(_text(c), "[T ]")[0]
    return F.coalesce(parse_date(t), F.when(t.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), _ntz(t, "yyyy/M/d"))).cast("date")


def parse_datetime(c: Column | str) -> Column:
    """A time with a colon in it: Y-m-d or m/d/Y, a space or T, H:M or H:M:S; else ISO."""
    t = _text(c)
    formats = [(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"), (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$", "yyyy-M-d H:m"), (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "M/d/yyyy H:m:s"), (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$", "M/d/yyyy H:m"), (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d'T'H:m:s"), (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}$", "yyyy-M-d'T'H:m")]
    return F.when(t.contains(":"), F.coalesce(*[F.when(t.rlike(shape), _ntz(t, f)) for shape, f in formats], parse_iso(t)))


def parse_hour_ending(c: Column | str) -> Column:
    """Digits before the first colon, 0 to 24; null otherwise."""
    digits = F.regexp_replace(F.split(_text(c), ":")[0], r"\D", "")
    hour = digits.try_cast("int")
    return F.when(hour.between(0, 24), hour)


def parse_hour_number(c: Column | str) -> Column:
    """Text before the first colon as a number, null if it isn't one."""
    return F.trim(F.split(_text(c), ":")[0]).try_cast("double")


def he_begin(day: Column, hour: Column) -> Column:
    """Beginning of an hour-ending hour: 1 is 00:00, 24 is 23:00."""
    return (day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour.cast("int") - 1)).cast("timestamp_ntz")


def he_sort(day: Column, hour: Column) -> Column:
    """The hour itself, for ordering: 24 is 23:59."""
    start = F.date_trunc("day", day).cast("timestamp_ntz")
    return F.when(hour == 24, start + F.make_dt_interval(F.lit(0), F.lit(23), F.lit(59))).otherwise(start + F.make_dt_interval(F.lit(0), hour.cast("int")))


def he_wrap(day: Column, hour: Column) -> Column:
    """24 taken for 0 of the same day."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour.cast("int") % 24)


def interval_begin(day: Column, hour: Column, interval: Column) -> Column:
    """Beginning of quarter 1 to 4 of delivery hour 1 to 24."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour.cast("int") - 1, (interval.cast("int") - 1) * 15)


def posting_day(ts: Column) -> Column:
    """Day-ahead results carry the day before delivery."""
    return ts - F.expr("interval 1 day")


def first_of(names: Iterable[str], have: dict[str, str], parse) -> list[Column]:
    return [parse(F.col(f"`{have[n]}`")) for n in names if n in have]


def _pairs(pairs: list[tuple[str, str]], have: dict[str, str]) -> list[Column]:
    return [he_sort(parse_date(F.col(f"`{have[d]}`")), parse_hour_ending(F.col(f"`{have[h]}`"))) for d, h in pairs if d in have and h in have]


def _coalesced(found: list[Column]) -> Column:
    return F.coalesce(*found) if found else F.lit(None).cast("timestamp_ntz")


def lower_names(columns: list[str]) -> dict[str, str]:
    return {c.strip().lower(): c for c in columns}


def any_time(columns: list[str]) -> Column:
    """The first time that any of a row's columns gives."""
    have = lower_names(columns)
    return _coalesced(first_of([*TIMESTAMP_NAMES, "hour_ending"], have, parse_datetime) + _pairs(TIMESTAMP_PAIRS, have))


def target_time(columns: list[str]) -> Column:
    """The time a row is about."""
    have = lower_names(columns)
    return _coalesced(first_of(TARGET_NAMES, have, parse_datetime) + _pairs(TARGET_PAIRS, have))


def issue_time(columns: list[str]) -> Column:
    """The time a row was posted."""
    have = lower_names(columns)
    return _coalesced(first_of(ISSUE_NAMES, have, parse_datetime) + first_of(ISSUE_DATES, have, parse_date))


def inclusive_days(a: Column, b: Column) -> Column:
    return F.greatest(F.datediff(b, a) + 1, F.lit(0))


def inclusive_months(a: Column, b: Column) -> Column:
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) + 1


def days_in_month(d: Column) -> Column:
    return F.dayofmonth(F.last_day(d))


def day_bounds(d: Column) -> tuple[Column, Column]:
    """First and last second of a day, as ISO text."""
    return F.date_format(d, "yyyy-MM-dd'T'00:00:00"), F.date_format(d, "yyyy-MM-dd'T'23:59:59")


def month_of_path(path: Column | str) -> Column:
    """First day of the month that a monthly file's path names: .../YYYY/MM/<id>_YYYYMM.csv"""
    p = F.col(path) if isinstance(path, str) else path
    return F.try_to_timestamp(F.regexp_extract(p, r"_(\d{6})\.csv$", 1), F.lit("yyyyMM")).cast("date")
