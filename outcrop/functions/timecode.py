"""Clock strings, seconds and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOCK = r"^(?:(\d+):([0-5]\d)|(\d+)):([0-5]\d(?:\.\d{1,9})?)$"


def seconds(clock: Column) -> Column:
    """`MM:SS[.f]` (minutes may exceed 59) or `H:MM:SS[.f]` in seconds; null where it is neither."""
    part = lambda n: F.regexp_extract(clock, _CLOCK, n)
    hours = F.when(part(1) != "", part(1).cast("double") * 3600 + part(2).cast("double") * 60).otherwise(F.when(part(3) != "", part(3).cast("double") * 60))
    return F.when(clock.rlike(_CLOCK), hours + part(4).cast("double"))


def clock(value: Column) -> Column:
    """Whole seconds as `M:SS` or `H:MM:SS`."""
    s = F.floor(value).cast("bigint")
    h, m, r = (s / 3600).cast("bigint"), ((s % 3600) / 60).cast("bigint"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def timestamp(value: Column) -> Column:
    """`HH:MM:SS.mmm`."""
    ms = F.round(value * 1000).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", (ms / 3600000).cast("bigint"), ((ms % 3600000) / 60000).cast("bigint"), ((ms % 60000) / 1000).cast("bigint"), ms % 1000)


def date_terms(day: Column) -> Column:
    """The forms in which a date is searched."""
    return F.array(*[F.date_format(day, f) for f in ("yyyy-MM-dd", "d MMMM yyyy", "MMMM d yyyy", "d MMM yyyy")])


def duration(value: Column) -> Column:
    """`1 h 50 min`, `12 min`, `1 min 16 s` below ten minutes, `45 s`."""
    s = F.greatest(F.lit(0), F.floor(value + 0.5)).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"))
    with_rest = lambda a, b, ok: F.when(ok, F.concat(a, F.lit(" "), b)).otherwise(a)
    return F.when(h > 0, with_rest(text(h, "h"), text(m, "min"), m > 0)).when(m > 0, with_rest(text(m, "min"), text(r, "s"), (m < 10) & (r > 0))).otherwise(text(r, "s"))


def long_date(day: Column) -> Column:
    return F.date_format(day, "d MMMM yyyy")


def type_name(value: Column) -> Column:
    """`sermon_part` as `Sermon part`."""
    plain = F.regexp_replace(value, "[_-]+", " ")
    return F.concat(F.upper(F.left(plain, F.lit(1))), F.substring(plain, F.lit(2), F.length(plain)))
