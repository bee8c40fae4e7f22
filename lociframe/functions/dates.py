"""Dates and times as Spark timestamps; text forms follow RFC 3339 in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._args import as_col

# fixed values: strftime letters and Spark's pattern letters
_PATTERN = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "j": "DDD", "I": "hh", "p": "a", "f": "SSSSSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss"}
_UNIT = {"days": "DAY", "hours": "HOUR", "minutes": "MINUTE", "seconds": "SECOND", "day": "DAY", "hour": "HOUR", "minute": "MINUTE", "second": "SECOND"}


def pattern(fmt: str) -> str:
    """Spark's pattern of a strftime format."""
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            out += "%" if fmt[i + 1] == "%" else _PATTERN[fmt[i + 1]]
            i += 2
        else:
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]
            i += 1
    return out


def now() -> Column:
    return F.current_timestamp()


def timestamp() -> Column:
    return F.unix_timestamp(F.current_timestamp())


def timestamp_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def date_format(d, fmt: str) -> Column:
    return F.date_format(as_col(d), pattern(fmt))


def date_parse(s, fmt: str) -> Column:
    return F.to_timestamp(as_col(s), pattern(fmt))


def date_add(d, n, unit: str) -> Column:
    return F.timestamp_add(_UNIT[unit], as_col(n), as_col(d).cast("timestamp"))


def date_diff(a, b, unit: str) -> Column:
    """a - b in whole units, towards zero."""
    return F.timestamp_diff(_UNIT[unit], as_col(b).cast("timestamp"), as_col(a).cast("timestamp"))


def year(d) -> Column:
    return F.year(as_col(d)).cast("long")


def month(d) -> Column:
    return F.month(as_col(d)).cast("long")


def day(d) -> Column:
    return F.dayofmonth(as_col(d)).cast("long")


def weekday(d) -> Column:
    return F.date_format(as_col(d), "EEEE")


def rfc3339(d) -> Column:
    return F.date_format(as_col(d), "yyyy-MM-dd'T'HH:mm:ssXXX")
