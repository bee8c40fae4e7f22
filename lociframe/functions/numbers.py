"""Number functions with the usual floating-point results where Spark gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._args import as_col

_NAN, _LOW = float("nan"), float("-inf")


def _d(x) -> Column:
    return as_col(x).cast("double")


def abs_(x) -> Column:
    return F.abs(as_col(x))


def sqrt(x) -> Column:
    return F.sqrt(_d(x))


def pow_(x, y) -> Column:
    return F.pow(_d(x), _d(y))


def _log(x, fn) -> Column:
    x = _d(x)
    return F.when(x > 0, fn(x)).when(x == 0, F.lit(_LOW)).when(x.isNull(), F.lit(None)).otherwise(F.lit(_NAN))


def log(x) -> Column:
    return _log(x, F.ln)


def log2(x) -> Column:
    return _log(x, F.log2)


def log10(x) -> Column:
    return _log(x, F.log10)


def exp(x) -> Column:
    return F.exp(_d(x))


def ceil(x) -> Column:
    return F.ceil(as_col(x))


def floor(x) -> Column:
    return F.floor(as_col(x))


def round_(x, digits: int | None = None) -> Column:
    """Half away from zero; whole numbers without digits."""
    return F.round(as_col(x), 0).cast("long") if digits is None else F.round(_d(x), digits)


def sign(x, whole: bool = False) -> Column:
    x = as_col(x)
    return F.signum(x).cast("long") if whole else F.when(x.isNull(), F.lit(None)).otherwise(F.when(x >= 0, 1.0).otherwise(-1.0))


def clamp(x, low, high) -> Column:
    return F.least(F.greatest(as_col(x), as_col(low)), as_col(high))


def sin(x) -> Column:
    return F.sin(_d(x))


def cos(x) -> Column:
    return F.cos(_d(x))


def tan(x) -> Column:
    return F.tan(_d(x))


def asin(x) -> Column:
    return F.asin(_d(x))


def acos(x) -> Column:
    return F.acos(_d(x))


def atan(x) -> Column:
    return F.atan(_d(x))


def atan2(y, x) -> Column:
    return F.atan2(_d(y), _d(x))


def is_nan(x) -> Column:
    return F.isnan(_d(x))


def is_finite(x) -> Column:
    x = _d(x)
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def pi() -> Column:
    return F.pi()


def euler() -> Column:
    return F.e()


def random(seed: int | None = None) -> Column:
    return F.rand(seed)


def random_int(low: int, high: int, seed: int | None = None) -> Column:
    """A whole number from low to high, both included."""
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("long")


def bp(x) -> Column:
    return as_col(x)


def kb(x) -> Column:
    return as_col(x) * 1_000


def mb(x) -> Column:
    return as_col(x) * 1_000_000


def gb(x) -> Column:
    return as_col(x) * 1_000_000_000


def to_int(x) -> Column:
    """Cuts towards zero; a bad string is an error under ANSI rules."""
    return as_col(x).cast("long")


def to_float(x) -> Column:
    return _d(x)


def to_bool(x, kind: str = "number") -> Column:
    """Truth of a value: null, false, 0, the empty string and the empty array are false."""
    x = as_col(x)
    test = {"number": x != 0, "string": x != "", "array": F.size(x) > 0}[kind] if kind != "boolean" else x
    return F.coalesce(test, F.lit(False))


def is_positive(x) -> Column:
    return F.coalesce(as_col(x) > 0, F.lit(False))
