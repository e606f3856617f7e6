"""Named aggregates, with the treatment of NaN, single values and empty input that matrix users expect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _nan() -> Column:
    return F.lit("NaN").cast("double")


def _spread(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Sample deviation or variance: NaN, not null, for a single value."""
    return lambda v: F.when(F.count(v) == 1, _nan()).otherwise(f(v))


def _extreme(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Minimum or maximum: NaN if any value is."""
    return lambda v: F.when(F.coalesce(F.bool_or(F.isnan(v)), F.lit(False)), _nan()).otherwise(f(v))


_PLAIN: dict[str, Callable[[Column], Column]] = {
    "sum": lambda v: F.coalesce(F.sum(v), F.lit(0.0)),
    "mean": F.avg,
    "median": F.median,
    "std": _spread(F.stddev_samp),
    "var": _spread(F.var_samp),
    "minimum": _extreme(F.min),
    "maximum": _extreme(F.max),
}
_SHORT = {"min": "minimum", "max": "maximum"}
_MODULES = ("base.", "statistics.")


def resolve(func: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The aggregate of a name, in any case and with or without its module; callables from Column to Column pass."""
    if callable(func):
        return func
    name = func.lower()
    if name in _SHORT:
        return _PLAIN[_SHORT[name]]
    for module in _MODULES:
        name = name.removeprefix(module)
    if name not in _PLAIN:
        raise ValueError(f"there is no aggregate named {func!r}")
    return _PLAIN[name]
