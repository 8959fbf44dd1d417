"""Row-local expressions shared by the operators. All stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_nan(c: Column) -> Column:
    """NaN and infinities become NULL."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def clip(c: Column, low: float | None, high: float | None) -> Column:
    """Limit to [low, high]; NULL stays NULL."""
    out = c.cast("double")
    if low is not None:
        out = F.when(c < F.lit(low), F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(c > F.lit(high), F.lit(high)).otherwise(out)
    return out


def ratio(a: Column, b: Column) -> Column:
    """a / b with NULL for a zero denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def smooth_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double") + F.lit(1e-5))


def log_clipped(c: Column) -> Column:
    """log(1 + x) with negatives taken as 0; NULL stays NULL."""
    return F.log1p(clip(c, 0.0, None))


def shifted(c: Column, minimum: float | None) -> Column:
    """x minus the minimum when the minimum is negative."""
    if minimum is not None and minimum < 0:
        return c.cast("double") - F.lit(float(minimum))
    return c.cast("double")


def bin_code(c: Column, edges: list[float]) -> Column:
    """Zero-based code of right-closed bins whose first bin includes its lower edge.

    A value outside the edges is NULL, as for rows unseen when the edges were fitted.
    """
    if len(edges) < 2:
        return F.lit(None).cast("int")
    code = F.lit(0)
    for edge in edges[1:-1]:
        code = code + (c > F.lit(edge)).cast("int")
    return F.when((c >= F.lit(edges[0])) & (c <= F.lit(edges[-1])), code)


def bin_label(code: Column, edges: list[float]) -> Column:
    """Interval text of a bin code."""
    out = F.lit(None).cast("string")
    for i in range(len(edges) - 1):
        out = F.when(code == i, F.lit(f"({edges[i]:.6g}, {edges[i + 1]:.6g}]")).otherwise(out)
    return out


def date_part(ts: Column, part: str) -> Column:
    parts = {
        "year": lambda: F.year(ts),
        "month": lambda: F.month(ts),
        "day": lambda: F.dayofmonth(ts),
        "dayofweek": lambda: F.weekday(ts),
        "is_weekend": lambda: F.coalesce((F.weekday(ts) >= 5).cast("int"), F.lit(0)),
        "quarter": lambda: F.quarter(ts),
        "hour": lambda: F.hour(ts),
    }
    if part not in parts:
        raise ValueError(f"unknown date part '{part}'; one of {sorted(parts)}")
    return parts[part]()


def text_length(c: Column) -> Column:
    return F.coalesce(F.length(c.cast("string")), F.lit(0))


# The whitespace of Python's str.split() other than a blank.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def word_count(c: Column) -> Column:
    """Number of whitespace-separated words; empty or NULL text has none."""
    blanks = F.translate(c.cast("string"), SPACES, " " * len(SPACES))
    return F.coalesce(F.size(F.array_remove(F.split(blanks, " "), "")), F.lit(0))


def adjusted_skew(c: Column) -> Column:
    """Bias-adjusted skewness as an aggregate: NULL under 3 values, 0 for a constant."""
    x = c.cast("double")
    n = F.count(x).cast("double")
    g1 = F.when(F.min(x) < F.max(x), F.skewness(x)).otherwise(F.lit(0.0))
    return F.when(F.count(x) > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def order_hash(key: Column, seed: int) -> Column:
    """Reproducible pseudo-random order of rows by an explicit key."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))
