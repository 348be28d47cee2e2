"""Column builders for ordered series.

Every window names its partition and order keys; a missing value is NULL, never NaN; a ratio with a zero
denominator is NULL, but for logarithms of price ranges (``float_div``, ``float_ln``), whose range from 0 is infinite.  ``least_rows`` is the number of non-null values below which a rolling value is NULL (all of the
frame by default).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY, ORDER = "symbol", "ts"


def C(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def series(key: str | list[str] = KEY, order: str = ORDER) -> WindowSpec:
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)


def frame(before: int, after: int = 0, key: str | list[str] = KEY, order: str = ORDER) -> WindowSpec:
    """Rows from ``before`` rows back to ``after`` rows ahead (negative: further back)."""
    return series(key, order).rowsBetween(-before, after)


def rolling(f: Callable[[Column], Column], x: str | Column, n: int, least_rows: int | None = None, key: str | list[str] = KEY, order: str = ORDER) -> Column:
    """f over the last n rows, where ``least_rows`` of them are not null."""
    w = frame(n - 1, 0, key, order)
    x = C(x)
    return F.when(F.count(x).over(w) >= (n if least_rows is None else least_rows), f(x).over(w))


def mean(x, n: int, least_rows: int | None = None, **kw) -> Column:
    return rolling(F.avg, x, n, least_rows, **kw)


def total(x, n: int, least_rows: int | None = None, **kw) -> Column:
    return rolling(F.sum, x, n, least_rows, **kw)


def std(x, n: int, least_rows: int | None = None, **kw) -> Column:
    return rolling(F.stddev_samp, x, n, least_rows, **kw)


def high(x, n: int, least_rows: int | None = None, **kw) -> Column:
    return rolling(F.max, x, n, least_rows, **kw)


def low(x, n: int, least_rows: int | None = None, **kw) -> Column:
    return rolling(F.min, x, n, least_rows, **kw)


def quantile(x, q: float, n: int, least_rows: int | None = None, **kw) -> Column:
    """Exact, linearly interpolated."""
    return rolling(lambda c: F.percentile(c, q), x, n, least_rows, **kw)


def corr(x, y, n: int, least_rows: int | None = None, key: str | list[str] = KEY, order: str = ORDER) -> Column:
    w, x, y = frame(n - 1, 0, key, order), C(x), C(y)
    both = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).over(w)
    return F.when(both >= (n if least_rows is None else least_rows), F.corr(x, y).over(w))


def cov(x, y, n: int, least_rows: int | None = None, key: str | list[str] = KEY, order: str = ORDER) -> Column:
    w, x, y = frame(n - 1, 0, key, order), C(x), C(y)
    both = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).over(w)
    return F.when(both >= (n if least_rows is None else least_rows), F.covar_samp(x, y).over(w))


def lag(x, k: int = 1, key: str | list[str] = KEY, order: str = ORDER) -> Column:
    return F.lag(C(x), k).over(series(key, order)) if k >= 0 else F.lead(C(x), -k).over(series(key, order))


def diff(x, k: int = 1, **kw) -> Column:
    return C(x) - lag(x, k, **kw)


def div(a, b) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(C(a), C(b))


def float_div(a, b) -> Column:
    """a / b as floating point has it (and SQL's plain division): an infinity, or NaN for 0 / 0, where b is 0; zeros have no sign."""
    return F.when(C(b) == 0, C(a) * float("inf")).otherwise(F.try_divide(C(a), C(b)))


def float_ln(x) -> Column:
    """Natural logarithm as floating point has it: minus infinity of 0, NaN of negative values."""
    x = C(x)
    return F.when(x > 0, F.ln(x)).when(x == 0, float("-inf")).when(x < 0, float("nan"))


def pct(x, k: int = 1, **kw) -> Column:
    return div(x, lag(x, k, **kw)) - 1


def log_return(x, **kw) -> Column:
    return F.ln(div(x, lag(x, 1, **kw)))


def clip(x, lo: float | None = None, hi: float | None = None) -> Column:
    """Bounds that keep NULL as NULL."""
    x = C(x)
    y = x
    if lo is not None:
        y = F.greatest(F.lit(float(lo)), y)
    if hi is not None:
        y = F.least(F.lit(float(hi)), y)
    return F.when(x.isNotNull(), y)


def ffill(x, key: str | list[str] = KEY, order: str = ORDER) -> Column:
    return F.last(C(x), ignorenulls=True).over(series(key, order).rowsBetween(Window.unboundedPreceding, 0))


def bfill(x, key: str | list[str] = KEY, order: str = ORDER) -> Column:
    return F.first(C(x), ignorenulls=True).over(series(key, order).rowsBetween(0, Window.unboundedFollowing))


def expanding_max(x, key: str | list[str] = KEY, order: str = ORDER) -> Column:
    return F.max(C(x)).over(series(key, order).rowsBetween(Window.unboundedPreceding, 0))


def cumulative(x, key: str | list[str] = KEY, order: str = ORDER) -> Column:
    return F.sum(C(x)).over(series(key, order).rowsBetween(Window.unboundedPreceding, 0))


def rank_pct(x, key: str | list[str] = KEY) -> Column:
    """Average rank of non-null values over their count."""
    x = C(x)
    keys = [key] if isinstance(key, str) else key
    below = F.rank().over(Window.partitionBy(*keys, x.isNull()).orderBy(x))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, x))
    return F.when(x.isNotNull(), (below + (ties - 1) / 2) / F.count(x).over(Window.partitionBy(*keys)))


def rolling_rank_pct(x, n: int, least_rows: int | None = None, key: str | list[str] = KEY, order: str = ORDER) -> Column:
    """Average rank of the current value among the last n."""
    x, w = C(x), frame(n - 1, 0, key, order)
    values = F.collect_list(x).over(w)
    rank = F.size(F.filter(values, lambda v: v < x)) + (F.size(F.filter(values, lambda v: v == x)) + 1) / 2
    return F.when(x.isNotNull() & (F.size(values) >= (n if least_rows is None else least_rows)), rank / F.size(values))


def qcut(x, edges: Column) -> Column:
    """Right-closed bin among inner edges; equal edges count once."""
    return F.when(C(x).isNotNull(), F.size(F.filter(F.array_distinct(edges), lambda e: e < C(x))))


def flag(condition: Column) -> Column:
    """1 or 0; NULL counts as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))
