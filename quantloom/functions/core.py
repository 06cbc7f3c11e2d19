"""Column functions of the panel operators.

Missing is NULL everywhere: NaN becomes NULL when data are read, and every result that is not finite becomes NULL.
``dense`` windows run over all dates for each symbol, ``sparse`` ones over the rows that exist; which one it is depends
on the frame that the column is used on. Windows only ever look back; ``lead`` is left to labels.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

DATE, SYMBOL = "date", "symbol"


def across() -> WindowSpec:
    """All symbols of a date."""
    return Window.partitionBy(DATE)


def along() -> WindowSpec:
    """A symbol's rows by date."""
    return Window.partitionBy(SYMBOL).orderBy(DATE)


def last_rows(n: int) -> WindowSpec:
    """The current row and the n - 1 before it."""
    if n < 1:
        raise ValueError("a window needs one row at least")
    return along().rowsBetween(-(n - 1), 0)


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def both(x: Column, y: Column, value: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), value)


# across symbols


def rank(x: Column) -> Column:
    """Average-tie rank among the date's values, as a share of their number."""
    own = Window.partitionBy(DATE, x.isNull())
    ties = F.count(F.lit(1)).over(Window.partitionBy(DATE, x))
    place = F.rank().over(own.orderBy(x)).cast("double") + (ties - 1).cast("double") / F.lit(2.0)
    return F.when(x.isNotNull(), place / F.count(x).over(across()))


def zscore(x: Column) -> Column:
    return divide(x - F.avg(x).over(across()), F.stddev_samp(x).over(across()))


def scale(x: Column, a: float | Column = 1.0) -> Column:
    return divide(x, F.sum(F.abs(x)).over(across())) * (a if isinstance(a, Column) else F.lit(float(a)))


# along dates


def delay(x: Column, n: int) -> Column:
    return F.lag(x, n).over(along())


def delta(x: Column, n: int) -> Column:
    return x - delay(x, n)


def pct_change(x: Column, n: int = 1, fill: str = "none") -> Column:
    """Change against n rows ago; ``fill='pad'`` carries the last value over gaps first."""
    if fill == "pad":
        x = F.last(x, ignorenulls=True).over(along().rowsBetween(Window.unboundedPreceding, 0))
    return divide(x, delay(x, n)) - 1


def rolling(x: Column, n: int, how: str, min_periods: int) -> Column:
    """mean, std (ddof 1), sum, max or min of the last n rows, NULL with fewer than ``min_periods`` values."""
    agg = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "max": F.max, "min": F.min}[how]
    return F.when(F.count(x).over(last_rows(n)) >= min_periods, agg(x).over(last_rows(n)))


def ts_mean(x: Column, n: int) -> Column:
    return rolling(x, n, "mean", 1)


def ts_std(x: Column, n: int) -> Column:
    return rolling(x, n, "std", 2)


def ts_max(x: Column, n: int) -> Column:
    return rolling(x, n, "max", 1)


def ts_min(x: Column, n: int) -> Column:
    return rolling(x, n, "min", 1)


def ts_sum(x: Column, n: int) -> Column:
    return rolling(x, n, "sum", 1)


def ts_zscore(x: Column, n: int) -> Column:
    return divide(x - ts_mean(x, n), ts_std(x, n))


def ts_rank(x: Column, n: int) -> Column:
    """Average-tie share of the current value among the window's values."""
    values = F.collect_list(x).over(last_rows(n))
    below = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.when(v < x, 1.0).when(v == x, 0.5).otherwise(0.0))
    return F.when(x.isNotNull() & (F.size(values) >= max(1, n // 2)), (below + 0.5) / F.size(values))


def _ts_arg(x: Column, n: int, place: Column, largest: bool) -> Column:
    window = last_rows(n)
    gap = F.min(F.when(x.isNull(), place)).over(window)
    # min_by and max_by don't skip a NULL inside a struct, so rows without a value are masked as a whole
    best = (F.max_by(place, F.when(x.isNotNull(), F.struct(x, -place))) if largest else F.min_by(place, F.when(x.isNotNull(), F.struct(x, place)))).over(window)
    return F.when(F.count(x).over(window) > 0, (place - F.coalesce(gap, best)).cast("double"))


def ts_argmax(x: Column, n: int, place: Column) -> Column:
    """Rows since the window's first largest value, or since its first missing one. ``place``: the row's number."""
    return _ts_arg(x, n, place, True)


def ts_argmin(x: Column, n: int, place: Column) -> Column:
    return _ts_arg(x, n, place, False)


def row_place() -> Column:
    return F.row_number().over(along())


def decay_linear(x: Column, n: int) -> Column:
    """Mean of the last n values with weights n, ..., 1 from the newest; NULL if one is missing."""
    total = x * float(n)
    for k in range(1, n):
        total = total + delay(x, k) * float(n - k)
    return total / (n * (n + 1) / 2)


# pairs


def covariance(x: Column, y: Column, n: int, min_periods: int = 2) -> Column:
    a, b = both(x, y, x), both(x, y, y)
    return F.when(F.count(a).over(last_rows(n)) >= max(2, min_periods), F.covar_samp(a, b).over(last_rows(n)))


def correlation(x: Column, y: Column, n: int, min_periods: int = 2) -> Column:
    a, b = both(x, y, x), both(x, y, y)
    spread = F.stddev_samp(a).over(last_rows(n)) * F.stddev_samp(b).over(last_rows(n))
    return F.when(F.count(a).over(last_rows(n)) >= max(2, min_periods), F.try_divide(F.covar_samp(a, b).over(last_rows(n)), F.when(spread > TINY, spread)))


#: Below this a product of standard deviations counts as zero.
TINY = 1e-12
#: Windows of this many rows or more take differences of running sums, whose cost doesn't grow with the window.
LONG = 30
#: A variance below this share of the mean square so far is what differences of sums leave of a constant.
CANCELLED = 1e-11


def centred(x: Column, y: Column) -> tuple[Column, Column]:
    """Both of a pair less their first values of the symbol, which keeps running sums small; nothing ahead is used."""
    past = along().rowsBetween(Window.unboundedPreceding, 0)
    a, b = both(x, y, x), both(x, y, y)
    return a - F.first(a, ignorenulls=True).over(past), b - F.first(b, ignorenulls=True).over(past)


def _recent(x: Column, n: int) -> Column:
    """Sum of the last n rows as the difference of two running sums."""
    upto = lambda k: along().rowsBetween(Window.unboundedPreceding, k)
    return F.coalesce(F.sum(x).over(upto(0)), F.lit(0.0)) - F.coalesce(F.sum(x).over(upto(-n)), F.lit(0.0))


def long_moments(a: Column, b: Column, n: int, min_periods: int, *, correlation: bool) -> Column:
    """Rolling covariance or correlation of a ``centred`` pair."""
    past = along().rowsBetween(Window.unboundedPreceding, 0)
    count = _recent(F.when(a.isNotNull(), 1.0), n)
    mean_a, mean_b = _recent(a, n) / count, _recent(b, n) / count
    together = _recent(a * b, n) - count * mean_a * mean_b
    enough = count >= max(2, min_periods)
    if not correlation:
        return F.when(enough, together / (count - 1))

    def spread(x: Column, mean: Column) -> Column:
        squares = _recent(x * x, n) - count * mean * mean
        return F.when(squares > CANCELLED * count * F.avg(x * x).over(past), squares)

    size = F.sqrt(spread(a, mean_a)) * F.sqrt(spread(b, mean_b))
    return F.when(enough, F.try_divide(together, F.when(size > TINY * (count - 1), size)))


# element by element


def sign(x: Column) -> Column:
    return F.signum(x)


def log(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def power(x: Column, n: Column) -> Column:
    return finite(F.pow(x, n))


def signed_power(x: Column, n: Column) -> Column:
    return finite(F.signum(x) * F.pow(F.abs(x), n))


def least(x: Column, y: Column) -> Column:
    return both(x, y, F.least(x, y))


def greatest(x: Column, y: Column) -> Column:
    return both(x, y, F.greatest(x, y))


def clip(x: Column, lower: Column, upper: Column) -> Column:
    return least(greatest(x, lower), upper)


def corr_of(x: Column, y: Column) -> Column:
    """Aggregate Pearson correlation of pairs without a NULL; NULL if either side doesn't vary."""
    a, b = both(x, y, x), both(x, y, y)
    spread = F.stddev_samp(a) * F.stddev_samp(b)
    return F.try_divide(F.covar_samp(a, b), F.when(spread > TINY, spread))
