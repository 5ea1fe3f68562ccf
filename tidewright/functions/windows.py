"""Column functions over windows that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: What orders rows of one ticker and time where a whole table is placed: prices, volume, the value of a series.
TIES = ("close", "high", "low", "open", "volume", "x")

#: In tables of ``series.held``: the hand that a ticker's rows are dealt to, and a row's number, which rises with time within a ticker.
HAND, AT = "__hand", "__at"

#: Rows of a sliding frame up to which its values are read one by one.
FEW = 32


def by_ticker(df: DataFrame | None = None, *values: str, ts: str = "bar_ts"):
    """A ticker's rows by time; those of one time by the values that the window reads, nulls first, so that what it gives is stated.

    No other column is read for it. Rows of chunks (``series.over_chunks``) go by their place, and
    so do those of a held table (``series.held``), which need no shuffle.
    """
    if df is not None and {"place", "own"} <= set(df.columns):
        return Window.partitionBy("ticker").orderBy("place")
    if df is not None and {HAND, AT} <= set(df.columns):
        return Window.partitionBy(HAND, "ticker").orderBy(AT)
    return Window.partitionBy("ticker").orderBy(ts, *values)


def full_mean(x: Column, n: int, w) -> Column:
    """Mean over the last n rows; null until n values are there."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, F.avg(x).over(frame))


def mean_and_deviation(df: DataFrame, x: str, n: int, w, mean: str = "mean", dev: str = "dev") -> DataFrame:
    """df with the mean and population deviation of x over the last n rows, by w's order; null until n values are there.

    A sliding frame updates its moments anew for each of its rows, a division every time. So a
    frame of up to FEW rows is read as lags, summed from the oldest on, and the deviation is
    taken from the mean in a second pass over them.
    """
    if n > FEW:
        frame = w.rowsBetween(-(n - 1), 0)
        return df.withColumns({c: F.when(F.count(x).over(frame) == n, f(x).over(frame)) for c, f in ((mean, F.avg), (dev, F.stddev_pop))})
    lags = [f"_{x}_{k}" for k in range(n - 1, -1, -1)]
    value = F.col(x).cast("double")
    seen = df.withColumns({c: F.lag(value, k).over(w) if k else value for c, k in zip(lags, range(n - 1, -1, -1), strict=True)})
    seen = seen.withColumn(mean, sum((F.col(c) for c in lags), F.lit(0.0)) / n)
    return seen.withColumn(dev, F.sqrt(sum(((F.col(c) - F.col(mean)) * (F.col(c) - F.col(mean)) for c in lags), F.lit(0.0)) / n)).drop(*lags)


def average_rank(x: Column, *partition: str, ascending: bool = False) -> Column:
    """Rank with ties at their mean; null for nulls. The first and last rank of ties come from one window: one sort serves both."""
    w = Window.partitionBy(*partition).orderBy(x.asc_nulls_last() if ascending else x.desc_nulls_last())
    # the frame by range ends with the last of the ties
    return F.when(x.isNotNull(), (F.rank().over(w) + F.count(F.lit(1)).over(w)) / 2.0)


def numbered(df: DataFrame, ts: str = "bar_ts", latest_first: bool = False) -> DataFrame:
    """(ts, i, n): the distinct times numbered from 0, and how many there are.

    Times are numbered by counts of the days before and then within the day, so the only window
    that spans everything runs over one row a day.
    """
    order = (lambda c: F.desc(c)) if latest_first else (lambda c: F.asc(c))
    times = df.select(ts).distinct().withColumn("_day", F.to_date(ts))
    days = times.groupBy("_day").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy(order("_day")))
    days = days.select("_day", (upto - F.col("_n")).alias("_before"), F.sum("_n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    within = F.row_number().over(Window.partitionBy("_day").orderBy(order(ts))) - 1
    return times.join(days, "_day").select(ts, (F.col("_before") + within).alias("i"), "n")
