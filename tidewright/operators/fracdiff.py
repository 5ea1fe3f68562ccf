"""Fractional differencing and the search for the least order that makes a series stationary.

Series are (ticker, bar_ts, x). A whole search is one job, parallel over tickers: a ticker's values
come to one task as a vector, every order is one convolution, and its unit-root test is sums of
squares. The test of given series is aggregates alone.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions import series as split
from tidewright.functions.windows import by_ticker
from tidewright.sources.folders import stored

#: Up to so many weights are lags of a window; more are a convolution.
EXPRESSED = 64
#: The cubic fit of the p-value of a unit-root statistic (one series, constant), after MacKinnon (1994).
SMALL_P, LARGE_P = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
SPLIT, TOP, BOTTOM = -1.61, 2.74, -18.83
MIN_VALUES = 50


def weights(d: float, threshold: float = 0.001, max_lags: int = 1000) -> list[float]:
    """w0 = 1, wk = -w(k-1) (d-k+1)/k, up to the first under threshold."""
    w, k = [1.0], 1
    while k < max_lags:
        nxt = -w[-1] * (d - k + 1) / k
        if abs(nxt) < threshold:
            break
        w.append(nxt)
        k += 1
    return w


def ffd_weights(orders: DataFrame, threshold: float = 0.001, max_lags: int = 1000) -> DataFrame:
    """(d, k, w) for each distinct d of orders: the recursion runs as an array fold in the JVM."""
    start = F.struct(F.array(F.lit(1.0)).alias("w"), F.lit(False).alias("done"))

    def step(acc: Column, k: Column) -> Column:
        nxt = -F.element_at(acc["w"], -1) * (F.col("d") - k + 1) / k
        stop = acc["done"] | (F.abs(nxt) < threshold)
        return F.struct(F.when(stop, acc["w"]).otherwise(F.concat(acc["w"], F.array(nxt))).alias("w"), stop.alias("done"))

    fold = F.aggregate(F.sequence(F.lit(1), F.lit(max_lags - 1)), start, step)["w"]
    return orders.select(F.col("d").cast("double").alias("d")).distinct().select("d", F.posexplode(fold).alias("k", "w"))


def frac_diff(series: DataFrame, d: float, threshold: float = 0.001, col: str = "x", max_lags: int = 1000, chunk: int = split.CHUNK) -> DataFrame:
    """Adds x_frac_diff: null for the first K-1 rows of a ticker and wherever a lag is null; all rows stay.

    Few weights are a window expression. Many are a convolution of a ticker's vector, or of
    chunks with K-1 rows of halo where a series is longer than chunk. Rows of one time are
    ordered by the value and come to the same result whichever way it is computed.
    """
    w, name = weights(d, threshold, max_lags), f"{col}_frac_diff"
    if len(w) <= EXPRESSED:
        order = by_ticker(series, col)
        terms = [F.lit(wk) * (F.lag(col, k).over(order) if k else F.col(col)) for k, wk in enumerate(w)]
        return series.withColumn(name, reduce(add, terms))
    halo, table = len(w) - 1, np.array(w)
    rows = series.select("ticker", "bar_ts", F.col(col).cast("double").alias("x"), F.struct(*[series[f"`{c}`"] for c in series.columns]).alias("row"))
    schema = T.StructType([rows.schema["row"], T.StructField("y", T.DoubleType())])

    def run(t: pa.Table) -> pa.Table:
        by = ["place"] if "place" in t.column_names else ["bar_ts", "x"]
        t = t.sort_by([(c, "ascending") for c in by], null_placement="at_start")
        x = t.column("x").to_numpy().astype(float)
        y = np.concatenate([np.full(min(halo, len(x)), np.nan), _differenced(x, table)])
        out = pa.table({"row": t.column("row"), "y": pa.array(y, mask=np.isnan(y))})
        return out.filter(t.column("own")) if "own" in t.column_names else out

    rows = stored(rows, "series")
    if split.longest(rows) <= chunk:
        found = rows.groupBy("ticker").applyInArrow(run, schema)
    else:
        cut = split.chunked(split.places(rows, "ticker", ["bar_ts", "x"]), max(chunk, halo), halo)
        found = cut.groupBy("ticker", "chunk").applyInArrow(run, schema)
    return found.select("row.*", F.col("y").alias(name))


def _differenced(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of w_k times the value k rows before, full frames only; x is NaN where it is null.

    Many weights: overlap-save. Blocks that overlap by a frame less one are multiplied by the
    weights in frequencies, and what wraps around is left out. Values are taken relative to their
    block's mean, whose part is added back exactly, so that a far level costs no digits. NaN
    stays where it reaches.
    """
    k = len(w)
    if len(x) < k:
        return np.zeros(0)
    if k <= EXPRESSED:
        return np.convolve(x, w, "valid")
    size = 1 << max(4 * k - 1, 1023).bit_length()
    step, n_out = size - k + 1, len(x) - k + 1
    known = np.isfinite(x)
    padded = np.pad(np.where(known, x, 0.0), (0, -n_out % step))
    blocks = np.lib.stride_tricks.sliding_window_view(padded, size)[::step]
    mean = blocks.mean(axis=1, keepdims=True)
    y = np.fft.irfft(np.fft.rfft(blocks - mean, axis=1) * np.fft.rfft(w, size), size, axis=1)[:, k - 1 :] + mean * w.sum()
    y = y.ravel()[:n_out]
    if not known.all():
        gaps = np.concatenate([[0], np.cumsum(~known)])
        y[gaps[k:] > gaps[:-k]] = np.nan
    return y


def _vector(table: pa.Table) -> np.ndarray:
    return table.sort_by([("bar_ts", "ascending"), ("x", "ascending")]).column("x").to_numpy().astype(float)


def grid_series(series: DataFrame, orders: list[float], threshold: float = 0.001, max_lags: int = 1000) -> DataFrame:
    """(ticker, bar_ts, d, x): the series under each order, rows with a full frame and without a null in it only."""
    table = {d: np.array(weights(d, threshold, max_lags)) for d in orders}

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("bar_ts", "ascending"), ("x", "ascending")])
        x, out = t.column("x").to_numpy().astype(float), []
        for d, w in table.items():
            y = _differenced(x, w)
            keep = ~np.isnan(y)
            cut = t.slice(t.num_rows - len(y)).filter(pa.array(keep))
            out.append(pa.table({"ticker": cut.column("ticker"), "bar_ts": cut.column("bar_ts"), "d": pa.array(np.full(int(keep.sum()), d)), "x": pa.array(y[keep])}))
        return pa.concat_tables(out)

    rows = series.select("ticker", "bar_ts", F.col("x").cast("double").alias("x"))
    return rows.groupBy("ticker").applyInArrow(run, "ticker string, bar_ts timestamp_ntz, d double, x double")


def adf_test(series: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, lag, stat): unit-root statistic with constant and at most one lag, by aggregates alone.

    Lag 0 and 1 are fitted on the common rows; the smaller AIC wins, a tie goes to lag 0, which is
    refitted on one row more. Null where a fit has no degrees of freedom or no variance.
    """
    keys = keys or ("ticker",)
    w = Window.partitionBy(*keys).orderBy("bar_ts")
    x1, x2 = F.lag("x", 1).over(w), F.lag("x", 2).over(w)
    mean = F.avg("x").over(Window.partitionBy(*keys))  # centred first, to keep precision
    rows = series.select(*keys, (F.col("x") - x1).alias("y"), (x1 - mean).alias("l"), (x1 - x2).alias("z")).where("y IS NOT NULL")
    has = F.col("z").isNotNull()
    on = lambda c: F.when(has, F.col(c))
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("m"), F.count("z").alias("n"),
        F.regr_sxx("y", "l").alias("ll_all"), F.regr_sxy("y", "l").alias("ly_all"), F.regr_syy("y", "l").alias("yy_all"),
        F.regr_sxx(on("y"), on("l")).alias("ll"), F.regr_sxy(on("y"), on("l")).alias("ly"), F.regr_syy(on("y"), on("l")).alias("yy"),
        F.regr_sxx("y", "z").alias("zz"), F.regr_sxy("y", "z").alias("zy"), F.regr_sxy("l", "z").alias("lz"),
    )
    c = F.col
    div, positive = F.try_divide, lambda x: F.when(x > 0, x)
    sums = sums.withColumn("det", positive(c("ll") * c("zz") - c("lz") * c("lz")))
    sums = sums.withColumn("b", div(c("zz") * c("ly") - c("lz") * c("zy"), c("det"))).withColumn("g", div(c("ll") * c("zy") - c("lz") * c("ly"), c("det")))
    sums = sums.withColumn("ssr1", positive(c("yy") - c("b") * c("ly") - c("g") * c("zy"))).withColumn("ssr0", positive(c("yy") - div(c("ly") * c("ly"), c("ll"))))
    one = c("n") * F.ln(c("ssr1") / c("n")) + 6 < c("n") * F.ln(c("ssr0") / c("n")) + 4
    sums = sums.withColumn("lag", F.when(F.coalesce(one, F.lit(False)), 1).otherwise(0))
    all_ssr = positive(c("yy_all") - div(c("ly_all") * c("ly_all"), c("ll_all")))
    stat0 = div(div(c("ly_all"), c("ll_all")), F.sqrt(div(div(all_ssr, positive(c("m") - 2)), c("ll_all"))))
    stat1 = div(c("b"), F.sqrt(div(c("ssr1"), positive(c("n") - 3)) * c("zz") / c("det")))
    return sums.select(*keys, (c("m") + 1).alias("n"), "lag", F.when(c("lag") == 1, stat1).otherwise(stat0).alias("stat"))


def p_of(stat: float) -> float:
    """P-value of a statistic."""
    if math.isnan(stat):
        return math.nan
    if stat > TOP or stat < BOTTOM:
        return 1.0 if stat > TOP else 0.0
    poly = sum(c * stat**k for k, c in enumerate(SMALL_P if stat <= SPLIT else LARGE_P))
    return math.erfc(-poly / math.sqrt(2)) / 2


def critical(significance: float = 0.05) -> float:
    """The statistic whose p-value is significance: p rises with the statistic, so it is found by halving."""
    lo, hi = BOTTOM, TOP
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if p_of(mid) < significance else (lo, mid)
    return lo


def with_p(tests: DataFrame, significance: float = 0.05) -> DataFrame:
    """Adds p_value and is_stationary. Spark has no error function, so Python gives p on the result rows alone."""

    @F.pandas_udf("double")
    def p(s: pd.Series) -> pd.Series:
        return s.map(p_of)

    out = tests.withColumn("p_value", F.when(F.col("stat").isNotNull(), p(F.coalesce("stat", F.lit(0.0)))))
    return out.withColumn("is_stationary", F.coalesce(F.col("p_value") < significance, F.lit(False)))


def _statistic(x: np.ndarray) -> float:
    """The statistic of ``adf_test`` for one vector; NaN where there is none."""
    if len(x) < 5 or not np.isfinite(x).all():
        return math.nan
    centred = lambda v: v - v.mean()
    y0, l0 = np.diff(x), x[:-1] - x[:-1].mean()
    y, l, z = centred(y0[1:]), centred(l0[1:]), centred(y0[:-1])
    ll, ly, yy, zz, zy, lz = l @ l, l @ y, y @ y, z @ z, z @ y, l @ z
    n, det = len(y), ll * zz - lz * lz
    if det > 0 and ll > 0:
        b, g = (zz * ly - lz * zy) / det, (ll * zy - lz * ly) / det
        one, none = yy - b * ly - g * zy, yy - ly * ly / ll
        if one > 0 and none > 0 and n * math.log(one / n) + 6 < n * math.log(none / n) + 4:
            return b / math.sqrt(one / (n - 3) * zz / det) if n > 3 else math.nan
    y0, l0 = centred(y0), centred(l0)
    ll, ly = l0 @ l0, l0 @ y0
    ssr = y0 @ y0 - ly * ly / ll if ll > 0 else 0.0
    return ly / ll / math.sqrt(ssr / (len(y0) - 2) / ll) if ssr > 0 and len(y0) > 2 else math.nan


def grid(max_d: float = 1.0, min_d: float = 0.1, steps: int = 11) -> list[float]:
    return [d for d in (max_d * i / (steps - 1) for i in range(steps)) if d >= min_d]


def _search(series: DataFrame, max_d: float, min_d: float, threshold: float, significance: float, points: int) -> DataFrame:
    """(ticker, d, fine): the least passing order of the grid, and of the finer steps up to it if points > 0."""
    limit, known = critical(significance), {}

    def run(t: pa.Table) -> pa.Table:
        x = _vector(t)

        def first(orders: list[float]) -> float | None:
            for d in orders:
                if d not in known:
                    known[d] = np.array(weights(d, threshold))
                y = _differenced(x, known[d])
                y = y[~np.isnan(y)]
                if len(y) >= MIN_VALUES and _statistic(y) < limit:
                    return d
            return None

        found = first(grid(max_d, min_d))
        d = max_d if found is None else found
        fine = first([min_d + (d - min_d) * i / (points - 1) for i in range(points)]) if points else None
        known.clear()
        return pa.table({"ticker": t.column("ticker")[:1], "d": [d], "fine": [round(d if fine is None else fine, 3)]})

    rows = series.select("ticker", "bar_ts", F.col("x").cast("double").alias("x"))
    return rows.groupBy("ticker").applyInArrow(run, "ticker string, d double, fine double")


def min_d_grid(series: DataFrame, max_d: float = 1.0, min_d: float = 0.1, threshold: float = 0.001, significance: float = 0.05) -> DataFrame:
    """(ticker, d): the least order of the grid whose series passes the test; max_d where none does.

    A ticker's orders are tried in turn up to the first that passes.
    """
    return _search(series, max_d, min_d, threshold, significance, 0).select("ticker", "d")


def min_d_refined(series: DataFrame, max_d: float = 1.0, min_d: float = 0.1, threshold: float = 0.001, significance: float = 0.05, points: int = 10) -> DataFrame:
    """(ticker, d): the grid's order, then the least that passes of points even steps from min_d up to it, to 3 places; one pass over a ticker's vector."""
    return _search(series, max_d, min_d, threshold, significance, points).select("ticker", F.col("fine").alias("d"))


def global_d(per_ticker: DataFrame, coverage: float = 0.8, max_d: float = 1.0) -> DataFrame:
    """One row d: of the sorted orders the one at int(n * coverage), the last at most; max_d without tickers.

    Tickers are counted by order, so what is sorted is one row an order of the grid.
    """
    counted = per_ticker.groupBy("d").agg(F.count("*").alias("n"))
    upto, total = F.sum("n").over(Window.orderBy("d")), F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    at = F.least(F.floor(total * coverage), total - 1)
    picked = counted.select("d", upto.alias("upto"), at.alias("at")).where("upto > at")
    return picked.agg(F.coalesce(F.min("d"), F.lit(max_d)).alias("d"))


def reference_ticker_d(series: DataFrame, ticker: str, **options) -> DataFrame:
    """One row d: that of one ticker; only its rows are read on."""
    return min_d_refined(series.where(F.col("ticker") == ticker), **options).select("d")


def until(series: DataFrame, cutoff: str) -> DataFrame:
    """Rows up to the end of the cutoff day, the day's own bars included."""
    return series.where(F.col("bar_ts") < F.lit(cutoff).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))


def train_cutoff_d(series: DataFrame, cutoff: str, coverage: float = 0.8, **options) -> DataFrame:
    """One row d, fitted on rows up to the cutoff day only."""
    return global_d(min_d_grid(until(series, cutoff), **options), coverage)


def memory_corr(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(ticker, corr): correlation where both are finite; 0 with fewer than 2 rows or no variance."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = pairs.select("ticker", F.when(finite(a) & finite(b), F.col(a)).alias("a"), F.when(finite(a) & finite(b), F.col(b)).alias("b"))
    sums = rows.groupBy("ticker").agg(F.regr_sxx("a", "b").alias("bb"), F.regr_syy("a", "b").alias("aa"), F.regr_sxy("a", "b").alias("ab"))
    return sums.select("ticker", F.coalesce(F.try_divide(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb"))), F.lit(0.0)).alias("corr"))


def ffd_features(bars: DataFrame, threshold: float = 0.001, coverage: float = 0.8, **options) -> DataFrame:
    """Adds log_close and log_close_frac_diff under the order that covers the tickers.

    The order is one number; it comes to the driver, and the series is differenced under it alone.
    """
    series = bars.withColumn("log_close", F.ln("close"))
    found = global_d(min_d_grid(series.withColumn("x", F.col("log_close")), threshold=threshold, **options), coverage).first()
    return frac_diff(series, found["d"], threshold, "log_close")
