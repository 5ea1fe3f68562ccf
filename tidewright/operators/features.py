"""Liquidity, return, calendar and categorical features.

Windows of one ticker share one specification, so Spark shuffles and sorts once for all columns
that are asked for in one select.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions import series
from tidewright.functions.windows import AT, HAND, average_rank, by_ticker, full_mean
from tidewright.sources.folders import shuffles_deleted, stored

LAGS = (1, 5, 10, 21, 42, 63)
LAGGED = (1, 5, 10, 21)
LOOKBACKS = (1, 2, 3, 4, 5)
HORIZONS = (1, 5, 10, 21)
#: Bins of a round of refinement.
BINS = 1024
#: Accuracy of the sketch that brackets a place: brackets hold some 4 parts in it of the rows.
BRACKET = 10_000
MONTH_BARS = {"1d": 21, "1h": 147}
NOT_FEATURES = ("bar_ts", "ticker", "sector", "industry")


def dollar_volume(df: DataFrame) -> DataFrame:
    return df.withColumn("dollar_vol", F.col("close") * F.col("volume"))


def dollar_volume_month(df: DataFrame, bars: int = MONTH_BARS["1d"]) -> DataFrame:
    """Rolling mean of dollar volume over a month of bars."""
    return df.withColumn("dollar_vol_1m", full_mean(F.col("dollar_vol"), bars, by_ticker(df, "dollar_vol")))


def dollar_volume_rank(df: DataFrame) -> DataFrame:
    """Descending average rank of the month's dollar volume among the tickers of a time."""
    return df.withColumn("dollar_vol_rank", average_rank(F.col("dollar_vol_1m"), "bar_ts"))


def liquid_universe(df: DataFrame, below: float = 100) -> DataFrame:
    return df.where(F.col("dollar_vol_rank") < below)


def log_price(df: DataFrame) -> DataFrame:
    """ln(close): null for zero and negative prices."""
    return df.withColumn("log_close", F.ln("close"))


def raw_returns(df: DataFrame, lags=LAGS) -> DataFrame:
    """close / close L bars before - 1; null at the start and after a zero price."""
    w = by_ticker(df, "close")
    return df.withColumns({f"raw_{n}b": F.try_divide(F.col("close"), F.lag("close", n).over(w)) - 1 for n in lags})


def _wanted(n: int, p: float, interpolation: str) -> list[tuple[int, float]]:
    """Places among n sorted values and their shares in the quantile p."""
    at = (n - 1) * p
    if interpolation == "nearest":
        return [(math.floor(at + 0.5), 1.0)]
    low = math.floor(at)
    return [(k, share) for k, share in ((low, 1 - (at - low)), (low + 1, at - low)) if share > 0]


def order_statistics(rows: DataFrame, places: list[tuple[str, int]], bins: int = BINS, accuracy: int = BRACKET) -> list[float]:
    """The values at the given places, from 0, of the sorted finite values of the given columns.

    Spark's mergeable quantile sketch brackets every place, one scan counts what lies before and
    in the brackets and writes the values strictly between a bracket's ends: a few parts in
    ``accuracy`` of the rows, however many values are equal. Where the counts prove a bracket
    wrong, another scan writes what lies between it and the column's end. The written values are
    refined in rounds: those between the bounds of a place are counted in even bins, the bin that
    holds the place gives the next bounds, and its least and greatest values tighten them, until
    these are equal or no more than ``4 * bins`` values are left, which are fetched. A round is
    one aggregate of at most ``bins`` rows a place, so no task ranks or holds values. rows are
    scanned three times, five if a bracket is wrong.
    """
    columns = list(dict.fromkeys(c for c, _ in places))
    counted = rows.agg(*[F.count(_finite(c)).alias(f"n_{i}") for i, c in enumerate(columns)]).first()
    n = dict(zip(columns, counted, strict=True))
    _, brackets = _bracketed(rows, [(c, (k + 0.5) / n[c]) for c, k in places], accuracy)
    return _placed(rows, places, n, brackets, bins)


def _finite(c: str) -> Column:
    return F.when(F.abs(F.col(f"`{c}`")) < float("inf"), F.col(f"`{c}`").cast("double"))


def _bracketed(rows: DataFrame, shares: list[tuple[str, float]], accuracy: int) -> tuple[dict[str, int], list[tuple[float, float]]]:
    """In one scan: the number of finite values by column, and a bracket by the sketch around each share, null without any."""
    columns = list(dict.fromkeys(c for c, _ in shares))
    near = {c: [min(1.0, max(0.0, p + side * 2 / accuracy)) for d, p in shares if d == c for side in (-1, 1)] for c in columns}
    found = rows.agg(*[F.count(_finite(c)).alias(f"n_{i}") for i, c in enumerate(columns)], *[F.percentile_approx(_finite(c), near[c], accuracy).alias(f"b_{i}") for i, c in enumerate(columns)]).first()
    ends = {c: iter(found[f"b_{i}"] or []) for i, c in enumerate(columns)}
    return {c: found[f"n_{i}"] for i, c in enumerate(columns)}, [(next(ends[c], None), next(ends[c], None)) for c, _ in shares]


def _inside(rows: DataFrame, ranges: list[tuple[str, float, float]]) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """A written table (place, x) of the finite values strictly between the ends of each range, and how many lie below its start, up to it, before its end and up to that; in one scan."""
    columns = list(dict.fromkeys(c for c, *_ in ranges))
    kinds = ("below", "upto", "before", "within")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(ranges), len(kinds)), np.int64)
        for b in batches:
            x = {c: v[~np.isnan(v)] for c in columns for v in (b.column(columns.index(c)).to_numpy(zero_copy_only=False).astype(float),)}
            own = []
            for i, (c, lo, hi) in enumerate(ranges):
                n[i] += [np.count_nonzero(x[c] < lo), np.count_nonzero(x[c] <= lo), np.count_nonzero(x[c] < hi), np.count_nonzero(x[c] <= hi)]
                own.append(x[c][(x[c] > lo) & (x[c] < hi)])
            size = sum(map(len, own))
            place = np.repeat(np.arange(len(ranges), dtype=np.int32), [len(v) for v in own])
            yield pa.record_batch([pa.array(place), pa.array(np.concatenate(own)), *[pa.nulls(size, pa.int64())] * len(kinds)], ["place", "x", *kinds])
        yield pa.record_batch([pa.array(np.arange(len(ranges), dtype=np.int32)), pa.nulls(len(ranges), pa.float64()), *[pa.array(v) for v in n.T]], ["place", "x", *kinds])

    finite = rows.select(*[_finite(c).alias(f"x_{i}") for i, c in enumerate(columns)])
    table = stored(finite.mapInArrow(found, "place int, x double, " + ", ".join(f"{k} long" for k in kinds)), "brackets")
    n = {r["place"]: tuple(r[1:]) for r in table.where("x IS NULL").groupBy("place").agg(*[F.sum(k).alias(k) for k in kinds]).collect()}
    return table.where("x IS NOT NULL").select("place", "x"), [n.get(i, (0,) * len(kinds)) for i in range(len(ranges))]


def _placed(rows: DataFrame, places: list[tuple[str, int]], totals: dict[str, int], brackets: list[tuple[float, float]], bins: int = BINS) -> list[float]:
    """The values at places, from what ``_bracketed`` found of their columns."""
    held, counts = _inside(rows, [(c, lo, hi) for (c, _), (lo, hi) in zip(places, brackets, strict=True)])
    # what is known of each place: bounds that it lies between, the values before them, and their number
    known: list[tuple] = []
    missed: dict[int, tuple[str, bool]] = {}
    for i, ((c, k), (lo, hi), (below, upto, before, within)) in enumerate(zip(places, brackets, counts, strict=True)):
        if below <= k < upto:
            known.append((lo, lo, 0, 1))
        elif before <= k < within:
            known.append((hi, hi, 0, 1))
        elif upto <= k < before:
            known.append((lo, hi, upto, before - upto))
        else:
            missed[i] = (c, k < below)
            known.append((-math.inf, lo, 0, below) if k < below else (hi, math.inf, within, totals[c] - within))
    if missed:
        wide, _ = _inside(rows, [(places[i][0], *known[i][:2]) for i in missed])
        again = F.get(F.array(*[F.lit(i) for i in missed]), F.col("place"))
        held = held.where(~F.col("place").isin(list(missed))).unionByName(wide.withColumn("place", again))
        for r in held.where(F.col("place").isin(list(missed))).groupBy("place").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
            known[r["place"]] = (r["lo"], r["hi"], *known[r["place"]][2:])
    return _refined(held, [k for _, k in places], known, bins)


def _refined(held: DataFrame, places: list[int], known: list[tuple], bins: int) -> list[float]:
    """The values at places among the rows (place, x) of held, by rounds of counts in bins; known: the bounds, the values before them, and their number."""
    of = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("place"))
    while open_ := [i for i, (lo, hi, _, _) in enumerate(known) if lo < hi]:
        los, his = [k[0] for k in known], [k[1] for k in known]
        inside = held.where(of([i in open_ for i in range(len(known))], "boolean") & (F.col("x") >= of(los, "double")) & (F.col("x") <= of(his, "double")))
        if all(known[i][3] <= 4 * bins for i in open_):
            left: dict[int, list[float]] = {i: [] for i in open_}
            for r in inside.collect():
                left[r["place"]].append(r["x"])
            for i in open_:
                x = sorted(left[i])[places[i] - known[i][2]]
                known[i] = (x, x, known[i][2], 1)
            break
        # halves where a difference would pass the largest double
        scale = [1.0 if math.isfinite(hi - lo) else 0.5 for lo, hi in zip(los, his, strict=True)]
        width = [hi * s - lo * s or 1.0 for lo, hi, s in zip(los, his, scale, strict=True)]
        part = (F.col("x") * of(scale, "double") - of([lo * s for lo, s in zip(los, scale, strict=True)], "double")) / of(width, "double")
        binned = inside.withColumn("bin", F.least(F.floor(part * bins).cast("int"), F.lit(bins - 1)))
        counts: dict[int, list] = {i: [] for i in open_}
        for r in binned.groupBy("place", "bin").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("place", "bin").collect():
            counts[r["place"]].append(r)
        for i in open_:
            before = known[i][2]
            for r in counts[i]:
                if before + r["n"] > places[i]:
                    known[i] = (r["lo"], r["hi"], before, r["n"])
                    break
                before += r["n"]
    return [k[0] for k in known]


def clip_bounds(raw: DataFrame, lags=LAGS, q: float = 0.001, interpolation: str = "nearest", fit_until: str | None = None, method: str = "exact", accuracy: int = 100_000) -> DataFrame:
    """One row with lo_L and hi_L, quantiles over the finite returns of all tickers; null without any.

    ``nearest`` takes the element at round((n-1)q); ``linear`` interpolates between the two
    elements around (n-1)q. ``exact`` finds the elements by refinement (``order_statistics``), in
    two scans of raw, seldom three, which should be a stored table or windows over a held one. ``approx``
    takes Spark's mergeable quantile sketch in one scan: its places are off by n / accuracy at
    most, and it doesn't interpolate. fit_until: only rows up to that time count, which avoids
    looking ahead.
    """
    if method not in ("exact", "approx") or interpolation not in ("nearest", "linear"):
        raise ValueError("method is exact or approx, interpolation nearest or linear")
    rows = raw if fit_until is None else raw.where(F.col("bar_ts") <= F.lit(fit_until).cast("timestamp_ntz"))
    rows = rows.select(*[F.when(F.abs(F.col(f"raw_{n}b")) < float("inf"), F.col(f"raw_{n}b")).alias(f"raw_{n}b") for n in lags])
    if method == "approx":
        both = rows.agg(*[F.percentile_approx(f"raw_{n}b", [q, 1 - q], accuracy).alias(f"b_{n}") for n in lags])
        return both.select(*[F.col(f"b_{n}")[i].alias(f"{side}_{n}") for n in lags for i, side in enumerate(("lo", "hi"))])
    sides = [(n, side, p) for n in lags for side, p in (("lo", q), ("hi", 1 - q))]
    # a place's share is p but for one part in the number of values
    with shuffles_deleted(raw.sparkSession):
        totals, brackets = _bracketed(rows, [(f"raw_{n}b", p) for n, _, p in sides], BRACKET)
        wanted = [(n, side, k, share, b) for (n, side, p), b in zip(sides, brackets, strict=True) if totals[f"raw_{n}b"] for k, share in _wanted(totals[f"raw_{n}b"], p, interpolation)]
        values = _placed(rows, [(f"raw_{n}b", k) for n, _, k, *_ in wanted], totals, [b for *_, b in wanted]) if wanted else []
    bounds: dict[str, float] = {}
    for (n, side, _, share, _), x in zip(wanted, values, strict=True):
        bounds[f"{side}_{n}"] = bounds.get(f"{side}_{n}", 0.0) + x * share
    names = [f"{side}_{n}" for n in lags for side in ("lo", "hi")]
    return raw.sparkSession.range(1).select(*[F.lit(bounds.get(x)).cast("double").alias(x) for x in names])


def clipped_returns(df: DataFrame, lags=LAGS, q: float = 0.001, interpolation: str = "nearest", fit_until: str | None = None, method: str = "exact", bounds: DataFrame | None = None) -> DataFrame:
    """return_Lb: the return over L bars, clipped to quantiles over all tickers, as a rate a bar.

    df is held (``series.held``) unless it is already; raw returns are windows over it and aren't
    written, as they are wider than the bars that they come from. The bounds are one row, so the
    join carries a few numbers. bounds: those of ``clip_bounds``, where a caller has them.
    """
    held = series.held(df) if bounds is None else df
    raw = raw_returns(held, lags)
    bounds = clip_bounds(raw, lags, q, interpolation, fit_until, method) if bounds is None else bounds

    def rate(n: int) -> Column:
        x = F.col(f"raw_{n}b")
        clipped = F.when(x.isNotNull(), F.least(F.greatest(x, F.col(f"lo_{n}")), F.col(f"hi_{n}")))
        return F.pow(1 + clipped, F.lit(1.0 / n))

    return raw.join(F.broadcast(bounds)).select(*df.columns, *[(rate(n) - 1).alias(f"return_{n}b") for n in lags])


def lagged_returns(df: DataFrame, lags=LAGGED, lookbacks=LOOKBACKS) -> DataFrame:
    """return_Lb_lagT: return_Lb of T * L bars before."""
    w = by_ticker(df, *[f"return_{n}b" for n in lags])
    return df.withColumns({f"return_{n}b_lag{t}": F.lag(f"return_{n}b", t * n).over(w) for n in lags for t in lookbacks})


def forward_targets(df: DataFrame, horizons=HORIZONS) -> DataFrame:
    """target_Hb: return_Hb of H bars ahead."""
    w = by_ticker(df, *[f"return_{h}b" for h in horizons])
    return df.withColumns({f"target_{h}b": F.lead(f"return_{h}b", h).over(w) for h in horizons})


def time_cycles(df: DataFrame, timeframe: str = "1d", ts: str = "bar_ts") -> DataFrame:
    """year from 2020; sine and cosine of month and weekday (Monday is 1); hour for hourly bars."""
    t, turn = F.col(ts), F.lit(2 * math.pi)
    parts = {"month": (F.month(t), 12), "weekday": (F.weekday(t) + 1, 7)} | ({"hour": (F.hour(t), 24)} if timeframe == "1h" else {})
    return df.withColumns({"year": F.year(t) - 2020} | {f"{n}_{f}": getattr(F, f)(turn * x / period) for n, (x, period) in parts.items() for f in ("sin", "cos")})


def _values(df: DataFrame, column: Column) -> list:
    """Distinct values that are not null, sorted: categories, so a few rows come to the driver."""
    return sorted(r[0] for r in df.select(column.alias("v")).where("v IS NOT NULL").distinct().collect())


def _dummies(df: DataFrame, column: Column, prefix: str) -> dict[str, Column]:
    return {f"{prefix}{v}": F.when(column == F.lit(v), 1).otherwise(0) for v in _values(df, column)[1:]}


def sector_dummies(df: DataFrame) -> DataFrame:
    """sector_V columns of 0 and 1 for all sectors but the first; sector and industry go."""
    if "sector" not in df.columns:
        raise ValueError("sector is missing")
    return df.withColumns(_dummies(df, F.col("sector"), "sector_")).drop("sector", "industry")


def calendar_dummies(df: DataFrame, ts: str = "bar_ts") -> DataFrame:
    """As sector_dummies, for year, month and sector; sectors without a prefix."""
    cols = _dummies(df, F.year(ts), "year_") | _dummies(df, F.month(ts), "month_") | _dummies(df, F.col("sector"), "")
    return df.withColumns(cols).drop("sector", "industry")


def feature_columns(df: DataFrame, targets: list[str]) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in (*NOT_FEATURES, *targets)]


def model_frame(df: DataFrame, targets: list[str], features: list[str] | None = None) -> DataFrame:
    """Keys, numeric features and targets; rows with a null in any of them go, NaN stays."""
    features = features or feature_columns(df, targets)
    out = df.select("ticker", "bar_ts", *features, *targets)
    return out.dropna(subset=[]) if not features + targets else out.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*features, *targets]))


def all_features(df: DataFrame, timeframe: str = "1d", rows: int | None = None) -> DataFrame:
    """Liquidity, indicators, returns, lags, targets, calendar and sector columns, in this order.

    The bars are held (``series.held``), so windows by ticker and the recursion over them need no
    shuffle; wide rows are neither shuffled nor written. rows: a bound of how many df has, where
    a caller knows it (``series.buckets``).
    """
    from tidewright.operators import indicators

    if "sector" not in df.columns:
        raise ValueError("sector is missing")
    held = series.held(df.drop("industry"), rows=rows)
    month = lambda rows: dollar_volume_month(dollar_volume(rows), MONTH_BARS[timeframe])
    # ranks go by time, all else by ticker: what is shuffled by time and back is a number a row, no row of the table
    by_time = month(held).select(HAND, AT, "bar_ts", "dollar_vol_1m").repartition(series.buckets(df.sparkSession, rows), "bar_ts")
    ranked = dollar_volume_rank(by_time).select(HAND, AT, "dollar_vol_rank")
    wide = indicators.weighted_close(indicators.cdl2crows(month(held)))
    wide = forward_targets(lagged_returns(clipped_returns(wide, bounds=clip_bounds(raw_returns(held)))))
    kept = [c for c in wide.columns if c not in ("ticker", "bar_ts", HAND, AT)]
    if series.extent(held)[1] <= series.CHUNK:
        found = indicators.recursive_in_hands(wide, ranked, ("ema5", "macd"), tuple(kept))
    else:
        found = indicators.recursive(wide.join(ranked, [HAND, AT]), ("ema5", "macd"), keep=(*kept, "dollar_vol_rank"))
    first = [c for c in (*df.columns, "dollar_vol", "dollar_vol_1m", "dollar_vol_rank", "cdl2crows", "wclprice", "ema5", "macd") if c not in (HAND, AT, "industry")]
    found = time_cycles(found.select(*first, *[c for c in kept if c not in first]), timeframe)
    return found.withColumns(_dummies(held, F.col("sector"), "sector_")).drop("sector")
