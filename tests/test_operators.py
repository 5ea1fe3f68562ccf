"""Semantics of the operators on small frames."""

import datetime as dt
import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import BAR, bar_rows
from tidewright.functions import series
from tidewright.functions.windows import mean_and_deviation
from tidewright.operators import evaluate, features, fracdiff, indicators, risk, validate, windows
from tidewright.plans import catalog, views
from tidewright.sources import bars, folders
from tidewright.streaming import incremental


def failed(report):
    return {(r["check"], r["column"]) for r in report.where("failed").collect()}


def one_null(spark):
    rows = [list(r) for r in bar_rows()]
    rows[5][5] = None
    return spark.createDataFrame([tuple(r) for r in rows], BAR)


def test_nulls_by_tolerance(spark):
    df = one_null(spark)
    assert failed(validate.validate_nulls(df, ["close"], 0.001)) == {("nulls", "close")}
    assert not failed(validate.validate_nulls(df, ["close"], 0.01))


def test_schema_missing_type_and_empty(spark, single):
    assert not failed(validate.validate_schema(single))
    bad = single.drop("volume").withColumn("close", F.col("close").cast("string"))
    assert failed(validate.validate_schema(bad)) == {("missing", "volume"), ("type", "close")}
    assert ("empty", "") in failed(validate.validate_schema(single.limit(0)))
    assert failed(validate.validate_nulls(single.limit(0), ["close"]))


def test_negative_price_zero_passes(spark, single):
    low = single.withColumn("low", F.when(F.col("bar_ts") == F.lit(dt.datetime(2024, 1, 5)), -1.0).otherwise(F.col("low")))
    assert failed(validate.validate_prices(low)) == {("prices", "low")}
    assert validate.price_sample(low).count() == 1
    assert not failed(validate.validate_prices(single.withColumn("low", F.lit(0.0))))
    with pytest.raises(validate.DataValidationError, match="low"):
        validate.raise_if_failed(validate.validate_prices(low))


def test_monotonic_by_arrival(spark):
    t = [dt.datetime(2024, 1, i + 1) for i in range(10)]
    ok = spark.createDataFrame([("A", x, i) for i, x in enumerate(t)] + [("A", t[9], 10)], "ticker string, bar_ts timestamp_ntz, seq int")
    assert not failed(validate.validate_monotonic(ok))
    t[3], t[4] = t[4], t[3]
    assert failed(validate.validate_monotonic(spark.createDataFrame([("A", x, i) for i, x in enumerate(t)], ok.schema)))


def test_finite_check_names_all_missing(spark, single):
    with pytest.raises(validate.DataValidationError, match="f1, f2"):
        validate.finite_check(single, ["close", "f1", "f2"])
    row = validate.finite_check(single.withColumn("x", F.when(F.col("close") > 100, float("nan"))), ["x"]).first()
    assert row["n_null"] + row["n_nan"] == 300


def test_report_covers_schema_and_reads_once(spark, single):
    df = single.withColumn("seq", F.col("bar_ts")).withColumn("close", F.when(F.col("open") < 100, -1.0).otherwise(F.col("close")))
    report = validate.validation_report(df, "seq")
    assert failed(report) == {("prices", "close")} and report.count() == 7 + 7 + 1 + 4 + 4 + 1
    assert failed(validate.validation_report(df.drop("low").withColumn("volume", F.lit("x")), "seq")) >= {("missing", "low"), ("type", "volume")}
    assert ("empty", "") in failed(validate.validation_report(df.limit(0), "seq"))
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    # order, and then the running counts of what is bad: over one scan, in one order of rows
    assert plan.count("Window ") == 2 and "Union" not in plan and "Join" not in plan and plan.count("InMemoryRelation") == 1
    assert report._jdf.queryExecution().sparkPlan().toString().count("Window") == 2 and report._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(ticker") == 1


def three(spark):
    return spark.createDataFrame([("T", dt.datetime(2024, 1, i + 1), c) for i, c in enumerate((100.0, 110.0, 105.0))], "ticker string, bar_ts timestamp_ntz, close double")


def test_return_of_ten_percent(spark):
    rows = features.clipped_returns(three(spark), (1,)).orderBy("bar_ts").collect()
    assert rows[0]["return_1b"] is None and rows[1]["return_1b"] == pytest.approx(0.10)


def test_zero_price_gives_null_return(spark):
    df = three(spark).withColumn("close", F.when(F.col("close") == 100, 0.0).otherwise(F.col("close")))
    assert features.raw_returns(df, (1,)).orderBy("bar_ts").collect()[1]["raw_1b"] is None


@pytest.mark.parametrize("q", [0.0, 0.001, 0.05, 0.3])
def test_nearest_bounds_are_elements(spark, multi, q):
    raw = features.raw_returns(multi, (1, 5))
    got = features.clip_bounds(raw, (1, 5), q).first()
    for n in (1, 5):
        x = sorted(r[0] for r in raw.select(f"raw_{n}b").dropna().collect())
        assert got[f"lo_{n}"] == x[round((len(x) - 1) * q)]
        assert got[f"hi_{n}"] == x[math.floor((len(x) - 1) * (1 - q) + 0.5)]


@pytest.mark.parametrize("q", [0.0, 0.013, 0.25])
def test_linear_bounds_interpolate(spark, multi, q):
    raw = features.raw_returns(multi, (1, 5))
    got = features.clip_bounds(raw, (1, 5), q, "linear").first()
    for n in (1, 5):
        x = [r[0] for r in raw.select(f"raw_{n}b").dropna().collect()]
        assert got[f"lo_{n}"] == pytest.approx(np.quantile(x, q)) and got[f"hi_{n}"] == pytest.approx(np.quantile(x, 1 - q))


def test_lags_and_targets_come_from_their_own_column(spark, single):
    df = features.forward_targets(features.lagged_returns(features.clipped_returns(single)))
    rows = df.orderBy("bar_ts").collect()
    assert rows[100]["return_5b_lag2"] == rows[90]["return_5b"]
    assert rows[100]["target_5b"] == rows[105]["return_5b"]


def test_time_cycles(spark):
    df = spark.createDataFrame([("T", dt.datetime(2024, 3, 15, 10)), ("T", dt.datetime(2024, 7, 4, 14))], "ticker string, bar_ts timestamp_ntz")
    a, b = features.time_cycles(df, "1d").orderBy("bar_ts").collect()
    assert (a["month_sin"], b["month_sin"]) == (pytest.approx(1), pytest.approx(-0.5)) and a["year"] == 4
    assert a["weekday_sin"] == pytest.approx(math.sin(2 * math.pi * 5 / 7)) and "hour_sin" not in df.columns
    assert "hour_sin" in features.time_cycles(df, "1h").columns


def test_dummies(spark, multi):
    out = features.sector_dummies(multi)
    assert "sector_Technology" in out.columns and "sector_Healthcare" not in out.columns and "industry" not in out.columns
    with pytest.raises(ValueError, match="sector"):
        features.sector_dummies(multi.drop("sector"))
    assert {"month_2", "Technology"} <= set(features.calendar_dummies(multi).columns)


def test_average_rank_and_nulls(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 3.0), ("c", 1.0), ("d", None)], "ticker string, dollar_vol_1m double").withColumn("bar_ts", F.lit(1))
    got = {r["ticker"]: r["dollar_vol_rank"] for r in features.dollar_volume_rank(df).collect()}
    assert got == {"a": 1.5, "b": 1.5, "c": 3.0, "d": None}


def test_month_mean_is_null_until_full(spark, single):
    rows = features.dollar_volume_month(features.dollar_volume(single), 21).orderBy("bar_ts").collect()
    assert rows[19]["dollar_vol_1m"] is None and rows[20]["dollar_vol_1m"] == pytest.approx(np.mean([r["dollar_vol"] for r in rows[:21]]))


def test_model_frame_drops_nulls_keeps_nan(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", None, 1.0), ("c", float("nan"), 2.0)], "ticker string, f double, t double").withColumn("bar_ts", F.lit(dt.datetime(2024, 1, 1)))
    assert {r["ticker"] for r in features.model_frame(df, ["t"]).collect()} == {"a", "c"}


def test_indicators(spark, single):
    rows = indicators.recursive(single).orderBy("bar_ts").collect()
    close = [r["close"] for r in single.orderBy("bar_ts").collect()]
    assert rows[3]["ema5"] is None and rows[4]["ema5"] == pytest.approx(np.mean(close[:5]))
    assert rows[5]["ema5"] == pytest.approx(np.mean(close[:5]) + (close[5] - np.mean(close[:5])) / 3)
    assert rows[32]["macd"] is None and rows[33]["macd"] is not None and rows[33]["macd_signal"] is not None
    assert rows[13]["rsi"] is None and 0 <= rows[14]["rsi"] <= 100
    b = indicators.bollinger_distance(single).orderBy("bar_ts").collect()
    assert b[18]["bb_high"] is None and b[19]["bb_high"] is not None
    assert all(r["cdl2crows"] == 0 for r in indicators.cdl2crows(single).collect())
    z = indicators.atr_zscore(single).agg(F.avg("atr_z"), F.stddev_samp("atr_z")).first()
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1)


def by_loop(close, high, low):
    """The indicators of a series row by row: counted from the first value, null for good from a later null on."""
    size, nan = len(close), float("nan")
    out = {c: [nan] * size for c in indicators.RECURSIVE}

    def mean(xs, n, seed, left):
        y, got = nan, []
        for i, x in enumerate(xs):
            y = sum(xs[seed - n + 1 : seed + 1]) / n if i == seed else left * y + (1 - left) * x
            got.append(y if i >= seed else nan)
        return got

    f = next((i for i in range(size) if close[i] == close[i]), size)
    x = close[f:]
    macd = [a - b for a, b in zip(mean(x, 12, 25, 11 / 13), mean(x, 26, 25, 25 / 27), strict=True)]
    step = [b - a for a, b in zip(x, x[1:], strict=False)]
    up, down = (mean([max(s * sign, 0) if s == s else nan for s in step], 14, 13, 13 / 14) for sign in (1, -1))
    out["ema5"][f:] = mean(x, 5, 4, 4 / 6)
    out["macd"][f + 33 :] = macd[33:]
    out["macd_signal"][f + 25 :] = mean(macd[25:], 9, 8, 8 / 10)
    out["rsi"][f + 1 :] = [0.0 if u + d == 0 else 100 * u / (u + d) for u, d in zip(up, down, strict=True)]
    f = next((i for i in range(size) if close[i] == close[i] and high[i] == high[i] and low[i] == low[i]), size)
    true = [nan if any(v != v for v in (high[i], low[i], close[i], close[i - 1])) else max(high[i] - low[i], abs(high[i] - close[i - 1]), abs(low[i] - close[i - 1])) for i in range(f + 1, size)]
    out["atr"][f + 1 :] = mean(true, 14, 13, 13 / 14)
    return {c: v[:size] for c, v in out.items()}


def with_gaps(seed):
    """Series with nulls at every kind of place: none, at the start, in the seeds, at chunk edges, late, two of them, all."""
    rows = []
    for k, (n, gaps) in enumerate([(300, ()), (300, (0, 1, 2)), (300, (10,)), (300, (67, 68)), (300, (136,)), (300, (299,)), (30, ()), (20, range(20)), (300, range(60)), (300, range(70)), (300, range(102)), (300, (*range(35), 200)), (205, (204,)), (150, (100,)), (36, (0,)), (1, ())]):
        for i, r in enumerate(bar_rows(f"T{k}", n, seed + k)):
            close = None if i in gaps else r[5]
            high = None if k == 13 and i == 50 else r[3]
            rows.append((*r[:3], high, r[4], close, *r[6:]))
    return rows


@pytest.mark.parametrize("chunk", [1 << 16, 68, 100])
def test_indicators_equal_a_loop_with_nulls_and_in_chunks(spark, chunk):
    rows = with_gaps(3)
    df = spark.createDataFrame(rows, BAR).repartition(7)
    found = indicators.recursive(df, chunk=chunk, keep=("open",))
    assert chunk > 300 or "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r["ticker"], []).append(r)
    value = lambda x: float("nan") if x is None else x
    for name in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == name]
        want = by_loop(*([value(r[k]) for r in mine] for k in (5, 3, 4)))
        have = sorted(got[name], key=lambda r: r["rn"])
        assert [(r["rn"], r["bar_ts"], r["open"]) for r in have] == [(i + 1, r[1], r[2]) for i, r in enumerate(mine)]
        for c in indicators.RECURSIVE:
            np.testing.assert_allclose([value(r[c]) for r in have], want[c], rtol=1e-9, err_msg=f"{name} {c}")


def test_a_null_time_shifts_no_other_row(spark, single):
    odd = spark.createDataFrame([("TEST", None, 1.0, 2.0, 0.5, None, 1.0, "s", "i")], BAR)
    values = lambda df: {r["bar_ts"]: (r["ema5"], r["macd"], r["wclprice"]) for r in indicators.technical(df).collect()}
    plain, with_null = values(single), values(single.unionByName(odd))
    assert with_null.pop(None) == (None, None, None) and with_null == plain


@pytest.mark.parametrize("chunk", [1 << 16, 1500])
def test_a_thousand_weights_equal_direct_sums(spark, chunk):
    w = fracdiff.weights(0.45, 1e-5)
    assert len(w) == 1000
    rng = np.random.default_rng(5)
    rows = [("A", i, float(x)) for i, x in enumerate(1e4 + np.cumsum(rng.normal(size=5200)))] + [("B", i, float(i)) for i in range(999)] + [("C", i, None if i in (3, 2400) else float(x)) for i, x in enumerate(rng.normal(size=4000))]
    df = spark.createDataFrame(rows, "ticker string, i long, x double").withColumn("bar_ts", F.timestamp_seconds("i").cast("timestamp_ntz")).repartition(5)
    got = {(r["ticker"], r["i"]): r["x_frac_diff"] for r in fracdiff.frac_diff(df, 0.45, 1e-5, chunk=chunk).collect()}
    assert len(got) == len(rows)
    for name in "ABC":
        x = [r[2] for r in rows if r[0] == name]
        for i in {*range(0, len(x), 97), 998, 999, 1002, 1003, 1004, 3399, 3400, len(x) - 1} & set(range(len(x))):
            frame = x[i - 999 : i + 1] if i >= 999 else [None]
            if None in frame:
                assert got[name, i] is None
            else:
                assert got[name, i] == pytest.approx(math.fsum(wk * v for wk, v in zip(w, frame[::-1], strict=True)), abs=1e-8)


@pytest.mark.parametrize("n", [100, 999, 1000, 4096, 9000])
def test_overlap_save_equals_convolution(n):
    rng = np.random.default_rng(n)
    w, x = np.array(fracdiff.weights(0.3, 1e-6)), rng.normal(size=n)
    x[rng.integers(0, n, 2)] = np.nan
    np.testing.assert_allclose(fracdiff._differenced(x, w), np.convolve(x, w, "valid") if n >= len(w) else [], atol=1e-12)


def test_windows_over_chunks_equal_those_over_whole_series(spark, multi):
    df = multi.unionByName(multi.limit(40).withColumn("close", F.col("close") + 1))  # repeated times
    df = features.dollar_volume(df).withColumns({f"return_{n}b": F.col("close") * n for n in features.HORIZONS}).repartition(5)
    ops = [
        (features.dollar_volume_month, 20, 0), (features.lagged_returns, 105, 0), (features.forward_targets, 0, 21), (indicators.cdl2crows, 12, 0), (indicators.bollinger_distance, 19, 0),
        (features.raw_returns, 63, 0), (lambda d: fracdiff.frac_diff(d, 0.4, col="close"), len(fracdiff.weights(0.4)) - 1, 0),
    ]
    for op, before, after in ops:
        for rows in (7, 50, 1000):
            split = series.over_chunks(df, op, before, after, rows)
            whole = op(df).select(split.columns)
            key = lambda r: str(tuple(r))
            flat = lambda d: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect()), key=str)
            assert flat(split) == flat(whole), (op, rows)
    assert "chunk" in series.over_chunks(df, features.forward_targets, 0, 21, 50)._jdf.queryExecution().toString()


@pytest.mark.parametrize("n", [1, 5, 20, 33])
def test_mean_and_deviation_of_lags_equal_those_of_a_frame(spark, n):
    rng = np.random.default_rng(n)
    odd = {50: None, 90: math.nan, 130: math.inf, **dict.fromkeys(range(170, 230), 7.25)}
    rows = [(t, i, odd.get(i, float(x))) for t in ("A", "B", None) for i, x in enumerate(rng.normal(1e6, 3, 260))]
    df = spark.createDataFrame([*rows, ("C", 0, 1.5)], "ticker string, bar_ts int, close double").repartition(3)
    w = Window.partitionBy("ticker").orderBy("bar_ts")
    found = mean_and_deviation(df, "close", n, w)
    assert found.columns == [*df.columns, "mean", "dev"]
    before = {}
    for r in found.orderBy("ticker", "bar_ts").collect():
        seen = before.setdefault(r.ticker, [])
        seen.append(r.close)
        last = seen[-n:]
        if len(last) < n or None in last:
            assert r.mean is None and r.dev is None
        elif not all(map(math.isfinite, last)):
            assert not math.isfinite(r.mean) and math.isnan(r.dev)
        else:
            assert r.mean == pytest.approx(np.mean(last), rel=1e-12) and r.dev == pytest.approx(np.std(last), rel=1e-9, abs=1e-9)
            assert r.dev == 0 or set(last) != {7.25}


def test_bands_update_no_moments_for_each_row_of_a_frame(single):
    assert "stddev_pop" not in indicators.bollinger_distance(single)._jdf.queryExecution().executedPlan().toString()


def test_repeated_times_do_not_multiply_rows(spark, single):
    twice = single.unionByName(single.limit(5))
    assert indicators.technical(twice).count() == 305


def test_two_crows_pattern(spark):
    base = [(10.0, 10.2)] * 12 + [(10.0, 13.0), (14.5, 13.5), (14.0, 11.0)]
    df = spark.createDataFrame([("T", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), o, c) for i, (o, c) in enumerate(base)], "ticker string, bar_ts timestamp_ntz, open double, close double")
    got = [r["cdl2crows"] for r in indicators.cdl2crows(df).orderBy("bar_ts").collect()]
    assert got == [0] * 14 + [-100]


def test_all_features_run(spark, multi):
    out = features.all_features(multi)
    assert {"dollar_vol_rank", "ema5", "macd", "cdl2crows", "wclprice", "return_63b", "return_21b_lag5", "target_21b", "month_sin", "sector_Technology"} <= set(out.columns)
    assert out.count() == 600


def test_weights():
    assert fracdiff.weights(0.0) == [1.0] and fracdiff.weights(1.0) == [1.0, -1.0]
    w = fracdiff.weights(0.4, 0.001)
    assert all(abs(a) > abs(b) for a, b in zip(w, w[1:], strict=False)) and abs(w[-1]) >= 0.001
    assert len(fracdiff.weights(0.4, 0.01)) < len(w)


def test_native_weights_equal(spark):
    df = spark.createDataFrame([(0.0,), (0.35,), (1.0,)], "d double")
    got = fracdiff.ffd_weights(df, 0.001).orderBy("d", "k").collect()
    assert [r["w"] for r in got] == pytest.approx(fracdiff.weights(0.0) + fracdiff.weights(0.35) + fracdiff.weights(1.0))


def walk(spark, n=500, seed=0, ticker="W"):
    x = np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.01, n)))
    return [(ticker, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)]


SERIES = "ticker string, bar_ts timestamp_ntz, x double"


def test_frac_diff_identity_and_no_bleed(spark):
    two = spark.createDataFrame(walk(spark, 50) + walk(spark, 50, 3, "V"), SERIES)
    assert two.where("1=1").join(fracdiff.frac_diff(two, 0.0), ["ticker", "bar_ts"]).where("x_frac_diff IS NULL").count() == 0
    rows = fracdiff.frac_diff(two, 1.0).orderBy("ticker", "bar_ts").collect()
    assert rows[0]["x_frac_diff"] is None and rows[50]["x_frac_diff"] is None and rows[51]["x_frac_diff"] == pytest.approx(rows[51]["x"] - rows[50]["x"])
    grid = {(r["ticker"], r["bar_ts"]): r["x"] for r in fracdiff.grid_series(two, [0.5], 0.01).collect()}
    plain = {(r["ticker"], r["bar_ts"]): r["x_frac_diff"] for r in fracdiff.frac_diff(two, 0.5, 0.01).collect() if r["x_frac_diff"] is not None}
    assert grid == pytest.approx(plain)


def _adf(x):
    """Least squares of the same rule with NumPy."""
    y, l, z = np.diff(x)[1:], x[1:-1], np.diff(x)[:-1]

    def fit(y, cols):
        a = np.column_stack([np.ones(len(y)), *cols])
        b, *_ = np.linalg.lstsq(a, y, rcond=None)
        ssr = ((y - a @ b) ** 2).sum()
        se = np.sqrt(ssr / (len(y) - a.shape[1]) * np.linalg.inv(a.T @ a)[1, 1])
        return b[1] / se, len(y) * np.log(ssr / len(y)) + 2 * a.shape[1]

    (_, aic0), (t1, aic1) = fit(y, [l]), fit(y, [l, z])
    return t1 if aic1 < aic0 else fit(np.diff(x), [x[:-1]])[0]


def test_adf_matches_least_squares_and_published_points(spark):
    rows = walk(spark) + walk(spark, 300, 7, "V")
    got = {r["ticker"]: r for r in fracdiff.with_p(fracdiff.adf_test(spark.createDataFrame(rows, SERIES))).collect()}
    assert got["W"]["stat"] == pytest.approx(_adf(np.array([r[2] for r in rows[:500]])), rel=1e-8) and not got["W"]["is_stationary"]
    assert got["V"]["stat"] == pytest.approx(_adf(np.array([r[2] for r in rows[500:]])), rel=1e-8)
    assert fracdiff.critical(0.05) == pytest.approx(-2.86, abs=0.01) and fracdiff.p_of(-30) == 0 and fracdiff.p_of(3) == 1


def test_constant_and_short_series_have_no_statistic(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("C", t + dt.timedelta(days=i), 1.0) for i in range(60)] + [("S", t, 1.0), ("S", t + dt.timedelta(days=1), 2.0)]
    df = spark.createDataFrame(rows, SERIES)
    assert all(r["stat"] is None for r in fracdiff.adf_test(df).collect())
    assert {r["d"] for r in fracdiff.min_d_grid(df, threshold=0.01).collect()} == {1.0}


def test_vector_statistic_equals_aggregates(spark):
    rows = walk(spark) + walk(spark, 300, 7, "V") + [("N", t, v + (i % 2)) for i, (_, t, v) in enumerate(walk(spark, 60, 9))]
    got = {r["ticker"]: r["stat"] for r in fracdiff.adf_test(spark.createDataFrame(rows, SERIES)).collect()}
    for t, stat in got.items():
        assert fracdiff._statistic(np.array([r[2] for r in rows if r[0] == t])) == pytest.approx(stat, rel=1e-6, abs=1e-9)


def test_least_order_and_refinement(spark):
    df = spark.createDataFrame(walk(spark) + walk(spark, 400, 5, "V"), SERIES)
    grid = {r["ticker"]: r["d"] for r in fracdiff.min_d_grid(df, threshold=0.01).collect()}
    fine = {r["ticker"]: r["d"] for r in fracdiff.min_d_refined(df, threshold=0.01).collect()}
    for t, d in grid.items():
        assert 0 < fine[t] <= d + 1e-9 and d - fine[t] <= 0.15
        test = fracdiff.with_p(fracdiff.adf_test(fracdiff.frac_diff(df.where(F.col("ticker") == t), d, 0.01).select("ticker", "bar_ts", F.col("x_frac_diff").alias("x")).dropna())).first()
        assert test["is_stationary"]
    assert fracdiff.global_d(fracdiff.min_d_grid(df, threshold=0.01)).first()["d"] == max(grid.values())
    assert fracdiff.global_d(fracdiff.min_d_grid(df.limit(0), threshold=0.01)).first()["d"] == 1.0


def test_memory(spark):
    df = spark.createDataFrame(walk(spark), SERIES)
    corr = lambda d: fracdiff.memory_corr(fracdiff.frac_diff(df, d), "x", "x_frac_diff").first()["corr"]
    assert corr(0.1) > 0.8 and corr(1.0) < 0.5
    assert fracdiff.memory_corr(df.limit(1).withColumn("y", F.lit(1.0)), "x", "y").first()["corr"] == 0.0


def test_cutoff_day_is_included(spark):
    df = spark.createDataFrame([("T", dt.datetime(2024, 1, 2, 15), 1.0), ("T", dt.datetime(2024, 1, 3), 2.0)], SERIES)
    assert fracdiff.until(df, "2024-01-02").count() == 1


def panel(spark, n, tickers):
    rng = np.random.default_rng(1)
    rows = [(f"T{k}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), *map(float, rng.normal(size=4))) for k in range(tickers) for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, bar_ts timestamp_ntz, f1 double, f2 double, f3 double, target_1b double"), rows


def test_windows_equal_a_loop(spark):
    df, rows = panel(spark, 50, 2)
    got = {(r["ticker"], r["start"]): r for r in windows.sliding_windows(df, ["f1", "f2", "f3"], ["target_1b"], 10).collect()}
    assert len(got) == 80 and set(got) == {(r["ticker"], r["start"]) for r in windows.window_index(df, 10).collect()}
    for k in range(2):
        mine = rows[50 * k : 50 * k + 50]
        for s in range(40):
            r = got[f"T{k}", s]
            np.testing.assert_array_equal(np.array(r["features"], np.float32), np.array([x[2:5] for x in mine[s : s + 10]], np.float32))
            assert r["target"][0] == np.float32(mine[s + 9][5])


def test_short_tickers_have_no_window(spark):
    df, _ = panel(spark, 10, 1)
    assert windows.window_index(df, 10).count() == 0 and windows.window_index(df, 9).count() == 1
    assert windows.window_manifest(df, ["f1"], ["target_1b"], 9).first()["n_windows"] == 1
    assert windows.window_manifest(df.limit(0), ["f1"], ["target_1b"], 9).first()["n_windows"] == 0


def test_splits_and_batches(spark):
    df, _ = panel(spark, 100, 2)
    n = windows.check_split(windows.time_split_ratio(df))
    assert n == {"train": 162, "val": 38}
    assert windows.check_split(windows.time_split_date(df, "2024-01-02")) == {"train": 96, "val": 104}
    with pytest.raises(ValueError, match="empty"):
        windows.check_split(windows.time_split_date(df, "2023-01-01"))
    with pytest.raises(Exception, match="empty"):
        windows.batches(windows.time_split_date(df, "2023-01-01"), 10, 32).collect()
    b = windows.batches(windows.time_split_ratio(df), 10, 32).where("split = 'train'").orderBy("idx").collect()
    assert [r["idx"] for r in b] == list(range(142)) and [r["batch"] for r in b] == [i // 32 for i in range(142)]


def returns(spark, p=4, n=200):
    x = np.random.default_rng(3).normal(0, 0.01, (n, p)) @ np.diag(range(1, p + 1))
    rows = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), f"a{j}", float(x[i, j])) for i in range(n) for j in range(p)]
    return spark.createDataFrame(rows, "portfolio string, bar_ts timestamp_ntz, asset string, ret double"), x


def test_covariances(spark):
    df, x = returns(spark)
    cov = {(r["i"], r["j"]): r["cov"] for r in risk.sample_cov(df).collect()}
    s = np.cov(x.T, ddof=0)
    assert all(cov[f"a{i}", f"a{j}"] == pytest.approx(s[i, j]) for i in range(4) for j in range(i, 4))
    lw = risk.ledoit_wolf(df).collect()
    assert 0 <= lw[0]["shrinkage"] <= 1 and sum(r["cov"] for r in lw if r["i"] == r["j"]) == pytest.approx(np.trace(s))
    assert all(r["corr"] == 1 for r in risk.cov_to_corr(risk.sample_cov(df)).collect() if r["i"] == r["j"])


def test_only_complete_rows_count(spark):
    df, x = returns(spark)
    gaps = df.where("NOT (asset = 'a1' AND day(bar_ts) = 3)").withColumn("ret", F.when((F.col("asset") != "a2") | (F.dayofmonth("bar_ts") != 9), F.col("ret")))
    keep = [i for i in range(200) if (dt.datetime(2024, 1, 1) + dt.timedelta(days=i)).day not in (3, 9)]
    s = np.cov(x[keep].T, ddof=0)
    assert {(r["i"], r["j"]): r["cov"] for r in risk.sample_cov(gaps).collect()} == {(f"a{i}", f"a{j}"): pytest.approx(s[i, j]) for i in range(4) for j in range(i, 4)}
    full = df.where(~F.dayofmonth("bar_ts").isin(3, 9))
    table = lambda d: {(r["i"], r["j"]): r["cov"] for r in risk.ledoit_wolf(d).collect()}
    assert table(gaps) == pytest.approx(table(full))


@pytest.mark.parametrize("seed", range(4))
def test_leaf_order_equals_slow_linkage(seed):
    d = np.random.default_rng(seed).random((25, 25))
    d = np.round(d + d.T, 1 if seed % 2 else 12)  # odd seeds have ties
    np.fill_diagonal(d, 0)
    got = risk._leaf_order(d)
    assert sorted(got) == list(range(25))
    if seed % 2:
        return
    assert got == linked(d)  # of two clusters the lower number goes first, as published


def test_denoise_keeps_trace_and_hrp_sums_to_one(spark):
    df, x = returns(spark)
    cov = risk.ledoit_wolf(df).drop("shrinkage")
    out = risk.denoise_cov(cov, df.groupBy("portfolio").agg(F.countDistinct("bar_ts").alias("n")))
    trace = lambda d: d.where("i = j").agg(F.sum("cov")).first()[0]
    assert trace(out) == pytest.approx(trace(cov))
    w = {r["asset"]: r["weight"] for r in risk.hrp_weights(cov).collect()}
    assert sum(w.values()) == pytest.approx(1, abs=1e-4) and w["a0"] > w["a3"]


def linked(dist):
    """Leaf order by merging the two clusters with the nearest members until one is left; the lower number goes first."""
    clusters, number = {k: [k] for k in range(len(dist))}, len(dist)
    while len(clusters) > 1:
        _, a, b = min((min(dist[i][j] for i in x for j in y), a, b) for a, x in clusters.items() for b, y in clusters.items() if a < b)
        clusters[number] = clusters.pop(a) + clusters.pop(b)
        number += 1
    return clusters[number - 1]


def parity(m, order):
    """Weights by halving the order, one half after another."""
    w, parts = np.ones(len(m)), [order]
    risk_of = lambda p: (v := 1 / np.diag(m)[p] / (1 / np.diag(m)[p]).sum()) @ m[np.ix_(p, p)] @ v
    while parts:
        halves = [(p[: len(p) // 2], p[len(p) // 2 :]) for p in parts if len(p) > 1]
        for x, y in halves:
            share = 1 - risk_of(x) / (risk_of(x) + risk_of(y))
            w[x] *= share
            w[y] *= 1 - share
        parts = [h for pair in halves for h in pair]
    return w


def test_hierarchical_weights_equal_the_published_order(spark):
    rng, rows, want = np.random.default_rng(1), [], {}
    for k in range(200):
        p = 6 if k < 150 else int(rng.integers(1, 12))
        x = rng.normal(size=(20, p)) @ rng.normal(size=(p, p))
        m = np.cov(x.T).reshape(p, p)
        s = np.sqrt(np.diag(m))
        dist = np.sqrt((1 - np.round(np.clip(m / np.outer(s, s), -1, 1), 6)) / 2)
        w = parity(m, linked(dist) if p > 1 else [0])
        want |= {(k, f"a{i:02d}"): 0 if abs(v) < 1e-4 else round(v, 5) for i, v in enumerate(w)}
        rows += [(k, f"a{i:02d}", f"a{j:02d}", float(m[i, j])) for i in range(p) for j in range(i, p)]
    got = {(r["portfolio"], r["asset"]): r["weight"] for r in risk.hrp_weights(spark.createDataFrame(rows, "portfolio long, i string, j string, cov double")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1.1e-5) for k in want)


@pytest.mark.parametrize("p,n", [(600, 150), (1, 5)])
def test_covariance_of_many_assets_equals_numpy(spark, p, n):
    rng = np.random.default_rng(p)
    x = 0.01 * rng.normal(size=(n, p)) + 0.05 * rng.normal(size=(1, p)) + 0.01 * rng.normal(size=(n, 1))
    rows = [("A", dt.datetime(2024, 1, 1) + dt.timedelta(days=t), [f"s{k:04d}" for k in range(p)], x[t].tolist()) for t in range(n)]
    df = spark.createDataFrame(rows, "portfolio string, bar_ts timestamp_ntz, assets array<string>, rets array<double>").repartition(3)
    df = df.select("portfolio", "bar_ts", F.explode(F.arrays_zip("assets", "rets")).alias("c")).select("portfolio", "bar_ts", F.col("c.assets").alias("asset"), F.col("c.rets").alias("ret"))
    found = risk.ledoit_wolf(df).toPandas()
    sample, centred = np.cov(x.T, bias=True).reshape(p, p), x - x.mean(axis=0)
    mu = np.trace(sample) / p
    delta = ((sample - mu * np.eye(p)) ** 2).sum() / p
    beta = min(delta, (((centred**2).sum(axis=1) ** 2).mean() - (sample**2).sum()) / (p * n))
    share = beta / delta if delta > 0 else 0.0
    want = (1 - share) * sample + share * mu * np.eye(p)
    i, j = (found[c].str[1:].astype(int).to_numpy() for c in "ij")
    assert len(found) == p * (p + 1) // 2 and (i <= j).all()
    np.testing.assert_allclose(found["cov"], want[i, j], rtol=1e-9, atol=1e-15)
    np.testing.assert_allclose(found["shrinkage"], share, rtol=1e-8)


def test_a_portfolio_counts_the_rows_that_it_used(spark):
    df, x = returns(spark)
    name = df.first()["portfolio"]
    holed = df.where(~((F.col("asset") == "a0") & (F.dayofmonth("bar_ts") <= 5)))
    n = {r["portfolio"]: r["n"] for r in risk.complete_rows(holed).collect()}
    assert 0 < n[name] < df.select("bar_ts").distinct().count()
    step = risk.hrp_weights(risk.denoise_cov(risk.ledoit_wolf(holed).drop("shrinkage"), spark.createDataFrame([(name, n[name])], f"portfolio {df.schema['portfolio'].dataType.simpleString()}, n long")))
    assert weights_of(risk.hrp_portfolio(holed)) == weights_of(step)


def weights_of(df):
    return {r["asset"]: r["weight"] for r in df.collect()}


@pytest.mark.parametrize("w,most", [([0.5, 0.3, 0.1, 0.1], 0.3), ([0.4, 0.35, 0.2, 0.05], 0.3), ([0.25] * 4, 0.3), ([0.9, 0.1, 0.0, 0.0], 0.4), ([0.6, 0.4, 0.0, 0.0], 0.5), ([0.5, 0.5, 0.0, 0.0], 0.3), ([0.6, 0.4, 0.0, 0.0], 0.4), ([1.0, 0.0, 0.0, 0.0], 0.25)])
def test_cap_equals_a_loop(spark, w, most):
    left = dict(enumerate(w))
    want, budget = {}, 1.0
    if max(w) > most + 1e-10:
        while left:
            k = max(left, key=lambda i: (left[i], -i))
            total = sum(left.values())
            if total <= 1e-15 or left[k] * budget / total <= most + 1e-12:
                break
            want[k] = most
            budget -= most
            left.pop(k)
        total = sum(left.values())
        want = want | {k: x * budget / total for k, x in left.items()} if total > 1e-15 else dict.fromkeys(range(len(w)), 1 / len(w))
    else:
        want = left
    df = spark.createDataFrame([("P", f"a{i}", x) for i, x in enumerate(w)], "portfolio string, asset string, weight double")
    got = weights_of(risk.max_position(df, most))
    assert got == pytest.approx({f"a{k}": x for k, x in want.items()})


def test_rules_on_weights(spark):
    make = lambda *w: spark.createDataFrame([("P", f"a{i}", float(x)) for i, x in enumerate(w)], "portfolio string, asset string, weight double")
    assert weights_of(risk.long_only(make(1.2, -0.2))) == {"a0": 1.0, "a1": 0.0}
    assert weights_of(risk.min_position(make(0.96, 0.04), 0.05)) == {"a0": 1.0, "a1": 0.0}
    assert weights_of(risk.min_position(make(0.02, 0.02), 0.05)) == {"a0": 0.5, "a1": 0.5}
    assert weights_of(risk.max_position(make(0.4), 0.3)) == {"a0": 1.0}
    assert weights_of(risk.max_position(make(0.5, 0.5, 0.0, 0.0), 0.3)) == dict.fromkeys(("a0", "a1", "a2", "a3"), 0.25)
    assert weights_of(risk.constrained_weights(make(0.48, 0.48, 0.04, 0.0), 0.05, 0.3)) == dict.fromkeys(("a0", "a1", "a2", "a3"), 0.25)
    assert weights_of(risk.max_position(make(0.5, 0.5), 0.3, strict=False)) == {"a0": None, "a1": None}
    with pytest.raises(Exception, match="under 1/2"):
        risk.max_position(make(0.5, 0.5), 0.3).collect()
    with pytest.raises(Exception, match="sum to"):
        risk.constrained_weights(make(-0.5, -0.5, 0.0), 0.0, 0.5).collect()
    assert all(r["sums_to_one"] for r in risk.constrained_weights(make(0.5, 0.2, 0.2, 0.08, 0.02), 0.05, 0.4).collect())


def model(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        for t in range(4):
            a, b = rng.normal(size=2)
            rows.append((f"T{t}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(a), float(b), float(2 * a - b + 0.5 + 0.1 * rng.normal())))
    return spark.createDataFrame(rows, "ticker string, bar_ts timestamp_ntz, a double, b double, y double")


def test_folds(spark):
    folds = evaluate.cv_folds(model(spark), 5, 30, 10, 1)
    got = {(r["fold"], r["part"]): (r["n"], r["lo"], r["hi"]) for r in folds.groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("bar_ts").alias("lo"), F.max("bar_ts").alias("hi")).collect()}
    assert sorted({k[0] for k in got}) == [0, 1]
    for f in (0, 1):
        assert got[f, "test"][0] == 10 and got[f, "train"][0] == 30 and got[f, "train"][2] < got[f, "test"][1] - dt.timedelta(days=1)


@pytest.mark.parametrize("n,splits,train,test,look", [(60, None, 7, 3, 1), (60, 4, 7, 3, 0), (20, None, 18, 1, 1), (20, None, 19, 1, 1), (9, None, 3, 4, 2)])
def test_folds_equal_a_loop(spark, n, splits, train, test, look):
    times = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i) for i in range(n)]
    df = spark.createDataFrame([(t, x) for t in times for x in "ab"], "bar_ts timestamp_ntz, ticker string")
    want, late = set(), times[::-1]
    for i in range(n if splits is None else splits):
        end = (i + 1) * test
        if end + look + train >= n:
            break
        want |= {(i, "test", t) for t in late[i * test : end]} | {(i, "train", t) for t in late[end + look : end + look + train]}
    assert {tuple(r) for r in evaluate.cv_folds(df, splits, train, test, look).collect()} == want


def by_fold(spark, n_splits=2):
    """Rows of each fold's training and test part as arrays."""
    df = model(spark).withColumn("a", F.col("a") + 1000).withColumn("c", F.lit(7.0))
    folds = evaluate.cv_folds(df, n_splits, 30, 10, 1)
    rows = df.join(folds, "bar_ts").collect()
    pick = lambda f, part: np.array([[r["a"], r["b"], r["c"], r["y"]] for r in rows if r["fold"] == f and r["part"] == part])
    return df, folds, {f: (pick(f, "train"), pick(f, "test")) for f in range(n_splits)}


def coefs(d):
    return {(r["fold"], r["alpha"], r["feature"]): (r["coef"], r["slope"]) for r in d.collect()}


def scaled(m):
    mean, std = m.mean(axis=0), m.std(axis=0)
    std = np.where(std < 1e-9, 1, std)
    return (m - mean) / std, mean, std


def test_linear_models_are_those_of_scaled_columns(spark):
    df, folds, parts = by_fold(spark)
    x = ["a", "b", "c"]
    alphas = [0.01, 5.0, 500.0]
    plain, shrunk, sparse = coefs(evaluate.ols(df, folds, x, "y")), coefs(evaluate.ridge(df, folds, x, "y", alphas)), coefs(evaluate.lasso(df, folds, x, "y", [1e-3, 0.1, 2.0], 1e-12))
    for f, (train, _) in parts.items():
        z, mean, std = scaled(train)
        n = len(z)
        for alpha, found in [(0.0, plain), *((a, shrunk) for a in alphas)]:
            b = np.linalg.pinv(z[:, :3].T @ z[:, :3] + alpha * np.eye(3)) @ (z[:, :3].T @ z[:, 3])
            assert [found[f, alpha, c][0] for c in x] == pytest.approx(b.tolist(), abs=1e-8)
            slope = b * std[3] / std[:3]
            assert [found[f, alpha, c][1] for c in x] == pytest.approx(slope.tolist(), abs=1e-8)
            assert found[f, alpha, "1"][1] == pytest.approx(mean[3] - mean[:3] @ slope, abs=1e-6)
        for alpha in (1e-3, 0.1, 2.0):
            b = np.zeros(3)
            for _ in range(2000):  # the same descent on the rows themselves
                for j in range(2):
                    rho = z[:, j] @ (z[:, 3] - z[:, :3] @ b + z[:, j] * b[j])
                    b[j] = np.sign(rho) * max(abs(rho) - n * alpha, 0) / (z[:, j] @ z[:, j])
            assert [sparse[f, alpha, c][0] for c in x] == pytest.approx(b.tolist(), abs=1e-8)
        assert sparse[f, 2.0, "a"][0] == 0 == sparse[f, 2.0, "b"][0]
    assert len(evaluate.RIDGE_ALPHAS) == 18 and len(evaluate.LASSO_ALPHAS) == 40
    scale = {(r["fold"], r["column"]): r for r in evaluate.fold_scaler(df, folds, ["c", "y"]).collect()}
    assert scale[0, "c"]["std"] == 1.0 and scale[0, "c"]["mean"] == 7.0


def test_walk_forward_predictions_are_in_the_units_of_y(spark):
    df, folds, parts = by_fold(spark)
    preds = evaluate.predict(df, folds, evaluate.ridge(df, folds, ["a", "b"], "y", [2.0]), ["a", "b"], "y")
    for f, (train, test) in parts.items():
        z, mean, std = scaled(train)
        z = z[:, [0, 1, 3]]
        b = np.linalg.solve(z[:, :2].T @ z[:, :2] + 2.0 * np.eye(2), z[:, :2].T @ z[:, 2])
        want = (test[:, :2] - mean[:2]) / std[:2] @ b * std[3] + mean[3]
        got = preds.where(F.col("fold") == f).collect()
        assert sorted(r["predicted"] for r in got) == pytest.approx(sorted(want.tolist())) and sorted(r["actual"] for r in got) == pytest.approx(sorted(test[:, 3].tolist()))
    scores = evaluate.alpha_scores(evaluate.daily_ic(preds)).first()
    assert scores["is_best"] and scores["mean_ic"] > 80


def test_gram_and_correlations_equal_numpy(spark):
    df, folds, parts = by_fold(spark)
    gram = {(r["fold"], r["a"], r["b"]): (r["n"], r["s"]) for r in evaluate.fold_gram(df, folds, ["a", "b"], "y").collect()}
    for f, (train, _) in parts.items():
        m = np.column_stack([np.ones(len(train)), train[:, [0, 1, 3]]])
        for i, a in enumerate(("1", "a", "b", "y")):
            for j, b in enumerate(("1", "a", "b", "y")):
                if i <= j:
                    assert gram[f, a, b] == (len(train), pytest.approx(m[:, i] @ m[:, j]))
    holes = df.withColumn("b", F.when(F.col("ticker") != "T1", F.col("b"))).withColumn("y", F.when(F.dayofmonth("bar_ts") > 3, F.col("y")))
    rows = [(r["a"], r["b"], r["y"]) for r in holes.collect()]
    for (i, a), (j, b) in [((0, "a"), (1, "b")), ((1, "b"), (2, "y")), ((0, "a"), (2, "y"))]:
        both = np.array([(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None])
        got = {(r["a"], r["b"]): r["corr"] for r in evaluate.feature_corr(holes.repartition(3), ["a", "b", "y", "c"]).collect()}
        assert got[a, b] == pytest.approx(np.corrcoef(both.T)[0, 1]) and got[b, a] == pytest.approx(got[a, b]) and got[a, a] == 1 and got["c", a] is None


def test_scores(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "A", t, 1.0, 1.0), (1, "B", t, 2.0, 5.0), (1, "C", t, 3.0, 9.0), (1, "A", t + dt.timedelta(1), 1.0, 1.0), (1, "B", t + dt.timedelta(1), 1.0, 2.0)]
    p = spark.createDataFrame(rows, "alpha int, ticker string, bar_ts timestamp_ntz, predicted double, actual double")
    ic = [r["ic"] for r in evaluate.daily_ic(p).orderBy("bar_ts").collect()]
    assert ic == [pytest.approx(100), None]
    assert evaluate.daily_rmse(p).orderBy("bar_ts").first()["rmse"] == pytest.approx(math.sqrt((0 + 9 + 36) / 3))
    assert evaluate.alpha_scores(evaluate.daily_ic(p)).first()["is_best"]
    c = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.0, 5.0)], "a double, b double, k double")
    corr = {(r["a"], r["b"]): r["corr"] for r in evaluate.feature_corr(c, ["a", "b", "k"]).collect()}
    assert corr["a", "b"] == pytest.approx(1) and corr["a", "k"] is None and len(corr) == 9
    assert {r["feature"] for r in evaluate.strong_features(evaluate.feature_corr(c, ["a", "b", "k"])).collect()} == {"a", "b"}


def test_sources_and_sinks(spark, multi, tmp_path):
    wide = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0, 2.0, None, None)], "bar_ts timestamp_ntz, Open_A double, Close_A double, Open_B double, Close_B double")
    assert [tuple(r) for r in bars.wide_to_long(wide).collect()] == [("A", dt.datetime(2024, 1, 1), 2.0, 1.0)]
    known = spark.createDataFrame([("AAA", "X", "Y"), ("AAA", "X", "Z")], "ticker string, sector string, industry string")
    dim = bars.sector_dimension(known, multi)
    assert {(r["ticker"], r["sector"]) for r in dim.collect()} == {("AAA", "X"), ("BBB", None)}
    plain = multi.drop("sector", "industry")
    assert bars.load_market_data(plain, dim).where("sector = 'Unknown'").count() == 300
    assert bars.sector_required_join(plain, dim).count() == 300 and bars.ticker_universe(multi, known).count() == 300
    path = bars.write_parquet_snapshot(multi, str(tmp_path), "model", dt.datetime(2025, 1, 3, 9, 5))
    assert path.endswith("model_20250103_0905.parquet") and spark.read.parquet(path).count() == 600
    assert bars.stage_table(multi, str(tmp_path), "raw").count() == 600


def test_incremental_validation(spark, tmp_path):
    schema = "ticker string, bar_ts timestamp_ntz, open double, high double, low double, close double, seq int"
    t = dt.datetime(2024, 1, 1)
    where = {k: str(tmp_path / k) for k in ("in", "good", "bad", "checkpoint")}
    rows = [("A", t, 1.0, 1.0, 1.0, 1.0, 0), ("A", t + dt.timedelta(1), 1.0, 1.0, -1.0, 1.0, 1), ("A", t, 1.0, 1.0, 1.0, 1.0, 2), ("B", t, None, 1.0, 1.0, 1.0, 0)]
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(where["in"])
    run = lambda: incremental.incremental_validate(spark, where["in"], df.schema, where["good"], where["bad"], where["checkpoint"])
    run()
    df.limit(1).coalesce(1).write.mode("append").parquet(where["in"])
    run()
    run()  # nothing new: nothing counted again
    assert spark.read.parquet(where["good"]).count() == 2
    assert {r["reason"] for r in spark.read.parquet(where["bad"]).collect()} == {"price", "order", "null"}


@pytest.mark.parametrize("length,size,per_block", [(5, 4, 2), (3, 32, 64), (1, 3, 1)])
def test_batches_hold_their_windows(spark, tmp_path, length, size, per_block):
    rng = np.random.default_rng(6)
    rows = [(t, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), float(rng.normal()), None if rng.random() < 0.05 else float(d), float(rng.normal())) for t, n in (("A", 50), ("B", 4), ("C", 33), ("D", length), ("E", 1), ("F", 40)) for d in range(n)]
    df = spark.createDataFrame(rows, "ticker string, bar_ts timestamp_ntz, a double, b double, y double").withColumn("split", F.when(F.dayofyear("bar_ts") <= 30, "train").otherwise("val")).repartition(4)
    index = {(r["split"], r["idx"]): r for r in windows.batches(df, length, size).collect()}
    path = windows.write_blocks(df, ["a", "b"], ["y"], str(tmp_path / "blocks"), length, size, per_block)
    seen = 0
    for row in windows.read_batches(spark, path).collect():
        x, y = windows.tensors(row)
        assert x.shape == (row["n"], length, 2) and y.shape == (row["n"], 1) and row["first"] == row["batch"] * size
        for k in range(row["n"]):
            w = index[row["split"], row["first"] + k]
            mine = sorted(r for r in rows if r[0] == w["ticker"] and (r[1].timetuple().tm_yday <= 30) == (row["split"] == "train"))[w["start"] : w["start"] + length]
            np.testing.assert_array_equal(x[k], np.array([[np.nan if v is None else v for v in r[2:4]] for r in mine], np.float32))
            assert y[k, 0] == np.float32(mine[-1][4]) and w["batch"] == row["batch"]
            seen += 1
    assert seen == len(index)
    only = windows.read_batches(spark, path, "val")
    assert {r["split"] for r in only.select("split").collect()} <= {"val"} and "PartitionFilters: [isnotnull(split" in only._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="empty"):
        windows.write_blocks(df.where("split = 'val'"), ["a"], ["y"], str(tmp_path / "none"), length)


def test_errors_show_the_first_bad_rows(spark, multi):
    w = Window.partitionBy("ticker").orderBy("bar_ts")
    df = multi.withColumn("seq", F.row_number().over(w) * 2 + (F.col("ticker") == "BBB").cast("int"))
    bad = df.withColumn("low", F.when(F.col("seq") % 10 < 2, -F.col("seq").cast("double")).otherwise(F.col("low"))).withColumn("bar_ts", F.when(F.col("seq") % 50 < 2, F.lit(dt.datetime(2020, 1, 1))).otherwise(F.col("bar_ts")))
    report = validate.validation_report(bad, "seq")
    plan = report._jdf.queryExecution().toString()
    assert plan.count("Scan ExistingRDD") <= 1 or plan.count("InMemoryTableScan") >= 1
    found = {(r["check"], r["column"]): [json.loads(x)["seq"] for x in r["detail"]] for r in report.collect()}
    assert found["prices", "low"] == [10, 11, 20, 21, 30] and found["monotonic", "bar_ts"] == [50, 51, 100] and found["prices", "open"] == [] == found["nulls", "low"]
    with pytest.raises(validate.DataValidationError) as e:
        validate.raise_if_failed(report)
    assert '"low":-21.0' in str(e.value) and '"low":-31.0' not in str(e.value) and '"seq":100' in str(e.value)
    validate.raise_if_failed(validate.validation_report(df, "seq"))
    empty = validate.validation_report(df.limit(0), "seq")
    assert ("empty", "") in failed(empty) and all(r["n_rows"] in (0, 1) and not r["detail"] for r in empty.collect())


def test_lasso_path_equals_cold_starts_in_fewer_visits():
    rng, p, n = np.random.default_rng(4), 60, 400
    x = rng.normal(size=(n, p)) @ (np.eye(p) + 0.3 * rng.normal(size=(p, p)) / np.sqrt(p))
    x[:, 7] = 0
    y = x[:, :6] @ [3, -2, 2, 1, -1, 0.5] + rng.normal(size=n)
    g, r = x.T @ x, x.T @ y
    penalties = [n * a for a in evaluate.LASSO_ALPHAS]

    def cold(lam, tol):
        """From zero, every feature in every sweep; the solution and the coordinates visited."""
        b, visited = np.zeros(p), 0
        while True:
            before = b.copy()
            for j in np.flatnonzero(np.diag(g)):
                rho = r[j] - g[j] @ b + g[j, j] * b[j]
                b[j] = np.sign(rho) * max(abs(rho) - lam, 0) / g[j, j]
                visited += 1
            if np.abs(b - before).max() < tol:
                return b, visited

    for lam, got in zip(penalties, evaluate._lasso_path(g, r, penalties, 1e-11, 5000), strict=True):
        np.testing.assert_allclose(got, cold(lam, 1e-11)[0], atol=1e-8)
    seen: list[int] = []  # at the published tolerance
    evaluate._lasso_path(g, r, penalties, 1e-4, 1000, seen)
    assert len(seen) == 40 and sum(seen) < sum(cold(lam, 1e-4)[1] for lam in penalties) / 2


def test_penalty_vectors_equal_a_row_a_penalty(spark):
    rng = np.random.default_rng(8)
    rows = [(f"T{k:02d}", dt.datetime(2024, 1, 1) + dt.timedelta(days=d), float(rng.integers(0, 3)), float(rng.normal()), float(rng.integers(0, 4))) for d in range(40) for k in range(9)]
    df = spark.createDataFrame(rows, "ticker string, bar_ts timestamp_ntz, a double, b double, y double")
    flat = df.withColumn("y", F.when(F.col("bar_ts") > dt.datetime(2024, 2, 5), 1.0).otherwise(F.col("y")))  # times without variance
    folds = evaluate.cv_folds(flat, None, 12, 4, 1)
    models = evaluate.ridge(flat, folds, ["a", "b"], "y", [0.1, 100.0])
    long = evaluate.predict(flat, folds, models, ["a", "b"], "y").cache()
    paths = evaluate.predict_paths(flat, folds, models, ["a", "b"], "y")
    key = lambda d: {(r["fold"], r["alpha"], r["ticker"], r["bar_ts"]): (r["predicted"], r["actual"]) for r in d.collect()}
    got = key(paths.select("fold", "ticker", "bar_ts", "actual", F.explode(F.arrays_zip("alphas", "predicted")).alias("c")).selectExpr("fold", "c.alphas AS alpha", "ticker", "bar_ts", "c.predicted AS predicted", "actual"))
    want = key(long)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    scores = {(r["alpha"], r["bar_ts"]): r for r in evaluate.walk_forward_scores(flat, folds, models, ["a", "b"], "y").collect()}
    ic = {(r["alpha"], r["bar_ts"]): r["ic"] for r in evaluate.daily_ic(long).collect()}
    rmse = {(r["alpha"], r["bar_ts"]): r["rmse"] for r in evaluate.daily_rmse(long).collect()}
    assert scores.keys() == ic.keys() and any(v is None for v in ic.values())
    assert all((scores[k]["ic"] is None) == (ic[k] is None) and (ic[k] is None or scores[k]["ic"] == pytest.approx(ic[k], abs=1e-9)) and scores[k]["rmse"] == pytest.approx(rmse[k]) and scores[k]["n"] == 9 for k in ic)


@pytest.mark.parametrize("kind", ["one bin", "spread", "ties", "far", "constant"])
def test_order_statistics_equal_sorting(spark, kind):
    rng = np.random.default_rng(7)
    n = 3000
    x = {
        "one bin": 1e-7 * rng.normal(size=n), "spread": np.concatenate([10.0 ** rng.integers(-12, 12, n - 2), [1e300, -1e300]]), "ties": rng.integers(0, 3, n).astype(float),
        "far": 1e9 + rng.normal(size=n), "constant": np.full(n, 0.25),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),), (float("inf"),)], "x double").repartition(3)
    places = [0, 3, n // 2, n - 1]
    assert features.order_statistics(df, [("x", k) for k in places], 16) == [np.sort(x)[k] for k in places]


def test_clip_bounds_of_few_values_and_by_sketch(spark):
    few = spark.createDataFrame([(0.5, None), (float("nan"), None)], "raw_1b double, raw_5b double")
    assert features.clip_bounds(few, (1, 5)).first().asDict() == {"lo_1": 0.5, "hi_1": 0.5, "lo_5": None, "hi_5": None}
    many = spark.range(10_000).select((F.col("id") / 7).alias("raw_1b"))
    exact, sketch = features.clip_bounds(many, (1,)).first(), features.clip_bounds(many, (1,), method="approx").first()
    assert exact["lo_1"] == 10 / 7 and exact["hi_1"] == 9989 / 7 and all(abs(exact[k] - sketch[k]) <= 1 / 7 + 1e-9 for k in ("lo_1", "hi_1"))
    with pytest.raises(ValueError):
        features.clip_bounds(many, (1,), method="other")


@pytest.mark.parametrize("chunk", [1 << 16, 2])
def test_order_is_judged_over_batches_and_restarts(spark, tmp_path, chunk):
    schema = "ticker string, bar_ts timestamp_ntz, open double, high double, low double, close double, seq int"
    t = dt.datetime(2024, 1, 1)
    where = {k: str(tmp_path / k) for k in ("in", "good", "bad", "checkpoint")}
    bar = lambda ticker, day, seq: (ticker, None if day is None else t + dt.timedelta(day), 1.0, 1.0, 1.0, 1.0, seq)
    calls = [
        [bar("A", d, k) for k, d in enumerate((0, 1, 2, 5))] + [bar("B", 3, 0), bar(None, 4, 0), bar("C", None, 0)],
        [bar("A", 4, 10), bar("A", 4, 11), bar("B", 3, 10), bar("C", 1, 1)],
        [bar("A", 3, 20), bar(None, 3, 1), bar("B", 2, 20), bar("C", 0, 2), bar("D", 0, 0)],
    ]
    run = lambda: incremental.incremental_validate(spark, where["in"], spark.createDataFrame([], schema).schema, where["good"], where["bad"], where["checkpoint"], chunk=chunk)
    for rows in calls:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where["in"])
        run()
    late = lambda: sorted((r["ticker"] or "", r["seq"]) for r in spark.read.parquet(where["bad"]).collect())
    want = [("", 1), ("A", 10), ("A", 20), ("B", 20), ("C", 2)]
    assert late() == want
    for name in ("commits/2", "commits/.2.crc"):  # as if the last batch had failed after its writes
        (tmp_path / "checkpoint" / name).unlink()
    run()
    assert late() == want and spark.read.parquet(where["good"]).count() == sum(map(len, calls)) - len(want)


def test_ticker_dimension(spark, tmp_path):
    (tmp_path / "t.yaml").write_text('- ticker: X\n  aliases: ["X", "Ex"]\n  tier: 1\n  cik: "0001"\n- ticker: Y\n  underlying: X\n')
    (tmp_path / "t.json").write_text('[{"ticker": "X", "aliases": ["X", "Ex"], "tier": 1, "cik": "0001"}, {"ticker": "Y", "underlying": "X"}]')
    a, b = (bars.read_ticker_dimension(spark, str(tmp_path / f"t.{x}")) for x in ("yaml", "json"))
    rows = sorted(a.collect())
    assert rows == sorted(b.collect()) and a.schema == b.schema
    assert rows[0]["aliases"] == ["X", "Ex"] and rows[0]["tier"] == 1 and rows[1]["underlying"] == "X" and rows[1]["tier"] is None


class _Session:
    """A session with settings of its own on a given context."""

    def __init__(self, context, folder=None):
        self.sparkContext, self.conf = context, {"spark.checkpoint.dir": folder} if folder else {}


def test_shared_folder(spark, tmp_path):
    for text in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}/"):
        assert folders.shared_dir(_Session(spark.sparkContext, text)) == f"file://{tmp_path}"
    one = _Session(spark.sparkContext, str(tmp_path))
    uri = folders.put(one, "x.txt", b"text")
    assert uri.startswith(f"file://{tmp_path}/") and spark.read.text(uri).first()[0] == "text"
    folders.clear(one)
    assert not [x for x in tmp_path.iterdir() if x.name.startswith("tidewright")]
    assert folders.stored(spark.range(3), "some").count() == 3


class _Cluster:
    """A context on a cluster whose settings name no shared folder."""

    master = "spark://host:7077"

    @staticmethod
    def getConf():
        return {}


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        folders.shared_dir(_Session(_Cluster))


def test_quantiles_write_few_values_and_scan_without_expanding(spark, monkeypatch):
    held = []
    kept = features.stored
    monkeypatch.setattr(features, "stored", lambda df, name: held.append(kept(df, name)) or held[-1])
    n = 200_000
    df = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.lit(0.0)).otherwise(((F.col("id") * 7919) % n).cast("double")).alias("x"))
    x = np.sort([0.0 if i % 2 == 0 else float(i * 7919 % n) for i in range(n)])
    places = [0, n // 4, n // 2 + 7, n - 200, n - 1]
    assert features.order_statistics(df, [("x", k) for k in places]) == [x[k] for k in places]
    assert sum(t.count() for t in held) < n / 100


def test_a_wrong_bracket_is_widened(spark):
    x = np.random.default_rng(3).normal(size=5000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    # a sketch this coarse may miss, the counts tell
    assert features.order_statistics(df, [("x", k) for k in (5, 2500, 4990)], 16, 3) == [np.sort(x)[k] for k in (5, 2500, 4990)]


def test_short_chunks_and_tickers_share_a_call(spark, multi):
    for chunk in (1 << 16, 100):
        assert "hand" in indicators.recursive(multi, chunk=chunk)._jdf.queryExecution().toString()
    assert indicators._powers(0.5, 16) is indicators._powers(0.5, 16)
    assert [series.stretches(pa.table({"k": pa.array([None, None, "a", "b", "b"]), "c": [1, 1, 1, 1, 2]}), *keys) for keys in (("k",), ("k", "c"))] == [[(0, 2), (2, 3), (3, 5)], [(0, 2), (2, 3), (3, 4), (4, 5)]]
    few = spark.range(1000).select(series.dealt(10, "id").alias("h")).distinct().count()
    assert few == 1 and spark.range(1000).select(series.dealt(3 * series.CHUNK, "id").alias("h")).distinct().count() == 3


def test_batches_are_sent_on_many_at_a_time_and_bounded():
    n = 1000
    two = np.arange(2, dtype=np.float32).tobytes()
    block = pa.RecordBatch.from_pydict({
        "split": ["train"] * n, "block": list(range(n)), "first": list(range(n)), "size": pa.array([1] * n, pa.int32()), "length": pa.array([2] * n, pa.int32()),
        "pieces": [[{"ticker": "A", "start": 0, "n": 1}]] * n, "features": [two] * n, "targets": [two] * n,
    })

    class Written:
        def mapInArrow(self, f, schema):
            self.sent = list(f(iter([block])))

    written = Written()
    windows.cut_batches(written)
    assert [b.num_rows for b in written.sent] == [windows.SENT_ROWS] * (n // windows.SENT_ROWS) + [n % windows.SENT_ROWS]
    assert [r["batch"] for b in written.sent for r in b.to_pylist()] == list(range(n))


@pytest.mark.parametrize("ascending", [True, False])
def test_average_ranks_take_one_sort(spark, ascending):
    from tidewright.functions.windows import average_rank

    x = [3.0, 1.0, None, 1.0, -0.0, 0.0, float("nan"), 5.0]
    df = spark.createDataFrame([("a", v) for v in x] + [("b", None)], "k string, x double")
    ranked = df.select("k", "x", average_rank(F.col("x"), "k", ascending=ascending).alias("r"))
    want = {3.0: 5.0, 1.0: 3.5, 0.0: 1.5, "nan": 7.0, 5.0: 6.0}
    for r in ranked.collect():
        v = "nan" if r["x"] is not None and math.isnan(r["x"]) else r["x"]
        assert r["r"] == (None if v is None else want[v] if ascending else 8 - want[v])
    assert ranked._jdf.queryExecution().sparkPlan().toString().count("Window [") == 1


def _odd_bars(spark, multi):
    """Bars with a ticker that is null, a null time, repeated times and a null close."""
    odd = multi.limit(40).withColumns({"close": F.when(F.col("bar_ts") != "2024-01-09", F.col("close") + 1), "bar_ts": F.when(F.col("bar_ts") != "2024-01-05", F.col("bar_ts"))})
    return multi.unionByName(odd).unionByName(multi.where("ticker = 'BBB'").withColumns({"ticker": F.lit(None).cast("string"), "close": F.col("close") * 2})).repartition(5)


def _flat(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def test_windows_over_held_tables_shuffle_nothing_and_equal_those_by_ticker(spark, multi):
    odd = _odd_bars(spark, multi).select("ticker", "bar_ts", "close").cache()
    # lags of returns go by the values of one time without a held table, by the closes with one
    single = odd.groupBy("ticker", "bar_ts").agg(F.max("close").alias("close"))
    for df, op in ((odd, features.raw_returns), (single, lambda d: features.forward_targets(features.lagged_returns(features.clipped_returns(d))))):
        held = series.held(df)
        longest = df.groupBy("ticker").count().agg(F.max("count")).first()[0]
        assert series.held(held) is held and series.extent(held) == (df.count(), longest)
        found = op(held)
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        plain = op(df)
        assert _flat(found.select(plain.columns)) == _flat(plain)


def test_lagged_returns_write_closes_alone(spark, monkeypatch):
    written = []
    kept = series.stored
    monkeypatch.setattr(series, "stored", lambda df, *a: written.append(df.columns) or kept(df, *a))
    found = catalog.queries()["lagged_returns"](spark, "/root/testdata/sf0.001")
    assert written == [["ticker", "bar_ts", "close", "__hand", "__at"]]
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("longest", [1 << 16, 100])
def test_all_features_equal_their_parts_and_shuffle_ranks_alone(spark, multi, monkeypatch, longest):
    monkeypatch.setattr(series, "CHUNK", longest)
    df = multi.unionByName(multi.where("ticker = 'BBB'").withColumns({"ticker": F.lit(None).cast("string"), "close": F.col("close") * 2, "sector": F.lit(None).cast("string")}))
    df = df.withColumn("close", F.when(F.col("bar_ts") != "2024-03-05", F.col("close"))).repartition(5)
    found = features.all_features(df)
    if longest > 300:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(bar_ts") == 1 and plan.count("Exchange hashpartitioning") == 2
    parts = indicators.technical(features.dollar_volume_rank(features.dollar_volume_month(features.dollar_volume(df))))
    parts = features.sector_dummies(features.time_cycles(features.forward_targets(features.lagged_returns(features.clipped_returns(parts)))))
    assert found.columns == parts.columns and _flat(found) == _flat(parts)


def test_bars_dealt_by_supplier_are_the_bars(spark):
    a, b = views.bars_d1(spark, "/root/testdata/sf0.001"), views.bars_by_supplier(spark, "/root/testdata/sf0.001")
    assert a.columns == b.columns and _flat(a) == _flat(b)


def test_written_tables_leave_no_shuffle_files_and_the_setting_as_it_was(spark, tmp_path):
    import pathlib
    import time

    files = lambda: {p for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for p in pathlib.Path(d.getPath()).rglob("shuffle_*.data")}
    before = files()
    with folders.shuffles_deleted(spark):
        assert spark.conf.get(folders.CLEANUP) == "true"
    assert folders.stored(spark.range(1000).repartition(3, "id"), "some").count() == 1000
    spark.range(1000).repartition(3, "id").write.parquet(str(tmp_path / "kept"))
    for _ in range(50):
        if len(files() - before) <= 4:
            break
        time.sleep(0.1)
    assert spark.conf.get(folders.CLEANUP) == "false"
    # what is left is the plain write's
    assert 0 < len(files() - before) <= 8


def test_buckets_grow_with_the_rows_where_shuffles_have_few_partitions(spark, single):
    assert series.buckets(spark) == series.buckets(spark, series.BUCKET) == 4 and series.buckets(spark, 9 * series.BUCKET + 1) == 10
    held = series.held(single.select("ticker", "bar_ts", "close"), rows=9 * series.BUCKET + 1)
    assert "SelectedBucketsCount: 10 out of 10" in features.raw_returns(held)._jdf.queryExecution().executedPlan().toString()
    assert _flat(features.raw_returns(held).drop("__hand", "__at")) == _flat(features.raw_returns(single.select("ticker", "bar_ts", "close")))
