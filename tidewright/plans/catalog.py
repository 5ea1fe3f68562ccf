"""Registered queries over the given tables, each with the SQL that DuckDB runs for it where SQL can express it.

Doubles that depend on the order of sums are rounded to 6 places (sums of levels to 4) on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions import series
from tidewright.functions.windows import by_ticker
from tidewright.operators import evaluate, features, fracdiff, indicators, risk, validate, windows
from tidewright.plans import views
from tidewright.sources import bars, folders
from tidewright.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(f.name, places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema])


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(*columns: str, places: int = 6) -> str:
    """Rounded columns; + 0.0 makes -0.0 what Spark's decimal rounding gives."""
    return ", ".join(f"round({c}, {places}) + 0.0 AS {c}" for c in columns)


_BAR_COLS = "open, high, low, close, volume"
_D1, _H1 = f"WITH {views.BARS_D1}", f"WITH {views.BARS_H1}"

# --- sources and sinks


@_query("ohlcv_bars", f"WITH {views.BARS_D1.replace('FROM lineitem)', "FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1997-01-01')")} SELECT l_suppkey AS ticker, bar_ts, {_BAR_COLS} FROM trade_bars")
def ohlcv_bars(spark, sf):
    return views.trades_d1(spark, sf, "1995-01-01", "1997-01-01")


def _wide(spark, sf):
    h = views.bars_h1(spark, sf)
    kinds = ("click", "error", "purchase", "signup", "view")
    return h.groupBy("bar_ts").agg(*[F.max(F.when(F.col("ticker") == k, F.col(c))).alias(f"{c.title()}_{k}") for k in kinds for c in ("open", "close")])


@_query("wide_to_long", f"{_H1} SELECT ticker, bar_ts, close, open FROM bars_h1 WHERE ticker IN ('click', 'error', 'purchase', 'signup', 'view')")
def wide_to_long(spark, sf):
    return bars.wide_to_long(_wide(spark, sf))


def _known(spark, sf):
    """A dimension that lacks every fifth supplier."""
    return views.suppliers(spark, sf).where("s_suppkey % 5 <> 0").select("ticker", "sector", "industry")


def _plain(spark, sf):
    return views.bars_d1(spark, sf).drop("sector", "industry")


_KNOWN = f"""{_D1}, known AS (
  SELECT s_name AS k, r_name, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 5 <> 0)"""


@_query("sector_left_join", f"{_KNOWN} SELECT ticker, bar_ts, close, coalesce(r_name, 'Unknown') AS sector, coalesce(n_name, 'Unknown') AS industry FROM bars_d1 LEFT JOIN known ON ticker = k")
def sector_left_join(spark, sf):
    return bars.sector_left_join(_plain(spark, sf), _known(spark, sf)).select("ticker", "bar_ts", "close", "sector", "industry")


@_query("sector_required_join", f"{_KNOWN} SELECT ticker, bar_ts, close, r_name AS sector, n_name AS industry FROM bars_d1 JOIN known ON ticker = k WHERE r_name IS NOT NULL AND n_name IS NOT NULL")
def sector_required_join(spark, sf):
    return bars.sector_required_join(_plain(spark, sf), _known(spark, sf)).select("ticker", "bar_ts", "close", "sector", "industry")


@_query("sector_dimension", f"{_KNOWN} SELECT t.ticker, r_name AS sector, n_name AS industry FROM (SELECT DISTINCT ticker FROM bars_d1) t LEFT JOIN known ON t.ticker = k")
def sector_dimension(spark, sf):
    return bars.sector_dimension(_known(spark, sf), views.bars_d1(spark, sf))


@_query("ticker_universe", f"{_KNOWN} SELECT ticker, bar_ts, close FROM bars_d1 WHERE ticker IN (SELECT k FROM known)")
def ticker_universe(spark, sf):
    return bars.ticker_universe(_plain(spark, sf), _known(spark, sf)).select("ticker", "bar_ts", "close")


@_query("load_market_data", f"{_KNOWN} SELECT ticker, bar_ts, {_BAR_COLS}, coalesce(r_name, 'Unknown') AS sector, coalesce(n_name, 'Unknown') AS industry FROM bars_d1 LEFT JOIN known ON ticker = k")
def load_market_data(spark, sf):
    return bars.load_market_data(_plain(spark, sf), _known(spark, sf))


@_query("write_parquet_snapshot", f"{_H1} SELECT ticker, bar_ts, {_BAR_COLS} FROM bars_h1")
def write_parquet_snapshot(spark, sf):
    h = views.bars_h1(spark, sf).drop("sector", "industry")
    path = bars.write_parquet_snapshot(h, folders.scratch(spark, "snapshots"), "bars", datetime(2025, 1, 3, 9, 30))
    return spark.read.parquet(path).select("ticker", "bar_ts", "open", "high", "low", "close", "volume")


@_query("stage_tables", f"{_H1} SELECT ticker, count(*) AS n FROM bars_h1 WHERE close > 0 GROUP BY ticker")
def stage_tables(spark, sf):
    base = folders.scratch(spark, "stages")
    raw = bars.stage_table(views.bars_h1(spark, sf), base, "raw")
    valid = bars.stage_table(raw.where("close > 0"), base, "validated")
    return valid.groupBy("ticker").agg(F.count("*").alias("n"))


#: Order of arrival: every seventh bar comes two bars late, and some bars of the second part belong before the first part's end.
_ARRIVED = "2 * rn + CASE WHEN rn % 7 = 0 THEN 5 ELSE 0 END"


@_query(
    "incremental_validate",
    f"""{_H1}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY bar_ts) AS rn FROM bars_h1),
f AS (SELECT ticker, open, high, low, close, bar_ts < lag(bar_ts) OVER (PARTITION BY ticker ORDER BY {_ARRIVED}) AS late FROM r)
SELECT CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR least(open, high, low, close) < 0 THEN 'bad' WHEN coalesce(late, false) THEN 'late' ELSE 'good' END AS side, ticker, count(*) AS n FROM f GROUP BY ALL""",
)
def incremental_validate(spark, sf):
    """All bars in three calls, cut at any place; what an earlier call has seen counts in the next."""
    base = folders.scratch(spark, "incoming")
    w = Window.partitionBy("ticker").orderBy("bar_ts")
    rows = views.bars_h1(spark, sf).select("ticker", "bar_ts", "open", "high", "low", "close", F.row_number().over(w).alias("rn")).withColumn("seq", F.expr(_ARRIVED)).drop("rn")
    rows = folders.stored(rows, "bars")
    for part in ("seq <= 105", "seq > 105 AND seq <= 413", "seq > 413"):
        rows.where(part).write.mode("append").parquet(f"{base}/in")
        incremental.incremental_validate(spark, f"{base}/in", rows.schema, f"{base}/good", f"{base}/bad", f"{base}/checkpoint", chunk=64)
    good = spark.read.schema(rows.schema).parquet(f"{base}/good").select(F.lit("good").alias("side"), "ticker")
    bad = spark.read.schema(T.StructType([*rows.schema, T.StructField("reason", T.StringType())])).parquet(f"{base}/bad")
    bad = bad.select(F.when(F.col("reason") == "order", "late").otherwise("bad").alias("side"), "ticker")
    return good.union(bad).groupBy("side", "ticker").agg(F.count("*").alias("n"))


# --- validation


def _schema_sql(have: tuple[str, ...]) -> str:
    """Report rows of the schema; the types of the columns that are there are right."""
    required = [f.name for f in validate.BAR_SCHEMA]
    rows = [("missing", c, c not in have) for c in required] + [("type", c, False) for c in required if c in have]
    return " UNION ALL ".join(f"SELECT '{check}' AS \"check\", '{c}' AS \"column\", CAST({int(bad)} AS BIGINT) AS n_bad, CAST(1 AS BIGINT) AS n_rows, {str(bad).lower()} AS failed" for check, c, bad in rows)


_EMPTY = "SELECT 'empty' AS \"check\", '' AS \"column\", CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_bad, CAST(least(count(*), 1) AS BIGINT) AS n_rows, count(*) = 0 AS failed FROM bars_d1"


@_query("validate_schema", f"{_D1} {_schema_sql(('bar_ts', 'ticker', *validate.PRICES))} UNION ALL {_EMPTY}")
def validate_schema(spark, sf):
    return validate.validate_schema(views.bars_d1(spark, sf).drop("volume"))


_EVENT_NULLS = "SELECT 'nulls' AS \"check\", c AS \"column\", n_bad, n_rows, n_rows = 0 OR n_bad > n_rows * 0.001 AS failed FROM (SELECT '{0}' AS c, count(*) - count({0}) AS n_bad, count(*) AS n_rows FROM {1})"


@_query("validate_nulls", f"WITH {views.PREDS} " + " UNION ALL ".join(_EVENT_NULLS.format(c, "ahead") for c in ("actual", "p1", "p2", "p3")))
def validate_nulls(spark, sf):
    return validate.validate_nulls(_model_rows(spark, sf), ["actual", "p1", "p2", "p3"])


@_query("validate_prices", f"{_D1} " + " UNION ALL ".join(f"SELECT 'prices' AS \"check\", '{c}' AS \"column\", count(*) FILTER (WHERE {c} < 950) AS n_bad, count(*) AS n_rows, count(*) FILTER (WHERE {c} < 950) > 0 AS failed FROM bars_d1" for c in validate.PRICES))
def validate_prices(spark, sf):
    return validate.validate_prices(views.bars_d1(spark, sf), 950.0)


@_query(
    "validate_monotonic",
    """WITH o AS (SELECT o_orderdate < lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS late FROM orders)
SELECT 'monotonic' AS "check", 'o_orderdate' AS "column", count(*) FILTER (WHERE late) AS n_bad, count(*) AS n_rows, count(*) FILTER (WHERE late) > 0 AS failed FROM o""",
)
def validate_monotonic(spark, sf):
    return validate.validate_monotonic(views.table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderdate")


_NO_DETAIL = "'' AS detail"


@_query(
    "validation_report",
    f"""{_D1}, m AS (SELECT *, bar_ts < lag(bar_ts) OVER (PARTITION BY ticker ORDER BY close, bar_ts) AS late FROM bars_d1),
firsts AS (SELECT coalesce(string_agg(ticker || ' ' || strftime(bar_ts, '%Y-%m-%d'), ', ' ORDER BY close, bar_ts, ticker), '') AS d FROM (SELECT * FROM m WHERE late ORDER BY close, bar_ts, ticker LIMIT 3)),
cheap AS (SELECT coalesce(string_agg(ticker || ' ' || strftime(bar_ts, '%Y-%m-%d'), ', ' ORDER BY close, bar_ts, ticker), '') AS d FROM (SELECT * FROM m WHERE least(open, high, low, close) < 950 ORDER BY close, bar_ts, ticker LIMIT 5))
"""
    + " UNION ALL ".join(
        [f"SELECT *, {_NO_DETAIL} FROM ({_schema_sql(('bar_ts', 'ticker', *validate.PRICES, 'volume'))})", f"SELECT *, {_NO_DETAIL} FROM ({_EMPTY})"]
        + [f"SELECT 'nulls' AS \"check\", '{c}' AS \"column\", count(*) - count({c}) AS n_bad, count(*) AS n_rows, count(*) = 0 OR count(*) - count({c}) > count(*) * 0.001 AS failed, {_NO_DETAIL} FROM m" for c in validate.PRICES]
        + [f"SELECT 'prices', '{c}', count(*) FILTER (WHERE {c} < 950), count(*), count(*) FILTER (WHERE {c} < 950) > 0, CASE WHEN count(*) FILTER (WHERE {c} < 950) > 0 THEN (SELECT d FROM cheap) ELSE '' END FROM m" for c in validate.PRICES]
        + ["SELECT 'monotonic', 'bar_ts', count(*) FILTER (WHERE late), count(*), count(*) FILTER (WHERE late) > 0, (SELECT d FROM firsts) FROM m"]
    ),
)
def validation_report(spark, sf):
    b = views.bars_d1(spark, sf).withColumn("seq", F.struct("close", "bar_ts"))
    shown = F.transform("detail", lambda x: F.concat(F.get_json_object(x, "$.ticker"), F.lit(" "), F.substring(F.get_json_object(x, "$.bar_ts"), 1, 10)))
    return validate.validation_report(b, "seq", min_price=950.0).withColumn("detail", F.array_join(shown, ", "))


@_query("finite_check", f"WITH {views.PREDS} SELECT ticker, CAST(sum((actual IS NULL)::INT + (p1 IS NULL)::INT + (p2 IS NULL)::INT) AS BIGINT) AS n_null, CAST(sum(coalesce(isnan(actual), false)::INT + coalesce(isnan(p1), false)::INT + coalesce(isnan(p2), false)::INT) AS BIGINT) AS n_nan FROM ahead GROUP BY ticker")
def finite_check(spark, sf):
    return validate.finite_check(_model_rows(spark, sf), ["actual", "p1", "p2"])


# --- features

_VOL = f"""{_D1}, dv AS (SELECT *, close * volume AS dollar_vol FROM bars_d1),
dm AS (SELECT *, CASE WHEN count(dollar_vol) OVER w = 21 THEN avg(dollar_vol) OVER w END AS dollar_vol_1m FROM dv WINDOW w AS (PARTITION BY ticker ORDER BY bar_ts ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
dr AS (SELECT *, CASE WHEN dollar_vol_1m IS NOT NULL THEN rank() OVER (PARTITION BY bar_ts ORDER BY dollar_vol_1m DESC NULLS LAST) + (count(*) OVER (PARTITION BY bar_ts, dollar_vol_1m) - 1) / 2.0::DOUBLE END AS dollar_vol_rank FROM dm)"""


def _month(spark, sf):
    return features.dollar_volume_month(features.dollar_volume(views.bars_d1(spark, sf)))


@_query("dollar_volume", f"{_VOL} SELECT ticker, bar_ts, dollar_vol FROM dv")
def dollar_volume(spark, sf):
    return features.dollar_volume(views.bars_d1(spark, sf)).select("ticker", "bar_ts", "dollar_vol")


@_query("dollar_volume_month", f"{_VOL} SELECT ticker, bar_ts, CAST(CAST(dollar_vol_1m AS FLOAT) AS DOUBLE) AS dollar_vol_1m FROM dm")
def dollar_volume_month(spark, sf):
    return _month(spark, sf).select("ticker", "bar_ts", F.col("dollar_vol_1m").cast("float").cast("double").alias("dollar_vol_1m"))


@_query("dollar_volume_rank", f"{_VOL} SELECT ticker, bar_ts, dollar_vol_rank FROM dr")
def dollar_volume_rank(spark, sf):
    return features.dollar_volume_rank(_month(spark, sf)).select("ticker", "bar_ts", "dollar_vol_rank")


@_query("liquid_universe", f"{_VOL} SELECT ticker, bar_ts, dollar_vol_rank FROM dr WHERE dollar_vol_rank < 20")
def liquid_bars(spark, sf):
    return features.liquid_universe(features.dollar_volume_rank(_month(spark, sf)), 20).select("ticker", "bar_ts", "dollar_vol_rank")


@_query("log_price", f"{_D1} SELECT ticker, bar_ts, round(ln(close), 6) AS log_close FROM bars_d1")
def log_price(spark, sf):
    return rounded(features.log_price(views.bars_d1(spark, sf)).select("ticker", "bar_ts", "log_close"))


_LAGS = features.LAGS
_RAW = f"{_D1}, raw AS MATERIALIZED (SELECT *, " + ", ".join(f"close / lag(close, {n}) OVER (PARTITION BY ticker ORDER BY bar_ts) - 1 AS raw_{n}b" for n in _LAGS) + " FROM bars_d1)"
_RET = _RAW + ", sorted AS MATERIALIZED (SELECT " + ", ".join(f"list_sort(list(raw_{n}b) FILTER (WHERE raw_{n}b IS NOT NULL)) AS s_{n}" for n in _LAGS) + " FROM raw), bounds AS MATERIALIZED (SELECT " + ", ".join(f"s_{n}[CAST(round((len(s_{n}) - 1) * {q}) AS BIGINT) + 1] AS {side}_{n}" for n in _LAGS for side, q in (("lo", "0.001::DOUBLE"), ("hi", "0.999::DOUBLE"))) + " FROM sorted), ret AS (SELECT raw.*, " + ", ".join(f"CASE WHEN raw_{n}b IS NOT NULL THEN pow(1 + least(greatest(raw_{n}b, lo_{n}), hi_{n}), 1.0::DOUBLE / {n}) - 1 END AS return_{n}b" for n in _LAGS) + " FROM raw CROSS JOIN bounds)"


def _closes(spark, sf) -> DataFrame:
    """What returns are made of, held, so that all their windows need no shuffle."""
    return series.held(views.bars_by_supplier(spark, sf).select("ticker", "bar_ts", "close"), rows=views.items(spark, sf))


@_query("clipped_returns", f"{_RET} SELECT ticker, bar_ts, {_r(*[f'return_{n}b' for n in _LAGS])} FROM ret")
def clipped_returns(spark, sf):
    return rounded(features.clipped_returns(_closes(spark, sf)).select("ticker", "bar_ts", *[f"return_{n}b" for n in _LAGS]))


_LINEAR = ", ".join(f"quantile_cont(raw_{n}b, {q}) AS {side}_{n}" for n in (1, 5) for side, q in (("lo", 0.01), ("hi", 0.99)))


@_query("clipped_returns_linear", f"{_RAW}, bounds AS (SELECT {_LINEAR} FROM raw) SELECT ticker, bar_ts, " + ", ".join(f"round(CASE WHEN raw_{n}b IS NOT NULL THEN pow(1 + least(greatest(raw_{n}b, lo_{n}), hi_{n}), 1.0::DOUBLE / {n}) - 1 END, 6) AS return_{n}b" for n in (1, 5)) + " FROM raw CROSS JOIN bounds")
def clipped_returns_linear(spark, sf):
    return rounded(features.clipped_returns(_closes(spark, sf), (1, 5), 0.01, "linear").select("ticker", "bar_ts", "return_1b", "return_5b"))


_LAGGED = [(n, t) for n in features.LAGGED for t in features.LOOKBACKS]


@_query("lagged_returns", f"{_RET} SELECT ticker, bar_ts, " + ", ".join(f"round(lag(return_{n}b, {n * t}) OVER (PARTITION BY ticker ORDER BY bar_ts), 6) AS return_{n}b_lag{t}" for n, t in _LAGGED) + " FROM ret")
def lagged_returns(spark, sf):
    return rounded(features.lagged_returns(features.clipped_returns(_closes(spark, sf))).select("ticker", "bar_ts", *[f"return_{n}b_lag{t}" for n, t in _LAGGED]))


@_query("forward_targets", f"{_RET} SELECT ticker, bar_ts, " + ", ".join(f"round(lead(return_{h}b, {h}) OVER (PARTITION BY ticker ORDER BY bar_ts), 6) AS target_{h}b" for h in features.HORIZONS) + " FROM ret")
def forward_targets(spark, sf):
    return rounded(features.forward_targets(features.clipped_returns(_closes(spark, sf))).select("ticker", "bar_ts", *[f"target_{h}b" for h in features.HORIZONS]))


_CYCLE = ", ".join(f"round({f}(2 * pi() * {x} / {p}), 6) + 0.0 AS {n}_{f}" for n, x, p in (("month", "month(bar_ts)", 12), ("weekday", "isodow(bar_ts)", 7), ("hour", "hour(bar_ts)", 24)) for f in ("sin", "cos"))


@_query("time_cycles", f"{_H1} SELECT ticker, bar_ts, CAST(year(bar_ts) - 2020 AS INTEGER) AS year, {_CYCLE} FROM bars_h1")
def time_cycles(spark, sf):
    return rounded(features.time_cycles(views.bars_h1(spark, sf), "1h").select("ticker", "bar_ts", "year", *[f"{n}_{f}" for n in ("month", "weekday", "hour") for f in ("sin", "cos")]))


#: Names of the region table but the first in order.
_REGIONS = ("AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def _flag(column: str, value) -> str:
    return f"CAST({column} = {value!r} AS INTEGER)"


@_query("sector_dummies", f"{_D1} SELECT ticker, bar_ts, close, " + ", ".join(f'{_flag("sector", r)} AS "sector_{r}"' for r in _REGIONS) + " FROM bars_d1")
def sector_dummies(spark, sf):
    """The columns of dummies follow the sectors in the data, all but the first."""
    return features.sector_dummies(views.bars_d1(spark, sf)).drop("open", "high", "low", "volume")


#: Years of the line items but the first.
_YEARS = range(1996, 2002)


@_query("calendar_dummies", f"{_D1} SELECT ticker, bar_ts, close, " + ", ".join([*(f"{_flag('year(bar_ts)', y)} AS year_{y}" for y in _YEARS), *(f"{_flag('month(bar_ts)', m)} AS month_{m}" for m in range(2, 13)), *(f'{_flag("sector", r)} AS "{r}"' for r in _REGIONS)]) + " FROM bars_d1")
def calendar_dummies(spark, sf):
    return features.calendar_dummies(views.bars_d1(spark, sf)).drop("open", "high", "low", "volume")


@_query("model_frame", f"WITH {views.PREDS} SELECT ticker, bar_ts, {_r('p1', 'p2', 'p3', 'actual')} FROM ahead WHERE p1 IS NOT NULL AND p2 IS NOT NULL AND p3 IS NOT NULL AND actual IS NOT NULL")
def model_frame(spark, sf):
    return rounded(features.model_frame(_model_rows(spark, sf), ["actual"]))


# --- indicators


def _ema(name: str, source: str, value: str, n: int, seed_rn: int, out_rn: int) -> str:
    """An EMA as a recursion on row numbers, from the mean of the n rows that end at seed_rn."""
    return f"""{name}_seed AS (SELECT ticker, CASE WHEN count({value}) = {n} THEN avg({value}) END AS y FROM {source} WHERE rn BETWEEN {seed_rn - n + 1} AND {seed_rn} GROUP BY ticker HAVING count(*) = {n}),
{name} AS (
  SELECT ticker, CAST({seed_rn} AS BIGINT) AS rn, y FROM {name}_seed
  UNION ALL SELECT s.ticker, s.rn, e.y + (2.0::DOUBLE / {n + 1}) * (s.{value} - e.y) FROM {name} e JOIN {source} s ON s.ticker = e.ticker AND s.rn = e.rn + 1)"""


_RN = f"WITH RECURSIVE {views.BARS_D1}, b AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY bar_ts) AS rn FROM bars_d1)"
_MACD = f"{_RN}, {_ema('fast', 'b', 'close', 12, 26, 26)}, {_ema('slow', 'b', 'close', 26, 26, 26)}, m AS (SELECT f.ticker, f.rn, f.y - s.y AS macd, f.rn - 25 AS k FROM fast f JOIN slow s ON f.ticker = s.ticker AND f.rn = s.rn)"
_SIGNAL = _MACD + ", mk AS (SELECT ticker, k AS rn, macd FROM m), " + _ema("sig", "mk", "macd", 9, 9, 9)


def _wilder(name: str, source: str, value: str) -> str:
    return f"""{name}_seed AS (SELECT ticker, CASE WHEN count({value}) = 14 THEN avg({value}) END AS y FROM {source} WHERE rn BETWEEN 2 AND 15 GROUP BY ticker HAVING count(*) = 14),
{name} AS (
  SELECT ticker, CAST(15 AS BIGINT) AS rn, y FROM {name}_seed
  UNION ALL SELECT s.ticker, s.rn, e.y + (s.{value} - e.y) / 14 FROM {name} e JOIN {source} s ON s.ticker = e.ticker AND s.rn = e.rn + 1)"""


_STEP = f"{_RN}, st AS (SELECT ticker, rn, greatest(close - lag(close) OVER w, 0) AS up, greatest(lag(close) OVER w - close, 0) AS down, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM b WINDOW w AS (PARTITION BY ticker ORDER BY rn))"


@_query("ema5", f"{_RN}, {_ema('e5', 'b', 'close', 5, 5, 5)} SELECT b.ticker, bar_ts, round(y, 6) AS ema5 FROM b LEFT JOIN e5 ON b.ticker = e5.ticker AND b.rn = e5.rn")
def ema5(spark, sf):
    return rounded(indicators.recursive(views.bars_d1(spark, sf), ("ema5",)).select("ticker", "bar_ts", "ema5"))


@_query("macd", f"{_MACD} SELECT b.ticker, bar_ts, round(macd, 6) AS macd FROM b LEFT JOIN m ON b.ticker = m.ticker AND b.rn = m.rn AND m.rn >= 34")
def macd(spark, sf):
    return rounded(indicators.recursive(views.bars_d1(spark, sf), ("macd",)).select("ticker", "bar_ts", "macd"))


@_query("macd_signal", f"{_SIGNAL} SELECT b.ticker, bar_ts, round(y, 6) AS macd_signal FROM b LEFT JOIN sig ON b.ticker = sig.ticker AND b.rn = sig.rn + 25")
def macd_signal(spark, sf):
    return rounded(indicators.recursive(views.bars_d1(spark, sf), ("macd_signal",)).select("ticker", "bar_ts", "macd_signal"))


@_query("rsi", f"{_STEP}, {_wilder('u', 'st', 'up')}, {_wilder('d', 'st', 'down')} SELECT b.ticker, bar_ts, round(CASE WHEN u.y + d.y = 0 THEN 0 ELSE 100 * u.y / (u.y + d.y) END, 6) AS rsi FROM b LEFT JOIN u ON b.ticker = u.ticker AND b.rn = u.rn LEFT JOIN d ON b.ticker = d.ticker AND b.rn = d.rn")
def rsi(spark, sf):
    return rounded(indicators.recursive(views.bars_d1(spark, sf), ("rsi",)).select("ticker", "bar_ts", "rsi"))


@_query("atr_zscore", f"{_STEP}, {_wilder('a', 'st', 'tr')} SELECT b.ticker, bar_ts, round((y - avg(y) OVER (PARTITION BY b.ticker)) / stddev_samp(y) OVER (PARTITION BY b.ticker), 6) AS atr_z FROM b LEFT JOIN a ON b.ticker = a.ticker AND b.rn = a.rn")
def atr_zscore(spark, sf):
    return rounded(indicators.atr_zscore(views.bars_d1(spark, sf)))


@_query("macd_zscore", f"{_MACD}, k AS (SELECT b.ticker, bar_ts, macd FROM b LEFT JOIN m ON b.ticker = m.ticker AND b.rn = m.rn AND m.rn >= 34) SELECT ticker, bar_ts, round((macd - avg(macd) OVER w) / stddev_samp(macd) OVER w, 6) AS macd_z FROM k WINDOW w AS (PARTITION BY ticker)")
def macd_zscore(spark, sf):
    return rounded(indicators.macd_zscore(views.bars_d1(spark, sf)))


_GAPS = f"""WITH RECURSIVE {views.BARS_GAPS}, firsts AS (SELECT ticker, min(bar_ts) AS f FROM gaps WHERE close IS NOT NULL GROUP BY ticker),
b AS (SELECT g.*, row_number() OVER (PARTITION BY g.ticker ORDER BY bar_ts) AS rn FROM gaps g JOIN firsts ON firsts.ticker = g.ticker AND bar_ts >= f)"""
_GAP_STEP = """step AS (SELECT ticker, rn, high, low, lag(close) OVER w AS c, close - lag(close) OVER w AS s FROM b WINDOW w AS (PARTITION BY ticker ORDER BY rn)),
st AS (SELECT ticker, rn, CASE WHEN s > 0 THEN s ELSE s * 0 END AS up, CASE WHEN s < 0 THEN -s ELSE s * 0 END AS down, CASE WHEN c IS NOT NULL AND s IS NOT NULL THEN greatest(high - low, abs(high - c), abs(low - c)) END AS tr FROM step)"""


@_query(
    "indicators_with_gaps",
    f"""{_GAPS}, {_ema('e5', 'b', 'close', 5, 5, 5)}, {_ema('fast', 'b', 'close', 12, 26, 26)}, {_ema('slow', 'b', 'close', 26, 26, 26)},
m AS (SELECT f.ticker, f.rn, f.y - s.y AS macd FROM fast f JOIN slow s ON f.ticker = s.ticker AND f.rn = s.rn), mk AS (SELECT ticker, rn - 25 AS rn, macd FROM m), {_ema('sig', 'mk', 'macd', 9, 9, 9)},
{_GAP_STEP}, {_wilder('u', 'st', 'up')}, {_wilder('d', 'st', 'down')}, {_wilder('a', 'st', 'tr')}
SELECT g.ticker, g.bar_ts, round(e5.y, 6) AS ema5, round(macd, 6) AS macd, round(sig.y, 6) AS macd_signal, round(CASE WHEN u.y + d.y = 0 THEN 0 ELSE 100 * u.y / (u.y + d.y) END, 6) AS rsi, round(a.y, 6) AS atr
FROM gaps g LEFT JOIN b ON b.ticker = g.ticker AND b.bar_ts = g.bar_ts LEFT JOIN e5 ON e5.ticker = b.ticker AND e5.rn = b.rn LEFT JOIN m ON m.ticker = b.ticker AND m.rn = b.rn AND m.rn >= 34
LEFT JOIN sig ON sig.ticker = b.ticker AND sig.rn = b.rn - 25 LEFT JOIN u ON u.ticker = b.ticker AND u.rn = b.rn LEFT JOIN d ON d.ticker = b.ticker AND d.rn = b.rn LEFT JOIN a ON a.ticker = b.ticker AND a.rn = b.rn""",
)
def indicators_with_gaps(spark, sf):
    """All recursive indicators of series that lack closes, with every series dealt to tasks in chunks of 100 rows."""
    return rounded(indicators.recursive(views.bars_gaps(spark, sf), chunk=100).drop("rn"))


@_query(
    "windows_in_chunks",
    f"""{_VOL}, k AS (SELECT ticker, bar_ts, close, count(close) OVER w AS n, avg(close) OVER w AS m, stddev_pop(close) OVER w AS s, lead(close, 21) OVER t AS ahead, lag(close, 63) OVER t AS back
  FROM bars_d1 WINDOW w AS (PARTITION BY ticker ORDER BY bar_ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), t AS (PARTITION BY ticker ORDER BY bar_ts))
SELECT k.ticker, k.bar_ts, CAST(CAST(dollar_vol_1m AS FLOAT) AS DOUBLE) AS dollar_vol_1m, CASE WHEN n = 20 AND 1 + (m + 2 * s - k.close) / (m + 2 * s) > 0 THEN round(ln(1 + (m + 2 * s - k.close) / (m + 2 * s)), 6) END AS bb_high, ahead, round(k.close / back - 1, 6) + 0.0 AS raw_63b
FROM k JOIN dm ON dm.ticker = k.ticker AND dm.bar_ts = k.bar_ts""",
)
def windows_in_chunks(spark, sf):
    """Windows that look back 63 rows and ahead 21, with every series dealt to tasks in chunks of 100 rows."""

    def op(df):
        df = features.raw_returns(indicators.bollinger_distance(features.dollar_volume_month(features.dollar_volume(df))), (63,))
        return df.withColumn("ahead", F.lead("close", 21).over(by_ticker(df)))

    df = series.over_chunks(views.bars_d1(spark, sf).select("ticker", "bar_ts", "close", "volume"), op, before=63, after=21, rows=100)
    return df.select("ticker", "bar_ts", F.col("dollar_vol_1m").cast("float").cast("double").alias("dollar_vol_1m"), F.round("bb_high", 6).alias("bb_high"), "ahead", F.round("raw_63b", 6).alias("raw_63b"))


@_query(
    "cdl2crows",
    f"""{_D1}, k AS (SELECT ticker, bar_ts, open, close, lag(open, 2) OVER w AS o1, lag(close, 2) OVER w AS c1, lag(open) OVER w AS o2, lag(close) OVER w AS c2,
  avg(abs(close - open)) OVER (PARTITION BY ticker ORDER BY bar_ts ROWS BETWEEN 12 PRECEDING AND 3 PRECEDING) AS body, row_number() OVER w AS rn FROM bars_d1 WINDOW w AS (PARTITION BY ticker ORDER BY bar_ts))
SELECT ticker, bar_ts, CASE WHEN rn > 12 AND c1 > o1 AND c1 - o1 > body AND c2 < o2 AND least(o2, c2) > greatest(o1, c1) AND close < open AND open < o2 AND open > c2 AND close > o1 AND close < c1 THEN -100 ELSE 0 END AS cdl2crows FROM k""",
)
def cdl2crows(spark, sf):
    return indicators.cdl2crows(views.bars_d1(spark, sf)).select("ticker", "bar_ts", "cdl2crows")


@_query("weighted_close", f"{_D1} SELECT ticker, bar_ts, (high + low + 2 * close) / 4 AS wclprice FROM bars_d1")
def weighted_close(spark, sf):
    return indicators.weighted_close(views.bars_d1(spark, sf)).select("ticker", "bar_ts", "wclprice")


@_query(
    "bollinger_distance",
    f"""{_D1}, k AS (SELECT ticker, bar_ts, close, count(close) OVER w AS n, avg(close) OVER w AS m, stddev_pop(close) OVER w AS s FROM bars_d1 WINDOW w AS (PARTITION BY ticker ORDER BY bar_ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT ticker, bar_ts, CASE WHEN n = 20 AND 1 + (m + 2 * s - close) / (m + 2 * s) > 0 THEN round(ln(1 + (m + 2 * s - close) / (m + 2 * s)), 6) END AS bb_high, CASE WHEN n = 20 AND 1 + (close - (m - 2 * s)) / close > 0 THEN round(ln(1 + (close - (m - 2 * s)) / close), 6) END AS bb_low FROM k""",
)
def bollinger_distance(spark, sf):
    return rounded(indicators.bollinger_distance(views.bars_d1(spark, sf)).select("ticker", "bar_ts", "bb_high", "bb_low"))


def _parts(sql: str, first: str) -> str:
    """The common table expressions of sql from the one named first on."""
    return sql[sql.index(f"{first} AS") :]


_CROWS = """crows AS (SELECT ticker, bar_ts, open, close, lag(open, 2) OVER w AS o1, lag(close, 2) OVER w AS c1, lag(open) OVER w AS o2, lag(close) OVER w AS c2,
  avg(abs(close - open)) OVER (PARTITION BY ticker ORDER BY bar_ts ROWS BETWEEN 12 PRECEDING AND 3 PRECEDING) AS body, row_number() OVER w AS rn FROM bars_d1 WINDOW w AS (PARTITION BY ticker ORDER BY bar_ts))"""
_TWO_CROWS = "CASE WHEN k.rn > 12 AND c1 > o1 AND c1 - o1 > body AND c2 < o2 AND least(o2, c2) > greatest(o1, c1) AND k.close < k.open AND k.open < o2 AND k.open > c2 AND k.close > o1 AND k.close < c1 THEN -100 ELSE 0 END AS cdl2crows"
_FEATURE_SQL = f"""{_MACD}, {_ema('e5', 'b', 'close', 5, 5, 5)}, {_parts(_VOL, 'dv')}, {_parts(_RET, 'raw')}, {_CROWS},
lagged AS (SELECT *, {", ".join(f"lag(return_{n}b, {n * t}) OVER w AS return_{n}b_lag{t}" for n, t in _LAGGED)}, {", ".join(f"lead(return_{h}b, {h}) OVER w AS target_{h}b" for h in features.HORIZONS)} FROM ret WINDOW w AS (PARTITION BY ticker ORDER BY bar_ts))
SELECT b.ticker, b.bar_ts, b.open, b.high, b.low, b.close, b.volume, dollar_vol, dollar_vol_rank, (b.high + b.low + 2 * b.close) / 4 AS wclprice, CAST(CAST(dollar_vol_1m AS FLOAT) AS DOUBLE) AS dollar_vol_1m, {", ".join(f"round({c}, 6) + 0.0 AS {n}" for c, n in [("e5.y", "ema5"), ("macd", "macd"), *((f"l.return_{n}b", f"return_{n}b") for n in _LAGS), *((f"return_{n}b_lag{t}", f"return_{n}b_lag{t}") for n, t in _LAGGED), *((f"target_{h}b", f"target_{h}b") for h in features.HORIZONS)])},
  {_TWO_CROWS}, CAST(year(b.bar_ts) - 2020 AS INTEGER) AS year, {", ".join(f"round({f}(2 * pi() * {x} / {p}), 6) + 0.0 AS {n}_{f}" for n, x, p in (("month", "month(b.bar_ts)", 12), ("weekday", "isodow(b.bar_ts)", 7)) for f in ("sin", "cos"))},
  {", ".join(f'CAST(b.sector = {chr(39)}{r}{chr(39)} AS INTEGER) AS "sector_{r}"' for r in _REGIONS)}
FROM b JOIN dr ON dr.ticker = b.ticker AND dr.bar_ts = b.bar_ts JOIN lagged l ON l.ticker = b.ticker AND l.bar_ts = b.bar_ts JOIN crows k ON k.ticker = b.ticker AND k.bar_ts = b.bar_ts
LEFT JOIN e5 ON e5.ticker = b.ticker AND e5.rn = b.rn LEFT JOIN m ON m.ticker = b.ticker AND m.rn = b.rn AND m.rn >= 34"""


@_query("all_features", _FEATURE_SQL)
def all_features(spark, sf):
    exact = ("open", "high", "low", "close", "volume", "dollar_vol", "dollar_vol_1m", "dollar_vol_rank", "wclprice")  # as they come on both sides
    df = features.all_features(views.bars_by_supplier(spark, sf), rows=views.items(spark, sf)).withColumn("dollar_vol_1m", F.col("dollar_vol_1m").cast("float").cast("double"))
    return df.select(*[F.round(f.name, 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) and f.name not in exact else F.col(f"`{f.name}`") for f in df.schema])


# --- fractional differencing

_THRESHOLD = 0.001
_WEIGHTS = """w AS (
  SELECT d, 0 AS k, 1.0::DOUBLE AS w FROM ds
  UNION ALL SELECT d, k + 1, -w * (d - (k + 1) + 1) / (k + 1) FROM w WHERE k + 1 < 1000 AND abs(-w * (d - (k + 1) + 1) / (k + 1)) >= {t})"""
_WEIGHTS_2 = """w2 AS (
  SELECT d, 0 AS k, 1.0::DOUBLE AS w FROM ds2
  UNION ALL SELECT d, k + 1, -w * (d - (k + 1) + 1) / (k + 1) FROM w2 WHERE k + 1 < 1000 AND abs(-w * (d - (k + 1) + 1) / (k + 1)) >= {t})"""


def _orders(spark, sf):
    return views.table(spark, sf, "supplier").select(((F.col("s_suppkey") % 21) / 20.0).alias("d"))


@_query("ffd_weights", f"WITH RECURSIVE ds AS (SELECT DISTINCT (s_suppkey % 21) / 20.0::DOUBLE AS d FROM supplier), {_WEIGHTS.format(t=0.001)} SELECT d, CAST(k AS INTEGER) AS k, round(w, 9) AS w FROM w")
def ffd_weights(spark, sf):
    return fracdiff.ffd_weights(_orders(spark, sf)).select("d", "k", F.round("w", 9).alias("w"))


#: Rows that the longest weights reach over, with some to spare.
_FRAME = 100
assert max(len(fracdiff.weights(k / 200, _THRESHOLD)) for k in range(20, 201)) <= _FRAME


def _differenced(ds: str, source: str = "levels", tag: str = "", wanted: str = "", frame: int = _FRAME) -> str:
    """SQL: the series of each order in ds, full frames only: an inner product of the last values and the weights."""
    only = f"JOIN {wanted} v ON v.ticker = h.ticker AND v.d = g.d" if wanted else ""
    return f"""ws{tag} AS (SELECT d, list(w ORDER BY k DESC) AS ws, count(*) AS n FROM w{tag} GROUP BY d),
held{tag} AS (SELECT ticker, bar_ts, rn, list(x) OVER (PARTITION BY ticker ORDER BY rn ROWS BETWEEN {frame - 1} PRECEDING AND CURRENT ROW) AS h FROM {source}),
fd{tag} AS (SELECT h.ticker, h.bar_ts, h.rn, g.d, list_inner_product(list_slice(h.h, len(h.h) - g.n + 1, len(h.h)), g.ws) AS x FROM held{tag} h JOIN ws{tag} g ON h.rn >= g.n {only})"""


def _adf(source: str, tag: str = "") -> str:
    """SQL: the unit-root statistic of each (ticker, d) of source, as adf with the tag."""
    return f"""lagged{tag} AS (
  SELECT ticker, d, x - lag(x) OVER w AS y, lag(x) OVER w - avg(x) OVER (PARTITION BY ticker, d) AS l, lag(x) OVER w - lag(x, 2) OVER w AS z FROM {source} WINDOW w AS (PARTITION BY ticker, d ORDER BY rn)),
s{tag} AS (
  SELECT ticker, d, count(*) AS m, count(z) AS n, regr_sxx(y, l) AS lla, regr_sxy(y, l) AS lya, regr_syy(y, l) AS yya,
    regr_sxx(y, l) FILTER (WHERE z IS NOT NULL) AS ll, regr_sxy(y, l) FILTER (WHERE z IS NOT NULL) AS ly, regr_syy(y, l) FILTER (WHERE z IS NOT NULL) AS yy,
    regr_sxx(y, z) AS zz, regr_sxy(y, z) AS zy, regr_sxy(l, z) AS lz FROM lagged{tag} WHERE y IS NOT NULL GROUP BY ticker, d),
t{tag} AS (SELECT *, (zz * ly - lz * zy) / (ll * zz - lz * lz) AS b, (ll * zy - lz * ly) / (ll * zz - lz * lz) AS g, ll * zz - lz * lz AS det FROM s{tag}),
u{tag} AS (SELECT *, yy - b * ly - g * zy AS ssr1, yy - ly * ly / ll AS ssr0 FROM t{tag}),
adf{tag} AS (
  SELECT ticker, d, m + 1 AS n, CASE WHEN n * ln(ssr1 / n) + 6 < n * ln(ssr0 / n) + 4 THEN 1 ELSE 0 END AS lag,
    CASE WHEN n * ln(ssr1 / n) + 6 < n * ln(ssr0 / n) + 4 THEN b / sqrt(ssr1 / (n - 3) * zz / det) ELSE lya / lla / sqrt((yya - lya * lya / lla) / (m - 2) / lla) END AS stat FROM u{tag})"""


_CRIT = fracdiff.critical(0.05)
_GRID = fracdiff.grid()
_GRID_SQL = ", ".join(f"({d!r}::DOUBLE)" for d in _GRID)


def _search(given: str, source: str = "levels") -> str:
    """SQL: the least passing order of the grid for each ticker of source, as mind."""
    return f"WITH RECURSIVE {given}, ds AS (SELECT * FROM (VALUES {_GRID_SQL}) v(d)), {_WEIGHTS.format(t=_THRESHOLD)}, {_differenced('ds', source)}, {_adf('fd')}, mind AS MATERIALIZED (SELECT t.ticker, coalesce(min(adf.d) FILTER (WHERE stat < {_CRIT!r} AND n >= 50), 1.0::DOUBLE) AS d FROM (SELECT DISTINCT ticker FROM {source}) t LEFT JOIN adf ON adf.ticker = t.ticker GROUP BY t.ticker)"


_SEARCH = _search(views.LEVELS)
#: The second pass: ten even steps from 0.1 up to the grid's order of each ticker.
_REFINED = f"""{_SEARCH}, wanted AS MATERIALIZED (SELECT DISTINCT ticker, 0.1::DOUBLE + (d - 0.1::DOUBLE) * CAST(i AS DOUBLE) / 9 AS d FROM mind CROSS JOIN range(10) r(i)),
ds2 AS (SELECT DISTINCT d FROM wanted), {_WEIGHTS_2.format(t=_THRESHOLD)}, {_differenced('ds2', 'levels', '2', 'wanted')}, {_adf('fd2', '2')},
fine AS (SELECT mind.ticker, round(coalesce(min(adf2.d) FILTER (WHERE stat < {_CRIT!r} AND n >= 50), any_value(mind.d)), 3) AS d FROM mind LEFT JOIN adf2 ON adf2.ticker = mind.ticker GROUP BY mind.ticker)"""
#: The search over log prices.
_LOGS = _search(views.BARS_D1 + ", levels AS MATERIALIZED (SELECT ticker, bar_ts, row_number() OVER (PARTITION BY ticker ORDER BY bar_ts) AS rn, ln(close) AS x FROM bars_d1)")


@_query("frac_diff", f"WITH RECURSIVE {views.LEVELS}, ds AS (SELECT 0.3::DOUBLE AS d), {_WEIGHTS.format(t=_THRESHOLD)}, {_differenced('ds')} SELECT l.ticker, l.bar_ts, round(fd.x, 4) AS x_frac_diff FROM levels l LEFT JOIN fd ON fd.ticker = l.ticker AND fd.rn = l.rn")
def frac_diff(spark, sf):
    return rounded(fracdiff.frac_diff(views.levels(spark, sf), 0.3, _THRESHOLD).select("ticker", "bar_ts", "x_frac_diff"), 4)


@_query("frac_diff_fine", f"WITH RECURSIVE {views.LEVELS}, ds AS (SELECT 0.3::DOUBLE AS d), {_WEIGHTS.format(t=0.0001)}, {_differenced('ds', frame=400)} SELECT l.ticker, l.bar_ts, round(fd.x, 4) AS x_frac_diff FROM levels l LEFT JOIN fd ON fd.ticker = l.ticker AND fd.rn = l.rn")
def frac_diff_fine(spark, sf):
    """388 weights, as a convolution of chunks."""
    return rounded(fracdiff.frac_diff(views.levels(spark, sf), 0.3, 0.0001, chunk=100).select("ticker", "bar_ts", "x_frac_diff"), 4)


@_query("adf_test", f"WITH {views.LEVELS}, one AS (SELECT ticker, rn, x, 0 AS d FROM levels), {_adf('one')} SELECT ticker, n, lag, round(stat, 6) AS stat FROM adf")
def adf_test(spark, sf):
    return rounded(fracdiff.adf_test(views.levels(spark, sf)))


def _normal(z: str) -> str:
    """SQL: the normal distribution function by its series of positive terms, z^(2n+1) over the odd factorial of 2n+1."""
    series = f"list_sum(list_transform(range(400), lambda n: exp((2 * n + 1) * ln(abs({z})) - lgamma(2 * n + 2) + n * ln(2) + lgamma(n + 1))))"
    return f"CASE WHEN {z} = 0 THEN 0.5 WHEN abs({z}) > 12 THEN CASE WHEN {z} > 0 THEN 1 ELSE 0 END ELSE 0.5 + sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {series} END"


def _cubic(c: tuple[float, ...]) -> str:
    return " + ".join(f"{x!r}::DOUBLE * pow(stat, {k})" for k, x in enumerate(c))


@_query(
    "adf_p_value",
    f"""WITH {views.LEVELS}, one AS (SELECT ticker, rn, x, 0 AS d FROM levels), {_adf('one')},
z AS (SELECT *, CASE WHEN stat <= {fracdiff.SPLIT} THEN {_cubic(fracdiff.SMALL_P)} ELSE {_cubic(fracdiff.LARGE_P)} END AS z FROM adf),
p AS (SELECT *, CASE WHEN stat > {fracdiff.TOP} THEN 1 WHEN stat < {fracdiff.BOTTOM} THEN 0 ELSE {_normal('z')} END AS p FROM z)
SELECT ticker, n, lag, round(stat, 6) AS stat, round(p, 6) + 0.0 AS p_value, coalesce(p < 0.05, false) AS is_stationary FROM p""",
)
def adf_p_value(spark, sf):
    return rounded(fracdiff.with_p(fracdiff.adf_test(views.levels(spark, sf))))


@_query("min_d_grid", f"{_SEARCH} SELECT ticker, d FROM mind")
def min_d_grid(spark, sf):
    return fracdiff.min_d_grid(views.levels(spark, sf), threshold=_THRESHOLD)


@_query("min_d_refined", f"{_REFINED} SELECT ticker, d FROM fine")
def min_d_refined(spark, sf):
    return fracdiff.min_d_refined(views.levels(spark, sf), threshold=_THRESHOLD)


_PICK = "SELECT list_sort(list(d))[CAST(least(floor(count(*) * 0.8), count(*) - 1) AS BIGINT) + 1] AS d FROM mind"


@_query("global_d", f"{_SEARCH} {_PICK}")
def global_d(spark, sf):
    return fracdiff.global_d(fracdiff.min_d_grid(views.levels(spark, sf), threshold=_THRESHOLD))


@_query("reference_ticker_d", f"{_REFINED} SELECT d FROM fine WHERE ticker = 'Supplier#000000001'")
def reference_ticker_d(spark, sf):
    return fracdiff.reference_ticker_d(views.levels(spark, sf), "Supplier#000000001", threshold=_THRESHOLD)


@_query("train_cutoff_d", f"{_search(views.LEVELS + ", early AS (SELECT * FROM levels WHERE bar_ts < TIMESTAMP '1997-01-01')", 'early')} {_PICK}")
def train_cutoff_d(spark, sf):
    return fracdiff.train_cutoff_d(views.levels(spark, sf), "1996-12-31", threshold=_THRESHOLD)


@_query("memory_corr", f"WITH RECURSIVE {views.LEVELS}, ds AS (SELECT 0.3::DOUBLE AS d), {_WEIGHTS.format(t=_THRESHOLD)}, {_differenced('ds')} SELECT l.ticker, round(coalesce(corr(l.x, fd.x), 0), 6) AS corr FROM levels l LEFT JOIN fd ON fd.ticker = l.ticker AND fd.rn = l.rn GROUP BY l.ticker")
def memory_corr(spark, sf):
    return rounded(fracdiff.memory_corr(fracdiff.frac_diff(views.levels(spark, sf), 0.3, _THRESHOLD), "x", "x_frac_diff"))


_WEIGHTS_3 = _WEIGHTS_2.replace("w2", "w3").replace("ds2", "pick")


@_query("ffd_features", f"{_LOGS}, pick AS MATERIALIZED ({_PICK}), {_WEIGHTS_3.format(t=_THRESHOLD)}, {_differenced('pick', 'levels', '3')} SELECT l.ticker, l.bar_ts, round(l.x, 6) AS log_close, round(fd3.x, 6) + 0.0 AS log_close_frac_diff FROM levels l LEFT JOIN fd3 ON fd3.ticker = l.ticker AND fd3.rn = l.rn")
def ffd_features(spark, sf):
    return rounded(fracdiff.ffd_features(views.bars_d1(spark, sf), _THRESHOLD).select("ticker", "bar_ts", "log_close", "log_close_frac_diff"))


# --- windows

_IDX = f"{_D1}, i AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY bar_ts) AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM bars_d1)"


@_query("window_index", f"{_IDX} SELECT ticker, CAST(rn - 60 AS BIGINT) AS start, bar_ts AS end_ts FROM i WHERE rn >= 60 AND rn < n")
def window_index(spark, sf):
    return windows.window_index(views.bars_d1(spark, sf), 60)


@_query("window_index_split", f"{_IDX} SELECT ticker, CAST(rn - 60 AS BIGINT) AS start, bar_ts AS end_ts FROM i WHERE rn >= 60 AND rn < n")
def window_index_split(spark, sf):
    """The same index, with the rows of a ticker in any number of tasks."""
    return windows.window_index(views.bars_d1(spark, sf), 60, split=True)


@_query("sliding_windows", f"{_IDX} SELECT e.ticker, CAST(e.rn - 10 AS BIGINT) AS start, CAST(p.rn - e.rn + 9 AS INTEGER) AS pos, CAST(p.volume AS DOUBLE) AS volume, CAST(CAST(p.close AS FLOAT) AS DOUBLE) AS close, CAST(e.volume AS DOUBLE) AS target FROM i e JOIN i p ON p.ticker = e.ticker AND p.rn BETWEEN e.rn - 9 AND e.rn WHERE e.rn >= 10 AND e.rn < e.n")
def sliding_windows(spark, sf):
    """Every value of every window: one row a window and place."""
    w = windows.sliding_windows(views.bars_d1(spark, sf), ["volume", "close"], ["volume"], 10)
    cells = w.select("ticker", "start", F.posexplode("features").alias("pos", "x"), F.col("target")[0].cast("double").alias("target"))
    return cells.select("ticker", "start", "pos", F.col("x")[0].cast("double").alias("volume"), F.col("x")[1].cast("double").alias("close"), "target")


@_query("time_split_date", f"{_H1} SELECT ticker, bar_ts, CASE WHEN bar_ts < TIMESTAMP '2024-01-16' THEN 'train' ELSE 'val' END AS split FROM bars_h1")
def time_split_date(spark, sf):
    return windows.time_split_date(views.bars_h1(spark, sf), "2024-01-15").select("ticker", "bar_ts", "split")


_CUT = "d AS (SELECT bar_ts, row_number() OVER (ORDER BY bar_ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT bar_ts FROM {0})), cut AS (SELECT bar_ts AS c FROM d WHERE i = least(floor(n * 0.8::DOUBLE), n - 1))"


@_query("time_split_ratio", f"{_D1}, {_CUT.format('bars_d1')} SELECT ticker, bar_ts, CASE WHEN bar_ts <= c THEN 'train' ELSE 'val' END AS split FROM bars_d1 CROSS JOIN cut")
def time_split_ratio(spark, sf):
    return windows.time_split_ratio(views.bars_d1(spark, sf)).select("ticker", "bar_ts", "split")


@_query(
    "batches",
    f"""{_D1}, {_CUT.format('bars_d1')}, sp AS (SELECT ticker, CASE WHEN bar_ts <= c THEN 'train' ELSE 'val' END AS split, bar_ts FROM bars_d1 CROSS JOIN cut),
n AS (SELECT *, row_number() OVER (PARTITION BY split, ticker ORDER BY bar_ts) AS rn, count(*) OVER (PARTITION BY split, ticker) AS n FROM sp),
w AS (SELECT split, ticker, CAST(rn - 1 AS BIGINT) AS start, row_number() OVER (PARTITION BY split ORDER BY ticker, rn) - 1 AS idx FROM n WHERE rn <= n - 60)
SELECT split, ticker, start, idx, CAST(floor(idx / 32) AS BIGINT) AS batch FROM w""",
)
def batches(spark, sf):
    return windows.batches(windows.time_split_ratio(views.bars_d1(spark, sf)), 60, 32)


@_query(
    "batch_tensors",
    f"""{_D1}, {_CUT.format('bars_d1')}, sp AS (SELECT ticker, CASE WHEN bar_ts <= c THEN 'train' ELSE 'val' END AS split, bar_ts, CAST(CAST(volume AS FLOAT) AS DOUBLE) AS volume, CAST(CAST(close AS FLOAT) AS DOUBLE) AS close FROM bars_d1 CROSS JOIN cut),
n AS (SELECT *, row_number() OVER (PARTITION BY split, ticker ORDER BY bar_ts) AS rn, count(*) OVER (PARTITION BY split, ticker) AS n,
  sum(volume) OVER w AS vs, sum(close) OVER w AS cs, first_value(volume) OVER w AS v0 FROM sp WINDOW w AS (PARTITION BY split, ticker ORDER BY bar_ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
w AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY ticker, rn) - 1 AS idx FROM n WHERE rn >= 20 AND rn < n)
SELECT split, CAST(idx // 32 AS BIGINT) AS batch, count(*) AS n, sum(vs) AS volume, round(sum(cs), 1) AS close, min_by(v0, idx) AS first, max_by(close, idx) AS last, sum(close) AS target FROM w GROUP BY split, idx // 32""".replace("sum(close) AS target", "round(sum(close), 2) AS target"),
)
def batch_tensors(spark, sf):
    """Every batch of windows of 20 rows, written as blocks by split and read back as tensors; their sums and corners."""
    panel = windows.time_split_ratio(views.bars_d1(spark, sf))
    path = windows.write_blocks(panel, ["volume", "close"], ["close"], folders.scratch(spark, "blocks"), 20, 32, 8)

    def sums(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]  # one row's tensors at a time
                x, y = windows.tensors(row)
                out.append({
                    "split": row["split"], "batch": row["batch"], "n": row["n"], "volume": float(x[:, :, 0].sum(dtype=float)), "close": float(x[:, :, 1].sum(dtype=float)),
                    "first": float(x[0, 0, 0]), "last": float(x[-1, -1, 1]), "target": float(y.sum(dtype=float)),
                })
            if out:
                yield pa.RecordBatch.from_pylist(out)

    found = windows.read_batches(spark, path).mapInArrow(sums, "split string, batch long, n long, volume double, close double, first double, last double, target double")
    return found.select("split", "batch", "n", "volume", F.round("close", 1).alias("close"), "first", "last", F.round("target", 2).alias("target"))


@_query("window_manifest", f"{_D1}, c AS (SELECT ticker, count(*) AS n FROM bars_d1 GROUP BY ticker) SELECT '1d' AS timeframe, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(greatest(n - 60, 0)) AS BIGINT) AS n_windows, 5 AS n_features, 1 AS n_targets, 60 AS sequence_len FROM c")
def window_manifest(spark, sf):
    return windows.window_manifest(views.bars_d1(spark, sf), ["open", "high", "low", "close", "volume"], ["target_1b"])


# --- risk

_RET_H1 = f"WITH {views.RETURNS_H1}"
_ASSETS = ("click", "error", "purchase", "signup", "view")


@_query("returns_wide", f"{_RET_H1} SELECT portfolio, bar_ts, " + ", ".join(f"round(max(ret) FILTER (WHERE asset = '{a}'), 6) AS {a}" for a in _ASSETS) + " FROM returns_h1 GROUP BY portfolio, bar_ts HAVING " + " AND ".join(f"count(*) FILTER (WHERE asset = '{a}') > 0" for a in _ASSETS))
def returns_wide(spark, sf):
    return rounded(risk.returns_wide(views.returns_h1(spark, sf), list(_ASSETS)))


_COV = f"{_RET_H1}, cov AS (SELECT a.portfolio, a.asset AS i, b.asset AS j, covar_pop(a.ret, b.ret) AS cov FROM returns_h1 a JOIN returns_h1 b ON a.bar_ts = b.bar_ts AND a.asset <= b.asset GROUP BY a.portfolio, a.asset, b.asset)"
_LW = f"""{_COV}, tr AS (SELECT portfolio, sum(cov) FILTER (WHERE i = j) AS trace, sum(CASE WHEN i = j THEN 1 ELSE 2 END * cov * cov) AS norm, count(*) FILTER (WHERE i = j) AS p FROM cov GROUP BY portfolio),
ce AS (SELECT portfolio, bar_ts, ret - avg(ret) OVER (PARTITION BY portfolio, asset) AS x FROM returns_h1),
q AS (SELECT portfolio, bar_ts, sum(x * x) AS q FROM ce GROUP BY portfolio, bar_ts), q2 AS (SELECT portfolio, sum(q * q) AS q2, count(*) AS n FROM q GROUP BY portfolio),
z AS (SELECT portfolio, trace / p AS mu, (norm - 2 * trace * trace / p + trace * trace / p) / p AS delta, (q2 / n - norm) / (p * n) AS beta FROM tr JOIN q2 USING (portfolio)),
lw AS (SELECT portfolio, i, j, (1 - sh) * cov + CASE WHEN i = j THEN sh * mu ELSE 0 END AS cov, sh AS shrinkage FROM cov JOIN (SELECT portfolio, mu, CASE WHEN least(beta, delta) = 0 THEN 0 ELSE least(beta, delta) / delta END AS sh FROM z) USING (portfolio))"""


@_query("sample_cov", f"{_COV} SELECT portfolio, i, j, {_r('cov')} FROM cov")
def sample_cov(spark, sf):
    return rounded(risk.sample_cov(views.returns_h1(spark, sf)))


@_query("ledoit_wolf", f"{_LW} SELECT portfolio, i, j, {_r('cov', 'shrinkage')} FROM lw")
def ledoit_wolf(spark, sf):
    return rounded(risk.ledoit_wolf(views.returns_h1(spark, sf)))


@_query("cov_to_corr", f"{_COV} SELECT c.portfolio, c.i, c.j, round(CASE WHEN c.i = c.j THEN 1 ELSE greatest(-1, least(1, c.cov / (CASE WHEN a.cov = 0 THEN 1e-10 ELSE sqrt(a.cov) END * CASE WHEN b.cov = 0 THEN 1e-10 ELSE sqrt(b.cov) END))) END, 6) AS corr FROM cov c JOIN cov a ON a.portfolio = c.portfolio AND a.i = c.i AND a.j = c.i JOIN cov b ON b.portfolio = c.portfolio AND b.i = c.j AND b.j = c.j")
def cov_to_corr(spark, sf):
    return rounded(risk.cov_to_corr(risk.sample_cov(views.returns_h1(spark, sf))))


@_query("denoise_cov")
def denoise_cov(spark, sf):
    return risk.denoised(views.returns_h1(spark, sf))


@_query("hrp_weights")
def hrp_weights(spark, sf):
    return risk.hrp_portfolio(views.returns_h1(spark, sf))


@_query("dataset_profile", f"{_D1} SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, min(bar_ts) AS first_ts, max(bar_ts) AS last_ts, 9 AS n_columns FROM bars_d1")
def dataset_profile(spark, sf):
    return risk.dataset_profile(views.bars_d1(spark, sf))


_WT = f"WITH RECURSIVE {views.WEIGHTS}"
_LONG = f"{_WT}, fine AS (SELECT portfolio, min(weight) >= 0 AND abs(sum(weight) - 1) <= 1e-6 AS ok, sum(greatest(weight, 0)) AS total FROM weights GROUP BY portfolio), lo AS (SELECT w.portfolio, asset, CASE WHEN ok THEN weight ELSE greatest(weight, 0) / total END AS weight FROM weights w JOIN fine USING (portfolio))"
_MIN = _LONG + ", ks AS (SELECT portfolio, count(*) AS n, sum(weight) FILTER (WHERE weight >= 0.05) AS total FROM lo GROUP BY portfolio), mi AS (SELECT lo.portfolio, asset, CASE WHEN total IS NULL THEN 1.0::DOUBLE / n WHEN weight >= 0.05 THEN weight / total ELSE 0 END AS weight FROM lo JOIN ks USING (portfolio))"


def _capped(source: str, most: float) -> str:
    """The cap, one asset at a time: a recursion that caps the next largest while it would exceed the cap."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY weight DESC, asset) AS k, count(*) OVER (PARTITION BY portfolio) AS n, max(weight) OVER (PARTITION BY portfolio) AS top FROM {source}),
step AS (
  SELECT portfolio, CAST(0 AS BIGINT) AS k, sum(weight) AS rest, 1.0::DOUBLE AS budget FROM o GROUP BY portfolio
  UNION ALL SELECT s.portfolio, s.k + 1, s.rest - o.weight, s.budget - {most} FROM step s JOIN o ON o.portfolio = s.portfolio AND o.k = s.k + 1 AND o.weight * s.budget > {most} * s.rest + 1e-12),
last AS (SELECT portfolio, max(k) AS k, min_by(rest, -k) AS rest, min_by(budget, -k) AS budget FROM step GROUP BY portfolio),
ca AS (
  SELECT o.portfolio, o.asset, CASE WHEN n = 1 THEN 1 WHEN {most} < 1.0::DOUBLE / n THEN NULL WHEN top <= {most} + 1e-10 THEN weight WHEN left_over <= 0 THEN 1.0::DOUBLE / n WHEN o.k <= l.k THEN {most} ELSE weight * budget / left_over END AS weight
  FROM o JOIN last l USING (portfolio) JOIN (SELECT o.portfolio, coalesce(sum(weight) FILTER (WHERE o.k > l.k), 0) AS left_over FROM o JOIN last l USING (portfolio) GROUP BY o.portfolio) USING (portfolio))"""


@_query("long_only", f"{_LONG} SELECT portfolio, asset, {_r('weight')} FROM lo")
def long_only(spark, sf):
    return rounded(risk.long_only(views.weights(spark, sf)))


@_query("min_position", f"{_MIN} SELECT portfolio, asset, {_r('weight')} FROM mi")
def min_position(spark, sf):
    return rounded(risk.min_position(risk.long_only(views.weights(spark, sf))))


@_query("max_position", f"{_LONG}, {_capped('lo', 0.3)} SELECT portfolio, asset, {_r('weight')} FROM ca")
def max_position(spark, sf):
    return rounded(risk.max_position(risk.long_only(views.weights(spark, sf)), 0.3))


#: Few survive a least weight of a quarter, so that caps often take all weight there is.
_QUARTER = _MIN.replace("0.05", "0.25")


@_query("max_position_spent", f"{_QUARTER}, {_capped('mi', 0.3)} SELECT portfolio, asset, {_r('weight')} FROM ca")
def max_position_spent(spark, sf):
    return rounded(risk.max_position(risk.min_position(risk.long_only(views.weights(spark, sf)), 0.25), 0.3))


@_query("constrained_weights", f"{_QUARTER}, {_capped('mi', 0.4)} SELECT portfolio, asset, {_r('weight')}, coalesce(abs(sum(weight) OVER (PARTITION BY portfolio) - 1) <= 1e-6, false) AS sums_to_one FROM ca")
def constrained_weights(spark, sf):
    return rounded(risk.constrained_weights(views.weights(spark, sf), 0.25, 0.4))


# --- walk-forward evaluation

_X, _Y = ["p1", "p2", "p3"], "actual"


def _model_rows(spark, sf):
    """Features p1, p2, p3 (last return and those before) and the next return."""
    w = Window.partitionBy("ticker").orderBy("bar_ts")
    r = views.bars_d1(spark, sf).select("ticker", "bar_ts", (F.col("close") / F.lag("close").over(w) - 1).alias("ret"))
    return r.select("ticker", "bar_ts", F.lead("ret").over(w).alias("actual"), F.col("ret").alias("p1"), F.lag("ret").over(w).alias("p2"), F.lag("ret", 2).over(w).alias("p3"))


def _complete(spark, sf):
    """Model rows, written once: folds, means, products and predictions all read them."""
    return folders.stored(features.model_frame(_model_rows(spark, sf), [_Y], _X), "rows")


def _folds(df):
    return evaluate.cv_folds(df, None, 63, 10, 1)


_MODEL = f"""WITH {views.PREDS}, rowset AS (SELECT * FROM ahead WHERE p1 IS NOT NULL AND p2 IS NOT NULL AND p3 IS NOT NULL AND actual IS NOT NULL),
dates AS (SELECT bar_ts, row_number() OVER (ORDER BY bar_ts DESC) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT bar_ts FROM rowset)),
bounds AS (SELECT CAST(i AS INTEGER) AS fold, (i + 1) * 10 AS te FROM range(100000) t(i) WHERE (i + 1) * 10 + 1 + 63 < (SELECT max(n) FROM dates)),
folds AS (
  SELECT fold, 'test' AS part, bar_ts FROM bounds JOIN dates ON r >= te - 10 AND r < te
  UNION ALL SELECT fold, 'train', bar_ts FROM bounds JOIN dates ON r >= te + 1 AND r < te + 1 + 63),
tr AS (SELECT fold, rowset.* FROM rowset JOIN folds USING (bar_ts) WHERE part = 'train')"""


@_query("cv_folds", f"{_MODEL} SELECT fold, part, bar_ts FROM folds")
def cv_folds(spark, sf):
    return _folds(_complete(spark, sf))


@_query("fold_scaler", f"{_MODEL} " + " UNION ALL ".join(f"SELECT fold, '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 6) AS std FROM tr GROUP BY fold" for c in [*_X, _Y]))
def fold_scaler(spark, sf):
    df = _complete(spark, sf)
    return rounded(evaluate.fold_scaler(df, _folds(df), [*_X, _Y]))


_NAMES = ["1", *_X, _Y]


@_query("fold_gram", f"{_MODEL} " + " UNION ALL ".join(f"SELECT fold, '{a}' AS a, '{b}' AS b, count(*) AS n, round(CAST(sum({a} * {b}) AS DOUBLE), 4) AS s FROM tr GROUP BY fold" for i, a in enumerate(_NAMES) for b in _NAMES[i:]))
def fold_gram(spark, sf):
    df = _complete(spark, sf)
    return rounded(evaluate.fold_gram(df, _folds(df), _X, _Y), 4)


_MOMENTS = f"""{_MODEL},
moments AS (
  SELECT fold, count(*)::DOUBLE AS n, avg(p1) AS m1, avg(p2) AS m2, avg(p3) AS m3, avg(actual) AS my, stddev_pop(p1) AS s1, stddev_pop(p2) AS s2, stddev_pop(p3) AS s3, stddev_pop(actual) AS sy,
    corr(p1, p2) * count(*) AS b, corr(p1, p3) * count(*) AS c, corr(p2, p3) * count(*) AS e, corr(p1, actual) * count(*) AS u, corr(p2, actual) * count(*) AS v, corr(p3, actual) * count(*) AS w FROM tr GROUP BY fold)"""
_SLOPES = f"""{_MOMENTS},
sys AS (SELECT *, n + alpha AS a FROM moments CROSS JOIN (VALUES {{alphas}}) t(alpha)),
dets AS (SELECT *, a * (a * a - e * e) - b * (b * a - e * c) + c * (b * e - a * c) AS det FROM sys),
solved AS (
  SELECT *, (u * (a * a - e * e) - b * (v * a - e * w) + c * (v * e - a * w)) / det AS b1, (a * (v * a - e * w) - u * (b * a - e * c) + c * (b * w - v * c)) / det AS b2, (a * (a * w - v * e) - b * (b * w - v * c) + u * (b * e - a * c)) / det AS b3 FROM dets),
sloped AS (SELECT *, b1 * sy / s1 AS g1, b2 * sy / s2 AS g2, b3 * sy / s3 AS g3 FROM solved),
coefs AS (
  SELECT fold, alpha, '1' AS feature, 0.0::DOUBLE AS coef, my - m1 * g1 - m2 * g2 - m3 * g3 AS slope FROM sloped
  UNION ALL SELECT fold, alpha, 'p1', b1, g1 FROM sloped UNION ALL SELECT fold, alpha, 'p2', b2, g2 FROM sloped UNION ALL SELECT fold, alpha, 'p3', b3, g3 FROM sloped),
predicted AS (
  SELECT f.fold, alpha, r.ticker, r.bar_ts, my - m1 * g1 - m2 * g2 - m3 * g3 + g1 * p1 + g2 * p2 + g3 * p3 AS predicted, actual
  FROM rowset r JOIN folds f ON f.bar_ts = r.bar_ts AND part = 'test' JOIN sloped s ON s.fold = f.fold)"""
_OLS = _SLOPES.format(alphas="(0.0::DOUBLE)")
_RIDGE = _SLOPES.format(alphas=", ".join(f"({a!r}::DOUBLE)" for a in evaluate.RIDGE_ALPHAS))


@_query("ols", f"{_OLS} SELECT fold, alpha, feature, {_r('coef', 'slope')} FROM coefs")
def ols(spark, sf):
    df = _complete(spark, sf)
    return rounded(evaluate.ols(df, _folds(df), _X, _Y))


def _ridge(df, folds):
    return evaluate.ridge(df, folds, _X, _Y)


@_query("ridge", f"{_RIDGE} SELECT fold, alpha, feature, {_r('coef', 'slope')} FROM coefs")
def ridge(spark, sf):
    df = _complete(spark, sf)
    return rounded(_ridge(df, _folds(df)))


def _shrunk(x: str) -> str:
    return f"sign({x}) * greatest(abs({x}) - lam, 0) / n"


_LASSO = f"""{_MOMENTS.replace('WITH', 'WITH RECURSIVE', 1)},
pen AS MATERIALIZED (SELECT *, n * alpha AS lam FROM moments CROSS JOIN (VALUES {", ".join(f"({a!r}::DOUBLE)" for a in evaluate.LASSO_ALPHAS)}) t(alpha)),
sweeps AS (
  SELECT fold, alpha, 0 AS sweep, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3, 1.0::DOUBLE AS moved FROM pen
  UNION ALL SELECT fold, alpha, sweep + 1, n1, n2, n3, greatest(abs(n1 - b1), abs(n2 - b2), abs(n3 - b3)) FROM (
    SELECT *, {_shrunk("w - c * n1 - e * n2")} AS n3 FROM (
      SELECT *, {_shrunk("v - b * n1 - e * b3")} AS n2 FROM (
        SELECT s.*, p.* EXCLUDE (fold, alpha), {_shrunk("u - b * b2 - c * b3")} AS n1 FROM sweeps s JOIN pen p ON p.fold = s.fold AND p.alpha = s.alpha WHERE moved >= 1e-11 AND sweep < 1000)))),
solved AS (SELECT p.*, s.b1, s.b2, s.b3 FROM (SELECT fold, alpha, max_by(b1, sweep) AS b1, max_by(b2, sweep) AS b2, max_by(b3, sweep) AS b3 FROM sweeps GROUP BY fold, alpha) s JOIN pen p ON p.fold = s.fold AND p.alpha = s.alpha),
{_SLOPES[_SLOPES.index("sloped AS") : _SLOPES.index("predicted AS")].rstrip().rstrip(",")}"""


@_query("lasso", f"{_LASSO} SELECT fold, feature, {_r('alpha', 'coef', 'slope')} FROM coefs")
def lasso(spark, sf):
    df = _complete(spark, sf)
    return rounded(evaluate.lasso(df, _folds(df), _X, _Y, tol=1e-11))


@_query("predict_paths", f"{_RIDGE} SELECT fold, alpha, ticker, bar_ts, {_r('predicted', 'actual')} FROM predicted WHERE alpha IN (0.0001, 50000.0)")
def predict_paths(spark, sf):
    """The least and the greatest penalty of each row's predictions under all."""
    df = _complete(spark, sf)
    folds = _folds(df)
    p = evaluate.predict_paths(df, folds, _ridge(df, folds), _X, _Y)
    cells = p.select("fold", "ticker", "bar_ts", "actual", F.explode(F.arrays_zip("alphas", "predicted")).alias("c"))
    return rounded(cells.select("fold", F.col("c.alphas").alias("alpha"), "ticker", "bar_ts", F.col("c.predicted").alias("predicted"), "actual").where("alpha IN (0.0001D, 50000.0D)"))


@_query("predict", f"{_OLS} SELECT fold, alpha, ticker, bar_ts, {_r('predicted', 'actual')} FROM predicted")
def predict(spark, sf):
    df = _complete(spark, sf)
    folds = _folds(df)
    return rounded(evaluate.predict(df, folds, evaluate.ols(df, folds, _X, _Y), _X, _Y))


_IC = f"""WITH {views.PREDS}, rk AS (
  SELECT alpha, bar_ts, rank() OVER (PARTITION BY alpha, bar_ts ORDER BY predicted) + (count(*) OVER (PARTITION BY alpha, bar_ts, predicted) - 1) / 2.0::DOUBLE AS a,
    rank() OVER (PARTITION BY alpha, bar_ts ORDER BY actual) + (count(*) OVER (PARTITION BY alpha, bar_ts, actual) - 1) / 2.0::DOUBLE AS b FROM preds),
ic AS (SELECT alpha, bar_ts, CASE WHEN count(DISTINCT a) > 1 AND count(DISTINCT b) > 1 THEN corr(a, b) * 100 END AS ic FROM rk GROUP BY alpha, bar_ts),
er AS (SELECT alpha, bar_ts, sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse FROM preds GROUP BY alpha, bar_ts)"""


@_query("daily_ic", f"{_IC} SELECT alpha, bar_ts, {_r('ic')} FROM ic")
def daily_ic(spark, sf):
    return rounded(evaluate.daily_ic(views.preds(spark, sf)))


@_query("daily_rmse", f"{_IC} SELECT alpha, bar_ts, {_r('rmse')} FROM er")
def daily_rmse(spark, sf):
    return rounded(evaluate.daily_rmse(views.preds(spark, sf)))


def _walk_forward(spark, sf):
    df = _complete(spark, sf)
    folds = _folds(df)
    return evaluate.walk_forward_scores(df, folds, _ridge(df, folds), _X, _Y)


_WALK_IC = f"""{_RIDGE}, rk AS (
  SELECT alpha, bar_ts, rank() OVER (PARTITION BY alpha, bar_ts ORDER BY predicted) + (count(*) OVER (PARTITION BY alpha, bar_ts, predicted) - 1) / 2.0::DOUBLE AS a,
    rank() OVER (PARTITION BY alpha, bar_ts ORDER BY actual) + (count(*) OVER (PARTITION BY alpha, bar_ts, actual) - 1) / 2.0::DOUBLE AS b FROM predicted),
ic AS (SELECT alpha, bar_ts, CASE WHEN count(DISTINCT a) > 1 AND count(DISTINCT b) > 1 THEN corr(a, b) * 100 END AS ic FROM rk GROUP BY alpha, bar_ts),
m AS (SELECT alpha, avg(ic) AS mean_ic FROM ic GROUP BY alpha)"""


@_query("alpha_scores", f"{_WALK_IC} SELECT alpha, round(mean_ic, 4) + 0.0 AS mean_ic, alpha = first_value(alpha) OVER (ORDER BY round(mean_ic, 4) DESC, alpha) AS is_best FROM m")
def alpha_scores(spark, sf):
    """Penalties of the walk-forward ridge; means of daily scores count to 4 places, as predictions of near penalties rank alike."""
    scores = _walk_forward(spark, sf).groupBy("alpha").agg(F.round(F.avg("ic"), 4).alias("ic"))
    return rounded(evaluate.alpha_scores(scores), 4)


@_query("walk_forward_rmse", f"{_RIDGE} SELECT alpha, bar_ts, round(sqrt(avg((predicted - actual) * (predicted - actual))), 6) AS rmse FROM predicted GROUP BY alpha, bar_ts")
def walk_forward_rmse(spark, sf):
    return rounded(_walk_forward(spark, sf).select("alpha", "bar_ts", "rmse"))


_COEF = f"{_RIDGE}, st AS (SELECT alpha, feature, avg(coef) AS mean_coef, stddev_samp(coef) AS std_coef, avg(abs(coef)) AS mean_abs FROM coefs WHERE feature <> '1' GROUP BY alpha, feature)"


def _coef_stats(spark, sf):
    df = _complete(spark, sf)
    return evaluate.coef_stats(_ridge(df, _folds(df)).where("feature <> '1'"))


@_query("coef_stats", f"{_COEF} SELECT alpha, feature, {_r('mean_coef', 'std_coef', 'mean_abs')} FROM st")
def coef_stats(spark, sf):
    return rounded(_coef_stats(spark, sf))


@_query("top_features", f"{_COEF}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY alpha ORDER BY abs(mean_coef) DESC, feature) AS INTEGER) AS place FROM st) SELECT alpha, feature, {_r('mean_coef')}, place FROM k WHERE place <= 10")
def top_features(spark, sf):
    return rounded(evaluate.top_features(_coef_stats(spark, sf)).select("alpha", "feature", "mean_coef", "place"))


_NUM = ["open", "high", "low", "close", "volume"]
_CORR = f"{_D1}, c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM bars_d1" for a in _NUM for b in _NUM) + ")"


@_query("feature_corr", f"{_CORR} SELECT a, b, {_r('corr')} FROM c")
def feature_corr(spark, sf):
    return rounded(evaluate.feature_corr(views.bars_d1(spark, sf), _NUM))


@_query("strong_features", f"{_CORR} SELECT DISTINCT a AS feature FROM c WHERE a <> b AND abs(corr) >= 0.7")
def strong_features(spark, sf):
    return evaluate.strong_features(evaluate.feature_corr(views.bars_d1(spark, sf), _NUM))


@_query("rolling_scores", f"{_IC}, j AS (SELECT * FROM ic JOIN er USING (alpha, bar_ts)), r AS (SELECT alpha, bar_ts, CASE WHEN count(ic) OVER w = 21 THEN avg(ic) OVER w END AS ic_21, CASE WHEN count(rmse) OVER w = 21 THEN avg(rmse) OVER w END AS rmse_21 FROM j WINDOW w AS (PARTITION BY alpha ORDER BY bar_ts ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) SELECT alpha, bar_ts, {_r('ic_21', 'rmse_21')} FROM r WHERE ic_21 IS NOT NULL AND rmse_21 IS NOT NULL")
def rolling_scores(spark, sf):
    p = views.preds(spark, sf)
    return rounded(evaluate.rolling_scores(evaluate.daily_ic(p).join(evaluate.daily_rmse(p), ["alpha", "bar_ts"]), ["ic", "rmse"]))


@_query("ic_distribution", f"{_IC}, s AS (SELECT alpha, avg(ic) AS mean_ic, median(ic) AS median_ic, min(ic) AS lo, max(ic) AS hi FROM ic WHERE ic IS NOT NULL GROUP BY alpha) SELECT alpha, CAST(least(floor((ic - lo) / ((hi - lo) / 30) + 1e-9), 29) AS INTEGER) AS bin, count(*) AS n, {_r('mean_ic', 'median_ic')} FROM ic JOIN s USING (alpha) WHERE ic IS NOT NULL GROUP BY ALL")
def ic_distribution(spark, sf):
    return rounded(evaluate.ic_distribution(evaluate.daily_ic(views.preds(spark, sf))))
