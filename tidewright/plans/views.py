"""Views over the given tables in the shapes that the operators take, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import series
from tidewright.sources import bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades_d1(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None, items: DataFrame | None = None) -> DataFrame:
    """Daily bars by supplier key from line items, a price being the extended price of one unit."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return bars.ohlcv_bars(table(spark, sf_dir, "lineitem") if items is None else items, F.col("l_suppkey"), F.col("l_shipdate"), price, F.col("l_quantity"), ("l_orderkey", "l_partkey", "l_linenumber"), "day", start, end)


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, ticker, sector, industry): region and nation of each supplier."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select("s_suppkey", F.col("s_name").alias("ticker"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"))


def items(spark: SparkSession, sf_dir: str) -> int:
    """How many line items there are, from the heads of their files: no fewer than bars."""
    return table(spark, sf_dir, "lineitem").count()


def bars_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars_d1, with line items dealt by supplier: a day has few of a supplier's, so that sums by task save nothing, and one shuffle serves bars and join."""
    columns = ("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_orderkey", "l_partkey", "l_linenumber")
    return bars_d1(spark, sf_dir, table(spark, sf_dir, "lineitem").select(*columns).repartition(series.buckets(spark, items(spark, sf_dir)), "l_suppkey"))


def bars_d1(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    b = trades_d1(spark, sf_dir, items=items).withColumnRenamed("ticker", "s_suppkey").join(suppliers(spark, sf_dir), "s_suppkey", "left")
    return b.fillna("Unknown", ["sector", "industry"]).select("ticker", "bar_ts", "open", "high", "low", "close", "volume", "sector", "industry")


def bars_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of which some tickers lack closes: at the start, at every other of the first, in a month."""
    k, t = F.substring("ticker", -3, 3).cast("int") % 5, F.col("bar_ts")
    gone = ((k == 1) & (t < "1992-03-01")) | ((k == 2) & (F.date_trunc("month", t) == F.lit("1995-06-01").cast("timestamp"))) | ((k == 3) & (t < "1992-04-01") & (F.dayofmonth(t) % 2 == 0))
    return bars_d1(spark, sf_dir).withColumn("close", F.when(~gone, F.col("close")))


def bars_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    b = bars.ohlcv_bars(e, F.col("event_type"), F.col("ts"), F.col("value"), F.lit(1.0), ("ts", "event_id"), "hour")
    return b.select("*", F.lit("Unknown").alias("sector"), F.lit("Unknown").alias("industry"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars_d1(spark, sf_dir).select("ticker", "bar_ts", "close")
    mu = b.agg(F.round(F.avg("close"), 2).alias("mu"))
    w = Window.partitionBy("ticker").orderBy("bar_ts")
    return b.join(F.broadcast(mu)).select("ticker", "bar_ts", F.sum(F.col("close") - F.col("mu")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("x"))


def returns_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("bar_ts")
    r = bars_h1(spark, sf_dir).select("ticker", "bar_ts", (F.col("close") / F.lag("close").over(w) - 1).alias("ret")).where("ret IS NOT NULL")
    n = F.count("*").over(Window.partitionBy("bar_ts"))
    return r.withColumn("n", n).where("n = 5").select(F.date_trunc("week", "bar_ts").cast("timestamp_ntz").alias("portfolio"), "bar_ts", F.col("ticker").alias("asset"), "ret")


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    s = e.groupBy("user_id", "event_type").agg(F.round(F.sum(F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value"))), 2).alias("v"))
    tv = F.round(F.sum("v").over(Window.partitionBy("user_id")), 2)
    return s.withColumn("tv", tv).where("tv > 0").select(F.col("user_id").alias("portfolio"), F.col("event_type").alias("asset"), (F.col("v") / F.col("tv")).alias("weight"))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("bar_ts")
    r = bars_d1(spark, sf_dir).select("ticker", "bar_ts", (F.col("close") / F.lag("close").over(w) - 1).alias("ret"))
    f = r.select("ticker", "bar_ts", F.lead("ret").over(w).alias("actual"), F.col("ret").alias("p1"), F.lag("ret").over(w).alias("p2"), F.lag("ret", 2).over(w).alias("p3"))
    cells = F.array(*[F.struct(F.lit(i).alias("alpha"), F.col(f"p{i}").alias("predicted")) for i in (1, 2, 3)])
    return f.select("ticker", "bar_ts", "actual", F.explode(cells).alias("c")).select("c.alpha", "ticker", "bar_ts", "c.predicted", "actual").where("predicted IS NOT NULL AND actual IS NOT NULL")


BARS_D1 = """
trades AS (
  SELECT l_suppkey, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, l_extendedprice / l_quantity AS price, l_quantity AS qty,
    row_number() OVER (PARTITION BY l_suppkey, date_trunc('day', l_shipdate) ORDER BY l_orderkey, l_partkey, l_linenumber) AS rn
  FROM lineitem),
trade_bars AS (
  SELECT l_suppkey, ts AS bar_ts, min_by(price, rn) AS open, max(price) AS high, min(price) AS low, max_by(price, rn) AS close, sum(qty) AS volume
  FROM trades GROUP BY l_suppkey, ts),
bars_d1 AS (
  SELECT s_name AS ticker, bar_ts, open, high, low, close, volume, coalesce(r_name, 'Unknown') AS sector, coalesce(n_name, 'Unknown') AS industry
  FROM trade_bars LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""

BARS_GAPS = BARS_D1 + """,
gaps AS (
  SELECT * REPLACE (CASE WHEN (k = 1 AND bar_ts < TIMESTAMP '1992-03-01') OR (k = 2 AND date_trunc('month', bar_ts) = TIMESTAMP '1995-06-01')
    OR (k = 3 AND bar_ts < TIMESTAMP '1992-04-01' AND day(bar_ts) % 2 = 0) THEN NULL ELSE close END AS close)
  FROM (SELECT *, CAST(right(ticker, 3) AS INTEGER) % 5 AS k FROM bars_d1))"""

BARS_H1 = """
hourly AS (
  SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, value, event_id,
    row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn FROM events),
bars_h1 AS (
  SELECT event_type AS ticker, h AS bar_ts, min_by(value, rn) AS open, max(value) AS high, min(value) AS low, max_by(value, rn) AS close,
    CAST(count(*) AS DOUBLE) AS volume, 'Unknown' AS sector, 'Unknown' AS industry
  FROM hourly GROUP BY event_type, h)"""

LEVELS = BARS_D1 + """,
mean_close AS (SELECT round(avg(close), 2) AS mu FROM bars_d1),
levels AS (
  SELECT ticker, bar_ts, row_number() OVER (PARTITION BY ticker ORDER BY bar_ts) AS rn,
    sum(close - mu) OVER (PARTITION BY ticker ORDER BY bar_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x
  FROM bars_d1 CROSS JOIN mean_close)"""

RETURNS_H1 = BARS_H1 + """,
hour_returns AS (SELECT ticker, bar_ts, close / lag(close) OVER (PARTITION BY ticker ORDER BY bar_ts) - 1 AS ret FROM bars_h1),
full_hours AS (SELECT bar_ts FROM hour_returns WHERE ret IS NOT NULL GROUP BY bar_ts HAVING count(*) = 5),
returns_h1 AS (
  SELECT CAST(date_trunc('week', bar_ts) AS TIMESTAMP) AS portfolio, bar_ts, ticker AS asset, ret FROM hour_returns
  WHERE bar_ts IN (SELECT bar_ts FROM full_hours))"""

WEIGHTS = """
user_sums AS (
  SELECT user_id, event_type, round(sum(CASE WHEN event_type = 'error' THEN -value ELSE value END), 2) AS v FROM events GROUP BY user_id, event_type),
user_totals AS (SELECT user_id, round(sum(v), 2) AS tv FROM user_sums GROUP BY user_id),
weights AS (
  SELECT s.user_id AS portfolio, event_type AS asset, v / tv AS weight FROM user_sums s JOIN user_totals t ON s.user_id = t.user_id WHERE tv > 0)"""

PREDS = BARS_D1 + """,
day_returns AS (SELECT ticker, bar_ts, close / lag(close) OVER (PARTITION BY ticker ORDER BY bar_ts) - 1 AS ret FROM bars_d1),
ahead AS (
  SELECT ticker, bar_ts, lead(ret) OVER w AS actual, ret AS p1, lag(ret) OVER w AS p2, lag(ret, 2) OVER w AS p3
  FROM day_returns WINDOW w AS (PARTITION BY ticker ORDER BY bar_ts)),
preds AS (
  SELECT 1 AS alpha, ticker, bar_ts, p1 AS predicted, actual FROM ahead WHERE p1 IS NOT NULL AND actual IS NOT NULL
  UNION ALL SELECT 2, ticker, bar_ts, p2, actual FROM ahead WHERE p2 IS NOT NULL AND actual IS NOT NULL
  UNION ALL SELECT 3, ticker, bar_ts, p3, actual FROM ahead WHERE p3 IS NOT NULL AND actual IS NOT NULL)"""
