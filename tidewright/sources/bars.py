"""Bars from raw records, reshaping, dimensions, and the sinks between steps."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
KEY = ("ticker", "bar_ts")


def ohlcv_bars(trades: DataFrame, ticker: Column, ts: Column, price: Column, qty: Column, seq: Iterable[str], unit: str = "day", start: str | None = None, end: str | None = None) -> DataFrame:
    """One bar a ticker and unit of time: (ticker, bar_ts, open, high, low, close, volume).

    start is inclusive, end exclusive. seq breaks ties in time, so open and close are unique. One
    aggregate: partial on the map side, then a shuffle by (ticker, bar_ts).
    """
    rows = trades.select(ticker.alias("ticker"), ts.alias("ts"), price.cast("double").alias("p"), qty.cast("double").alias("q"), F.struct(*seq).alias("seq"))
    if start is not None:
        rows = rows.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.where(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    at = F.date_trunc(unit, F.col("ts")).cast("timestamp_ntz")
    return rows.groupBy("ticker", at.alias("bar_ts")).agg(
        F.min_by("p", "seq").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "seq").alias("close"), F.sum("q").alias("volume")
    )


def wide_to_long(wide: DataFrame, ts_col: str = "bar_ts", sep: str = "_") -> DataFrame:
    """Columns ``Field_TICKER`` to rows (ticker, ts, field...), field names lower-cased; rows null in all fields go."""
    cells = [c for c in wide.columns if c != ts_col]
    fields = sorted({c.split(sep, 1)[0].lower() for c in cells})
    tickers: dict[str, dict[str, str]] = {}
    for c in cells:
        field, ticker = c.split(sep, 1)
        tickers.setdefault(ticker, {})[field.lower()] = c
    row = lambda t: F.struct(F.lit(t).alias("ticker"), *[(F.col(f"`{tickers[t][f]}`") if f in tickers[t] else F.lit(None)).cast("double").alias(f) for f in fields])
    long = wide.select(ts_col, F.explode(F.array(*[row(t) for t in sorted(tickers)])).alias("r")).select(ts_col, "r.*")
    return long.where(F.coalesce(*[F.col(f) for f in fields]).isNotNull()).select("ticker", ts_col, *fields)


def sector_dimension(known: DataFrame, requested: DataFrame) -> DataFrame:
    """Exactly one row for each requested ticker: (ticker, sector, industry), null where unknown."""
    one = known.groupBy("ticker").agg(F.min(F.struct("sector", "industry")).alias("s"))
    return requested.select("ticker").distinct().join(one, "ticker", "left").select("ticker", "s.sector", "s.industry")


def sector_left_join(bars: DataFrame, sectors: DataFrame) -> DataFrame:
    """Adds sector and industry; ``Unknown`` where there is none. The dimension has one row a ticker and is broadcast by its size."""
    return bars.join(sectors, "ticker", "left").fillna("Unknown", ["sector", "industry"])


def sector_required_join(bars: DataFrame, sectors: DataFrame) -> DataFrame:
    """Adds sector and industry; rows without either go."""
    return bars.join(sectors.where("sector IS NOT NULL AND industry IS NOT NULL"), "ticker")


#: What a ticker dimension holds.
TICKERS = "ticker string, name string, aliases array<string>, sector string, tier int, cik string, instrument_type string, exchange string, benchmark string, suppliers array<string>, customers array<string>, underlying string"


def read_ticker_dimension(spark: SparkSession, path: str) -> DataFrame:
    """One row a ticker with its arrays and tier, from a list of mappings in a JSON (.json) or YAML file; keys that are absent are null.

    Spark reads the file, whatever store it lies in; JSON is parsed in Spark, YAML (with PyYAML)
    on the driver, as the dimension is a few rows.
    """
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith(".json"):
        rows = spark.createDataFrame([(text,)], "text string").select(F.explode(F.from_json("text", f"array<struct<{TICKERS.replace(' ', ':').replace(',:', ',')}>>")).alias("r"))
        return rows.select("r.*")
    import yaml

    names = [c.split()[0] for c in TICKERS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in yaml.safe_load(text) or []], TICKERS)


def ticker_universe(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """The bars of tickers that the universe lists."""
    return bars.join(universe.select("ticker"), "ticker", "left_semi")


def load_market_data(bars: DataFrame, sectors: DataFrame) -> DataFrame:
    """Sectors joined, time and volume cast, columns in order. Sorting is left to the sink."""
    df = sector_left_join(bars, sectors)
    return df.select("ticker", F.col("bar_ts").cast("timestamp_ntz").alias("bar_ts"), *PRICES, F.col("volume").cast("double").alias("volume"), "sector", "industry")


def write_parquet_snapshot(df: DataFrame, folder: str, name: str, now: datetime, partition: str = "ticker") -> str:
    """Writes ``folder/name_YYYYmmdd_HHMM.parquet``, a folder for each ticker, sorted by time within; returns the path."""
    path = f"{folder.rstrip('/')}/{name}_{now:%Y%m%d_%H%M}.parquet"
    df.repartition(partition).sortWithinPartitions(partition, "bar_ts").write.mode("overwrite").partitionBy(partition).parquet(path)
    return path


def stage_table(df: DataFrame, base: str, step: str) -> DataFrame:
    """Writes a step's table and reads it back, so that the next step starts from files."""
    path = f"{base.rstrip('/')}/{step}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
