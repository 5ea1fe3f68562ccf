"""Incremental validation: new bar files are read as a stream, checked batch by batch, and parted into good and bad rows.

What a batch has to know of those before it is the time of each ticker's last row. That state is
a table with a version for each batch: a batch reads the version before its own and writes its
own, so a batch that is run again after a failure, or in a later call, sees what it saw before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions import series
from tidewright.functions.windows import by_ticker
from tidewright.operators.validate import PRICES
from tidewright.sources.folders import exists, remove


def flagged(batch: DataFrame, seq: str = "seq", min_price: float = 0.0, last: DataFrame | None = None, chunk: int = series.CHUNK) -> DataFrame:
    """Adds reason: the first rule that a row breaks, null for good rows.

    last: (ticker, last_ts), the time of each ticker's last row before this batch. A row is late
    if its time lies before that of the row that arrived before it; equal and null times pass.
    A ticker with more than chunk rows is dealt to tasks by chunk.
    """
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in PRICES])
    low = reduce(lambda a, b: a | b, [F.col(c) < F.lit(min_price) for c in PRICES])

    def arrived(df: DataFrame) -> DataFrame:
        w = by_ticker(df, ts=seq)
        return df.withColumns({"_first": F.lag(F.lit(1)).over(w).isNull(), "_before": F.lag("bar_ts").over(w)})

    rows = arrived(batch) if series.longest(batch) <= chunk else series.over_chunks(batch, arrived, 1, 0, chunk, (seq,))
    before = F.col("_before")
    if last is not None:
        held = last.select(F.col("ticker").alias("_ticker"), "last_ts")
        rows = rows.join(held, F.col("ticker").eqNullSafe(F.col("_ticker")), "left")
        before = F.when(F.col("_first"), F.col("last_ts")).otherwise(before)
    return rows.withColumn("reason", F.when(null, "null").when(low, "price").when(F.col("bar_ts") < before, "order")).drop("_first", "_before", "_ticker", "last_ts")


def last_times(batch: DataFrame, seq: str = "seq", last: DataFrame | None = None) -> DataFrame:
    """(ticker, last_ts): the time of each ticker's last row, from this batch or else from those before."""
    now = batch.groupBy("ticker").agg(F.max_by(F.struct("bar_ts"), seq)["bar_ts"].alias("last_ts"))
    if last is None:
        return now
    mine = now.select(F.col("ticker").alias("_ticker"))
    return now.unionByName(last.join(mine, F.col("ticker").eqNullSafe(F.col("_ticker")), "left_anti"))


def incremental_validate(spark: SparkSession, source: str, schema: T.StructType, good: str, bad: str, checkpoint: str, seq: str = "seq", min_price: float = 0.0, files_per_batch: int | None = None, chunk: int = series.CHUNK) -> None:
    """Handles all files that have come since the last call, once each, and returns.

    Each batch is written under its own number and overwrites it if it is run again after a
    failure, so a batch counts once. Order is judged over all batches: a row that is late against
    an earlier batch is bad. seq has to ascend from batch to batch within a ticker. The versions
    of the state lie beside the checkpoint, and the last two are kept.
    """
    state = f"{checkpoint.rstrip('/')}-last"
    kind = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("last_ts", schema["bar_ts"].dataType)])

    def write(batch: DataFrame, number: int) -> None:
        known = spark.read.schema(kind).parquet(f"{state}/batch={number - 1}").select("ticker", "last_ts") if exists(spark, f"{state}/batch={number - 1}") else None
        batch.persist()  # read by the jobs below; what is lost is read again from the files
        rows = flagged(batch, seq, min_price, known, chunk)
        rows.where("reason IS NULL").drop("reason").write.mode("overwrite").parquet(f"{good}/batch={number}")
        rows.where("reason IS NOT NULL").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        last_times(batch, seq, known).write.mode("overwrite").parquet(f"{state}/batch={number}")
        remove(spark, f"{state}/batch={number - 2}")
        batch.unpersist()

    stream = spark.readStream.schema(schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    stream.parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
