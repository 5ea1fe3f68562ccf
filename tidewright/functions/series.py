"""Splitting long series over tasks: places in a group without one window over it, chunks with halos."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions.windows import AT, HAND, TIES
from tidewright.sources.folders import stored

#: Rows of a chunk, where a caller asks for chunks without a length.
CHUNK = 1 << 16

#: Hands that a bucket of a held table is dealt to, so that a Python call takes a part of a bucket.
HANDS = 16

#: Rows of a bucket of a held table, where a caller knows how many there are.
BUCKET = HANDS * CHUNK


def places(df: DataFrame, group: str, order: Sequence[str], at: str = "place", total: str | None = None) -> DataFrame:
    """df with a row's place in its group by order, from 0, and the group's rows as total; a written table.

    A range sort over all groups, places within a task's part of a group, and counts by part: a
    group may lie in any number of tasks. Nulls come first. Rows that are equal in order are told
    apart by where they were read, so that they don't all go to one task; df should read stored
    tables without a shuffle, so that a task that runs again reads its rows in the same order.
    """
    kept, read = df.columns, f"{at}_read"
    by = [group, *order, read]
    parts = df.withColumn(read, F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).select(group, *[c for c in kept if c != group])
    # within a task these numbers are consecutive, so the least of a group's is where its rows begin
    parts = stored(parts.withColumn(f"{at}_local", F.monotonically_increasing_id()).withColumn(f"{at}_part", F.spark_partition_id()), "parts")
    per = parts.groupBy(group, f"{at}_part").agg(F.count("*").alias("_rows"), F.min(f"{at}_local").alias("_least"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy(f"{at}_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(F.col(group).alias("_group"), F.col(f"{at}_part").alias("_part"), (before - F.col("_least")).alias("_before"), F.sum("_rows").over(whole).alias("_total"))
    found = parts.join(per, parts[group].eqNullSafe(per["_group"]) & (parts[f"{at}_part"] == per["_part"]))
    return found.select(*kept, (F.col("_before") + F.col(f"{at}_local")).alias(at), *([F.col("_total").alias(total)] if total else []))


def buckets(spark: SparkSession, rows: int | None = None) -> int:
    """``spark.sql.shuffle.partitions``, or more for a table of so many rows that a bucket would have more than BUCKET: a task sorts one in memory."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows or 0) // BUCKET))


def held(df: DataFrame, name: str = "held", rows: int | None = None) -> DataFrame:
    """df written once, with the hand of each row's ticker and the row's number (HAND, AT): windows by ticker (``by_ticker``) over it, and over what keeps both columns, need no shuffle.

    There are ``buckets`` for rows, a bound of how many df has, and HANDS hands a bucket. Rows of
    a hand are numbered by ticker, time, and then by prices, volume and value, nulls first.
    Select before what is needed: all columns of df are written. A held table is given back as it
    is.
    """
    if {HAND, AT} <= set(df.columns):
        return df
    n = buckets(df.sparkSession, rows)
    dealt = df.withColumn(HAND, F.pmod(F.xxhash64("ticker"), F.lit(HANDS * n)).cast("int")).repartition(*([n] if rows else []), HAND)
    dealt = dealt.sortWithinPartitions(HAND, "ticker", "bar_ts", *[c for c in TIES if c in df.columns])
    return stored(dealt.withColumn(AT, F.monotonically_increasing_id()), name, HAND, n)


def extent(rows: DataFrame) -> tuple[int, int]:
    """The rows of a held table, and those of its longest series."""
    per = rows.groupBy(HAND, "ticker").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    return per[0] or 0, per[1] or 0


def longest(df: DataFrame, group: str = "ticker") -> int:
    """Rows of the longest series; 0 without rows."""
    return df.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def dealt(rows: int, *keys: str) -> Column:
    """The hand of a key, of so many that one holds about CHUNK of the rows, or one key's if these are more: a Python call a hand, not a key."""
    return F.pmod(F.xxhash64(*keys), F.lit(-(-rows // CHUNK) or 1))


def stretches(t: pa.Table, *keys: str) -> list[tuple[int, int]]:
    """Where each key's rows begin and end in a table that is sorted by keys; nulls are equal."""
    if not t.num_rows:
        return []
    codes = [t.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys]
    new = np.flatnonzero(np.logical_or.reduce([np.diff(c) != 0 for c in codes])) + 1
    return list(zip([0, *new.tolist()], [*new.tolist(), t.num_rows], strict=True))


def chunked(placed: DataFrame, rows: int, before: int, after: int = 0, at: str = "place") -> DataFrame:
    """placed with chunk and own: a row in its own chunk of so many rows, and as a halo in those that look back or ahead to it."""
    if rows < 1:
        raise ValueError("a chunk has a row at least")
    c = F.floor(F.col(at) / rows)
    first, last = F.floor((F.col(at) - after) / rows), F.floor((F.col(at) + before) / rows)
    # chunks that nothing lies in come up at a series' end: their rows are halo alone and go with them
    out = placed.withColumn("chunk", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), last)))
    return out.withColumn("own", F.col("chunk") == c)


def over_chunks(df: DataFrame, op: Callable[[DataFrame], DataFrame], before: int, after: int = 0, rows: int = CHUNK, order: Sequence[str] = ("bar_ts",)) -> DataFrame:
    """op(df) for an operator whose windows reach so many rows back and ahead in a ticker, with a ticker's rows dealt to any number of tasks.

    op sees a ticker's chunk with its halo as a ticker of its own: its windows are partitioned by
    (ticker, chunk). The result is op's at the rows of the chunks themselves, so it equals op(df)
    where op keeps its rows, and its row numbers only matter up to ``before``. Rows of one time
    come by order, then as they were read. df is written once.
    """
    df = stored(df, "series")
    d = chunked(places(df, "ticker", [*order, *[c for c in ("close", "high", "low", "open", "volume", "x") if c in df.columns and c not in order]]), rows, before, after)
    whole = d.withColumn("ticker", F.struct("ticker", "chunk")).drop("chunk")
    return op(whole).where("own").withColumn("ticker", F.col("ticker.ticker")).drop("own", "place")
