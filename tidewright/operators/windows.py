"""Sliding windows over tickers, train and validation splits, batches and the manifest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import series
from tidewright.functions.windows import TIES, by_ticker, numbered
from tidewright.sources.folders import stored

BLOCK = "split string, block long, first long, size int, length int, pieces array<struct<ticker:string,start:long,n:long>>, features binary, targets binary"

#: Bytes and rows of tensors that a task sends on at once.
SENT, SENT_ROWS = 1 << 20, 256


def window_index(df: DataFrame, length: int = 60, split: bool = False) -> DataFrame:
    """(ticker, start, end_ts): one row a window, starts 0..n-length-1.

    The window that ends on a ticker's last row is left out; tickers of fewer than length + 1
    rows have none. No window is built: storage keeps this index and the panel. split: rows get
    their places by a range sort (``series.places``), so a ticker may lie in any number of tasks.
    """
    if split:
        at = series.places(stored(df.select("ticker", "bar_ts"), "times"), "ticker", ["bar_ts"], total="n")
        return at.where((F.col("place") >= length - 1) & (F.col("place") < F.col("n") - 1)).select("ticker", (F.col("place") - length + 1).alias("start"), F.col("bar_ts").alias("end_ts"))
    w = by_ticker()
    placed = df.select("ticker", "bar_ts", F.row_number().over(w).alias("rn"), F.lead(F.lit(1)).over(w).alias("more"))
    return placed.where((F.col("rn") >= length) & F.col("more").isNotNull()).select("ticker", (F.col("rn") - length).cast("long").alias("start"), F.col("bar_ts").alias("end_ts"))


def sliding_windows(df: DataFrame, features: list[str], targets: list[str], length: int = 60) -> DataFrame:
    """(ticker, start, features array<array<float>>, target array<float>): the index expanded.

    features: the window's rows in order; target: the target columns of its last row. Each value
    is cast to float before it is gathered, and the frame holds length rows.
    """
    w = by_ticker(df, *features, *targets)
    row = F.array(*[F.col(c).cast("float") for c in features])
    framed = df.select(
        "ticker", F.row_number().over(w).alias("rn"), F.lead(F.lit(1)).over(w).alias("more"),
        F.collect_list(row).over(w.rowsBetween(-(length - 1), 0)).alias("features"),
        F.array(*[F.col(c).cast("float") for c in targets]).alias("target"),
    )
    return framed.where((F.col("rn") >= length) & F.col("more").isNotNull()).select("ticker", (F.col("rn") - length).cast("long").alias("start"), "features", "target")


def time_split_date(df: DataFrame, cutoff: str) -> DataFrame:
    """Adds split: train up to the cutoff (a date alone: to the end of that day), val after."""
    end = F.lit(cutoff).cast("timestamp_ntz")
    train = F.col("bar_ts") < end + F.expr("INTERVAL 1 DAY") if len(cutoff) == 10 else F.col("bar_ts") <= end
    return df.withColumn("split", F.when(train, "train").otherwise("val"))


def split_time(df: DataFrame, ratio: float = 0.8) -> DataFrame:
    """One row cutoff: of the sorted distinct times the one at int(n * ratio); the last at most."""
    at = F.least(F.floor(F.col("n") * ratio), F.col("n") - 1)
    return numbered(df).where(F.col("i") == at).select(F.col("bar_ts").alias("cutoff"))


def time_split_ratio(df: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Adds split: train up to the time at the ratio, val after."""
    return df.join(F.broadcast(split_time(df, ratio))).withColumn("split", F.when(F.col("bar_ts") <= F.col("cutoff"), "train").otherwise("val")).drop("cutoff")


def check_split(split: DataFrame) -> dict[str, int]:
    """Rows of each side; an empty training side is an error."""
    n = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    if not n.get("train"):
        raise ValueError("the training side is empty")
    return n


def batches(df: DataFrame, length: int = 60, size: int = 32) -> DataFrame:
    """(split, ticker, start, idx, batch): windows of each side numbered in order of ticker and start.

    df has the column split, and a training row at least (an error otherwise); windows are built within a side, so none straddles the cut. Numbers
    are prefix sums over one row a ticker, plus the start within the ticker.
    """
    per = df.groupBy("split", "ticker").agg(F.greatest(F.count("*") - length, F.lit(0)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("split").orderBy("ticker").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    idx = F.col("before") + F.col("start")
    trained = F.max(F.col("split") == "train").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    per = per.withColumn("_ok", trained).where(F.when(F.col("_ok"), True).otherwise(F.raise_error(F.lit("the training side is empty")).cast("boolean")))
    starts = per.withColumn("before", before).where("n > 0").select("split", "ticker", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("start"))
    return starts.select("split", "ticker", "start", idx.alias("idx"), F.floor(idx / size).alias("batch"))


def blocks(df: DataFrame, features: list[str], targets: list[str], length: int = 60, size: int = 32, per_block: int = 64) -> DataFrame:
    """(split, block, first, size, length, pieces array<struct<ticker, start, n>>, features binary, targets binary): the panel, dealt by batches.

    A block holds the rows that its per_block batches of windows need, of whatever tickers these
    are: float32, rows after rows, a null as NaN. So a row is stored once, and again only in the
    length - 1 rows between blocks, and batches are cut from a block without any other. df has
    the column split and windows are built within a side, as in ``batches``, whose numbers these
    are. A block is a group of its own, of some thousand rows, so no ticker has to fit a task.
    """
    w = Window.partitionBy("split", "ticker").orderBy("bar_ts", *[c for c in TIES if c in df.columns])
    cast = lambda names: F.array(*[F.col(c).cast("float") for c in names])
    rows = df.select("split", "ticker", (F.row_number().over(w) - 1).cast("long").alias("r"), cast(features).alias("x"), cast(targets).alias("y"))
    per = df.groupBy("split", "ticker").agg((F.count("*") - length).alias("n")).where("n > 0")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("split").orderBy("ticker").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(per.select("split", "ticker", "n", before.alias("before")), ["split", "ticker"])
    deal = size * per_block
    first, last = F.greatest(F.col("r") - length + 1, F.lit(0)), F.least(F.col("r"), F.col("n") - 1)
    at = lambda start: F.floor((F.col("before") + start) / deal)
    # the last row of a side's ticker is in no window
    rows = rows.where(first <= last).withColumn("block", F.explode(F.sequence(at(first), at(last))))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("ticker", "ascending"), ("r", "ascending")])
        block, tickers = t.column("block")[0].as_py(), t.column("ticker").to_pylist()
        r, n, start = (t.column(c).to_numpy() for c in ("r", "n", "before"))
        cuts = [0, *(i for i in range(1, len(tickers)) if tickers[i] != tickers[i - 1]), len(tickers)]
        pieces = []
        for i in cuts[:-1]:
            low = max(0, block * deal - int(start[i]))
            pieces.append({"ticker": tickers[i], "start": low, "n": min(int(n[i]), (block + 1) * deal - int(start[i])) - low})
            assert r[i] == low  # a piece's rows begin with its first window
        raw = lambda c: np.asarray(t.column(c).combine_chunks().flatten(), np.float32).tobytes()
        return pa.table({
            "split": t.column("split")[:1], "block": [block], "first": [block * deal], "size": pa.array([size], pa.int32()), "length": pa.array([length], pa.int32()),
            "pieces": pa.array([pieces], pa.list_(pa.struct([("ticker", pa.string()), ("start", pa.int64()), ("n", pa.int64())]))), "features": [raw("x")], "targets": [raw("y")],
        })

    return rows.groupBy("split", "block").applyInArrow(pack, BLOCK)


def write_blocks(df: DataFrame, features: list[str], targets: list[str], path: str, length: int = 60, size: int = 32, per_block: int = 64) -> str:
    """Writes the blocks as Parquet, a folder for each split; returns path. An empty training side is an error."""
    check_split(df)
    blocks(df, features, targets, length, size, per_block).write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def _cut_block(b: pa.RecordBatch, i: int):
    """The batches of the block in row i of b, one after another; the block's bytes are read where they lie."""
    split, block_first, length, size, pieces = (b.column(c)[i].as_py() for c in ("split", "first", "length", "size", "pieces"))
    rows = sum(p["n"] + length - 1 for p in pieces)
    x, y = (np.frombuffer(b.column(c)[i].as_buffer(), np.float32).reshape(rows, -1) for c in ("features", "targets"))
    views, ends, at = [], [], 0
    for p in pieces:
        part = slice(at, at + p["n"] + length - 1)
        views.append(np.lib.stride_tricks.sliding_window_view(x[part], length, axis=0).transpose(0, 2, 1))
        ends.append(y[part][length - 1 :])
        at = part.stop
    for i in range(0, sum(map(len, views)), size):
        n = min(size, sum(map(len, views)) - i)
        out, target, filled, skipped = np.empty((n, length, x.shape[1]), np.float32), np.empty((n, y.shape[1]), np.float32), 0, 0
        for v, e in zip(views, ends, strict=True):
            lo, hi = max(0, i - skipped), min(len(v), i + n - skipped)
            if lo < hi:
                out[filled : filled + hi - lo], target[filled : filled + hi - lo] = v[lo:hi], e[lo:hi]
                filled += hi - lo
            skipped += len(v)
        yield split, (block_first + i) // size, block_first + i, n, length, out.tobytes(), target.tobytes()


def cut_batches(written: DataFrame) -> DataFrame:
    """(split, batch, first, n, length, features binary, targets binary): a batch a row, cut from blocks; ``tensors`` opens a row.

    features: n x length x columns float32, targets: n x columns. Windows are views of a block's
    rows until their batch is cut; a task holds what Spark hands it, and sends on about a
    megabyte at a time.
    """

    kinds = pa.schema([("split", pa.string()), ("batch", pa.int64()), ("first", pa.int64()), ("n", pa.int32()), ("length", pa.int32()), ("features", pa.binary()), ("targets", pa.binary())])

    def cut(batches):
        held, weight = [], 0
        for b in batches:
            for i in range(b.num_rows):
                for row in _cut_block(b, i):
                    held.append(row)
                    weight += len(row[-2]) + len(row[-1])
                    if weight >= SENT or len(held) >= SENT_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)
                        held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)

    return written.mapInArrow(cut, "split string, batch long, first long, n int, length int, features binary, targets binary")


def read_batches(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The batches of blocks that were written, of one split or all; only that split's folder is read."""
    written = spark.read.schema(BLOCK).parquet(path)
    return cut_batches(written if split is None else written.where(F.col("split") == split))


def tensors(batch) -> tuple[np.ndarray, np.ndarray]:
    """Features (windows x rows x columns) and targets (windows x columns) of a row of batches."""
    n = batch["n"]
    return np.frombuffer(batch["features"], np.float32).reshape(n, batch["length"], -1), np.frombuffer(batch["targets"], np.float32).reshape(n, -1)


def window_manifest(df: DataFrame, features: list[str], targets: list[str], length: int = 60, timeframe: str = "1d") -> DataFrame:
    """One row: timeframe, n_rows, n_windows, n_features, n_targets, sequence_len; from counts alone."""
    per = df.groupBy("ticker").agg(F.count("*").alias("n"))
    return per.agg(
        F.lit(timeframe).alias("timeframe"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.greatest(F.col("n") - length, F.lit(0))), F.lit(0)).alias("n_windows"),
        F.lit(len(features)).alias("n_features"), F.lit(len(targets)).alias("n_targets"), F.lit(length).alias("sequence_len"),
    )
