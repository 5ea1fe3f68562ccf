"""Checks over whole tables: each gives rows (check, column, n_bad, n_rows, failed)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPORT = "check string, column string, n_bad long, n_rows long, failed boolean"
#: Shares of the groups in which their first bad rows are cut to the first of all.
SHARES = 256
PRICES = ("open", "high", "low", "close")
#: What a bar table has to have.
BAR_SCHEMA = T.StructType([T.StructField("bar_ts", T.TimestampNTZType()), T.StructField("ticker", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in (*PRICES, "volume")]])


class DataValidationError(ValueError):
    """A check failed."""


def _report(counts: DataFrame, check: str, columns: list[str], failed) -> DataFrame:
    """Turns one row of counts (n_rows and one count a column) into report rows."""
    rows = F.array(*[F.struct(F.lit(check).alias("check"), F.lit(c).alias("column"), F.col(f"`bad_{i}`").alias("n_bad"), F.col("n_rows"), failed(F.col(f"`bad_{i}`"), F.col("n_rows")).alias("failed")) for i, c in enumerate(columns)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def _counts(df: DataFrame, bad: list[Column]) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(b).alias(f"bad_{i}") for i, b in enumerate(bad)])


def _schema_rows(df: DataFrame, required: T.StructType) -> list[tuple]:
    have = {f.name: type(f.dataType) for f in df.schema}
    rows = [("missing", f.name, int(f.name not in have), 1, f.name not in have) for f in required]
    return rows + [("type", f.name, int(have[f.name] is not type(f.dataType)), 1, have[f.name] is not type(f.dataType)) for f in required if f.name in have]


def validate_schema(df: DataFrame, required: T.StructType = BAR_SCHEMA) -> DataFrame:
    """Missing columns and types that differ, one row a required column, and one for an empty table.

    Types are compared by class; only columns that are present are compared. The schema is known
    without reading; emptiness reads one row.
    """
    known = df.sparkSession.createDataFrame(_schema_rows(df, required), REPORT)
    empty = df.limit(1).agg(F.count("*").alias("n")).select(F.lit("empty").alias("check"), F.lit("").alias("column"), (1 - F.col("n")).alias("n_bad"), F.col("n").alias("n_rows"), (F.col("n") == 0).alias("failed"))
    return known.unionByName(empty)


def validate_nulls(df: DataFrame, columns: list[str] | None = None, tolerance: float = 0.001) -> DataFrame:
    """A column fails if its share of nulls is over tolerance; an empty table fails."""
    columns = list(columns or df.columns)
    counts = _counts(df, [F.col(f"`{c}`").isNull() for c in columns])
    return _report(counts, "nulls", columns, lambda bad, n: (n == 0) | (bad > n * F.lit(tolerance)))


def validate_prices(df: DataFrame, min_price: float = 0.0, columns: tuple[str, ...] = PRICES) -> DataFrame:
    """A price column fails if a value that is not null lies under min_price; absent columns are left out."""
    columns = [c for c in columns if c in df.columns]
    counts = _counts(df, [F.col(c) < F.lit(min_price) for c in columns])
    return _report(counts, "prices", columns, lambda bad, n: bad > 0)


def price_sample(df: DataFrame, min_price: float = 0.0, n: int = 5) -> DataFrame:
    """Up to n rows with a price under min_price, for a message."""
    return df.where(reduce(lambda a, b: a | b, [F.col(c) < F.lit(min_price) for c in PRICES if c in df.columns])).limit(n)


def validate_monotonic(df: DataFrame, group: str = "ticker", seq: str = "seq", ts: str = "bar_ts") -> DataFrame:
    """Fails if a row's time lies before that of the row that arrived before it in its group; equal times pass."""
    before = F.lag(ts).over(Window.partitionBy(group).orderBy(seq))
    rows = df.select((F.col(ts) < before).alias("late"))
    return _report(_counts(rows, [F.col("late")]), "monotonic", [ts], lambda bad, n: bad > 0)


def validation_report(df: DataFrame, seq: str, tolerance: float = 0.001, min_price: float = 0.0, group: str = "ticker", ts: str = "bar_ts", required: T.StructType = BAR_SCHEMA) -> DataFrame:
    """Schema, nulls of the price columns, prices and order, with the first bad rows as detail: one scan gives all report rows.

    Columns that are missing fail in the schema's rows and are left out of the others. detail:
    up to 5 rows of prices and 3 of order as JSON, the first by seq and group. A group keeps its
    own first ones, which its running count of bad rows tells, and they are cut to the first
    again in shares of the groups and then over all, so no list grows with the bad rows.
    """
    prices = [c for c in PRICES if c in df.columns]
    w = Window.partitionBy(group).orderBy(seq)
    low = F.coalesce(reduce(lambda a, b: a | b, [F.col(c) < F.lit(min_price) for c in prices], F.lit(False)), F.lit(False))
    late = F.coalesce(F.col(ts) < F.lag(ts).over(w), F.lit(False))
    row = F.struct(F.col(seq).alias("seq"), *[F.col(c) for c in dict.fromkeys((group, ts, *prices)) if c != "seq"])
    flagged = df.select(*dict.fromkeys((group, seq, ts, *prices)), low.alias("_low"), late.alias("_late"))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flagged = flagged.select(F.col(group).alias("_group"), *prices, "_low", "_late", row.alias("_row"), *[F.count_if(c).over(upto).alias(f"{c}_n") for c in ("_low", "_late")])
    share = lambda bad, rows: (rows == 0) | (bad > rows * F.lit(tolerance))
    any_bad = lambda bad, rows: bad > 0
    none = F.array().cast("array<string>")
    checks = [("nulls", c, F.col(c).isNull(), share, None) for c in prices]
    checks += [("prices", c, F.col(c) < F.lit(min_price), any_bad, "_low") for c in prices] + [("monotonic", ts, F.col("_late"), any_bad, "_late")]
    counts = ["n_rows", *[f"bad_{i}" for i in range(len(checks))]]
    kept = {"_low": 5, "_late": 3}
    first = lambda rows, n: F.slice(F.array_sort(rows), 1, n)
    each = flagged.groupBy("_group").agg(
        F.count("*").alias("n_rows"), *[F.count_if(bad).alias(f"bad_{i}") for i, (_, _, bad, _, _) in enumerate(checks)],
        *[first(F.collect_list(F.when(F.col(c) & (F.col(f"{c}_n") <= n), F.col("_row"))), n).alias(c) for c, n in kept.items()],
    )
    together = [F.sum(c).alias(c) for c in counts] + [first(F.flatten(F.collect_list(c)), n).alias(c) for c, n in kept.items()]
    all_ = each.groupBy(F.pmod(F.xxhash64("_group"), F.lit(SHARES)).alias("_share")).agg(*together).agg(*together)
    all_ = all_.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in counts], *[F.transform(c, lambda x: F.to_json(x)).alias(c) for c in kept])
    n = F.col("n_rows")
    cell = lambda check, column, bad, rows, failed, detail=none: F.struct(F.lit(check).alias("check"), F.lit(column).alias("column"), bad.cast("long").alias("n_bad"), rows.cast("long").alias("n_rows"), failed.alias("failed"), detail.alias("detail"))
    cells = [cell(check, column, F.lit(bad), F.lit(rows), F.lit(failed)) for check, column, bad, rows, failed in _schema_rows(df, required)]
    cells += [cell("empty", "", (n == 0).cast("long"), F.least(n, F.lit(1)), n == 0)]
    cells += [cell(check, column, F.col(f"bad_{i}"), n, failed(F.col(f"bad_{i}"), n), F.when(F.col(f"bad_{i}") > 0, F.col(of)).otherwise(none) if of else none) for i, (check, column, _, failed, of) in enumerate(checks)]
    return all_.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def raise_if_failed(report: DataFrame) -> None:
    """Raises one error that names every failed check, with the rows that its detail holds; a report has a few rows."""
    bad = report.where("failed").collect()
    if bad:
        shown = dict.fromkeys(x for r in bad for x in (r["detail"] if "detail" in report.columns else ()))
        raise DataValidationError("; ".join([f"{r['check']} {r['column']}: {r['n_bad']} of {r['n_rows']}" for r in bad] + list(shown)))


def require_columns(df: DataFrame, columns: list[str]) -> None:
    """Raises one error that names all missing columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise DataValidationError(f"missing columns: {', '.join(missing)}")


def finite_check(df: DataFrame, columns: list[str], group: str = "ticker") -> DataFrame:
    """(group, n_null, n_nan): nulls and NaNs over the feature and target columns of each group."""
    require_columns(df, columns)
    total = lambda f: reduce(lambda a, b: a + b, [F.count_if(f(F.col(c))) for c in columns])
    return df.groupBy(group).agg(total(F.isnull).alias("n_null"), total(F.isnan).alias("n_nan"))
