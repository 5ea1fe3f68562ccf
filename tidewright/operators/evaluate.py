"""Walk-forward folds, linear models from Gram matrices, and score tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.windows import average_rank, full_mean, numbered


#: A decade from 1e-4 on and its fivefold, as the penalties of the walk-forward runs.
RIDGE_ALPHAS = sorted(m * 10.0**e for e in range(-4, 5) for m in (1, 5))
LASSO_ALPHAS = sorted(m * 10.0 ** (-4 + 5 * k / 19) for k in range(20) for m in (1, 5))


#: Sums of products that a task holds before it sends them on.
HELD_BYTES = 64 << 20


def date_ranks(df: DataFrame, ts: str = "bar_ts") -> DataFrame:
    """(ts, r, n): the distinct times numbered from the latest, 0 first, and their number; one row a time."""
    return numbered(df, ts, latest_first=True).withColumnRenamed("i", "r")


def cv_folds(df: DataFrame, n_splits: int | None = None, train: int = 63, test: int = 10, lookahead: int = 1, ts: str = "bar_ts") -> DataFrame:
    """(fold, part, ts): the times of each fold's test and training part.

    Times count back from the latest. Fold i tests on ranks [i*test, (i+1)*test) and trains on
    the ``train`` ranks that start ``lookahead`` after the test part; a fold whose training part
    would reach the first time or beyond is left out. n_splits: None for as many folds as the
    times allow. A time finds its folds from its own rank, so nothing is joined.
    """
    ranks = date_ranks(df, ts)
    # fold i exists if (i + 1) * test + lookahead + train < n
    last = F.floor((F.col("n") - lookahead - train - 1) / test) - 1
    last = last if n_splits is None else F.least(last, F.lit(n_splits - 1))
    tested = F.floor(F.col("r") / test)
    # it trains fold i if (i + 1) * test + lookahead <= r < (i + 1) * test + lookahead + train
    hi = F.floor((F.col("r") - lookahead) / test) - 1
    lo = F.greatest(F.floor((F.col("r") - lookahead - train) / test), F.lit(0))
    hi = F.least(hi, last)
    some = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<long>"))
    cells = F.concat(
        F.transform(some(tested, F.least(tested, last)), lambda i: F.struct(i.cast("int").alias("fold"), F.lit("test").alias("part"))),
        F.transform(some(lo, hi), lambda i: F.struct(i.cast("int").alias("fold"), F.lit("train").alias("part"))),
    )
    return ranks.select(ts, F.explode(cells).alias("c")).select("c.fold", "c.part", ts)


def fold_scaler(df: DataFrame, folds: DataFrame, columns: list[str], ts: str = "bar_ts") -> DataFrame:
    """(fold, column, mean, std): of training rows; a deviation of 0 counts as 1."""
    rows = df.join(folds.where("part = 'train'").select("fold", ts), ts)
    sums = rows.groupBy("fold").agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{i}").alias("mean"), F.when(F.col(f"s_{i}") == 0, 1.0).otherwise(F.col(f"s_{i}")).alias("std")) for i, c in enumerate(columns)])
    return sums.select("fold", F.explode(cells).alias("c")).select("fold", "c.*")


def fold_gram(df: DataFrame, folds: DataFrame, x: list[str], y: str, ts: str = "bar_ts", shift: dict[str, float] | None = None) -> DataFrame:
    """(fold, a, b, n, s): sums of products of the intercept ``1``, the columns x and y over training rows, a <= b by place.

    Products are summed by time first, in the Arrow batches of a task, and folds then add up the
    few rows of their times: a row of the panel is read once, however many folds it trains,
    and no fold's rows are gathered. shift: numbers to take from columns before, so that a large
    mean costs no digits.
    """
    names = ["1", *x, y]
    p = len(names)
    upper = np.triu_indices(p)
    off = np.array([(shift or {}).get(c, 0.0) for c in names])

    def summed(time: np.ndarray, values) -> tuple[np.ndarray, np.ndarray]:
        """Distinct times and the sums of the columns that values gives, by time."""
        order = np.argsort(time, kind="stable")
        cuts = np.flatnonzero(np.diff(time[order], prepend=time[order[:1]] - 1))
        return time[order[cuts]], np.concatenate([np.add.reduceat(v, cuts, axis=0) for v in values(order)], axis=1)

    def sent_on(times: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        cells = pa.ListArray.from_arrays(pa.array(np.arange(len(times) + 1) * len(upper[0]), pa.int32()), pa.array(sums.ravel()))
        return pa.RecordBatch.from_pydict({"t": pa.array(times, pa.int64()), "g": cells})

    def products(batches):
        empty = np.zeros(0, np.int64), np.zeros((0, len(upper[0])))
        times, sums = empty
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.column_stack([np.ones(b.num_rows), *(b.column(1 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(p - 1))]) - off
            t, s = summed(b.column(0).cast(pa.int64()).to_numpy(), lambda order, m=rows: (m[order, i:] * m[order, i, None] for i in range(p)))
            times, sums = summed(np.concatenate([times, t]), lambda order, s=np.concatenate([sums, s]): [s[order]])
            if sums.nbytes > HELD_BYTES:  # a task holds so much at most, however many times it sees
                yield sent_on(times, sums)
                times, sums = empty
        yield sent_on(times, sums)

    at = F.unix_micros(F.col(ts).cast("timestamp")).alias("t")
    sent = df.select(F.col(ts).cast("timestamp_ntz").alias("t"), *[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(names[1:])])
    by_time = sent.mapInArrow(products, "t long, g array<double>").select("t", F.posexplode("g").alias("k", "s")).groupBy("t", "k").agg(F.sum("s").alias("s"))
    train = folds.where("part = 'train'").select("fold", at)
    label = F.array(*[F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b")) for i, j in zip(*upper, strict=True)])
    sums = by_time.join(train, "t").groupBy("fold", "k").agg(F.sum("s").alias("s"))
    n = F.max(F.when(F.col("k") == 0, F.col("s"))).over(Window.partitionBy("fold")).cast("long")
    return sums.select("fold", "k", n.alias("n"), "s").select("fold", F.get(label, F.col("k")).alias("l"), "n", "s").select("fold", "l.a", "l.b", "n", "s")


def _system(pdf: pd.DataFrame, x: list[str], y: str):
    """Scaled Gram matrix and right side, means, deviations and row count of one fold; a deviation of 0 counts as 1."""
    at = {c: k for k, c in enumerate(["1", *x, y])}
    g = np.zeros((len(at), len(at)))
    i, j = pdf["a"].map(at).to_numpy(), pdf["b"].map(at).to_numpy()
    g[i, j] = g[j, i] = pdf["s"].to_numpy()
    n = g[0, 0]
    mean = g[0, 1:] / n
    c = g[1:, 1:] - n * np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(c), 0) / n)
    std[std <= 1e-12 * np.sqrt(np.maximum(np.diag(g)[1:], 0) / n)] = 0
    c[std == 0] = 0
    c[:, std == 0] = 0
    std[std == 0] = 1
    c /= np.outer(std, std)
    return c[:-1, :-1], c[:-1, -1], mean, std, n


def _lasso_path(g: np.ndarray, r: np.ndarray, penalties: list[float], tol: float, max_iter: int, sweeps: list[int] | None = None) -> list[np.ndarray]:
    """Coordinate descent with soft thresholds on a Gram matrix, for all penalties in descending order.

    Each penalty starts at the solution of the one before and sweeps over the features that the
    sequential strong rule (Tibshirani and others, 2012) leaves in; a feature that the optimality
    conditions miss is added and the sweeps go on, so what was screened out is proved out. sweeps:
    gets the number of coordinates visited for each penalty.
    """
    b, grad, out = np.zeros(len(r)), r.astype(float).copy(), {}
    usable = np.diag(g) > 0
    last, visited = np.abs(grad[usable]).max(initial=0.0), 0

    def sweep(features: np.ndarray) -> float:
        """One turn over the features; the largest change."""
        nonlocal visited, grad
        largest = 0.0
        for j in np.flatnonzero(features).tolist():
            rho = grad[j] + g[j, j] * b[j]
            new = np.sign(rho) * max(abs(rho) - lam, 0.0) / g[j, j]
            if new != b[j]:
                grad = grad - g[:, j] * (new - b[j])
                largest, b[j] = max(largest, abs(new - b[j])), new
            visited += 1
        return largest

    for lam in sorted(set(penalties), reverse=True):
        inside, left, visited = usable & ((np.abs(grad) >= 2 * lam - last) | (b != 0)), max_iter, 0
        while left > 0:
            moved, left = sweep(inside), left - 1
            while moved >= tol and left > 0:  # what isn't zero, until it stands still
                left -= 1
                if sweep(inside & (b != 0)) < tol:
                    break
            if moved < tol:
                missed = usable & ~inside & (np.abs(grad) > lam)
                if not missed.any():
                    break
                inside |= missed
        if sweeps is not None:
            sweeps.append(visited)
        out[lam], last = b.copy(), lam
    return [out[lam] for lam in penalties]


def _fit(df: DataFrame, folds: DataFrame, x: list[str], y: str, alphas: list[float], solve, ts: str) -> DataFrame:
    """One small system a fold, of columns scaled by the fold's training rows, solved for all alphas together."""
    wanted = [*x, y]
    means = df.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(wanted)]).first()
    shift = {c: float(m or 0.0) for c, m in zip(wanted, means, strict=True)}
    own = np.array([shift[c] for c in x])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g, r, mean, std, n = _system(pdf, x, y)
        fold, parts = int(pdf["fold"].iloc[0]), []
        for alpha, b in zip(alphas, solve(g, r, alphas, n), strict=True):
            slope = b * std[-1] / std[:-1]
            level = mean[-1] + shift[y] - (mean[:-1] + own) @ slope
            parts.append(pd.DataFrame({"fold": fold, "alpha": float(alpha), "feature": ["1", *x], "coef": [0.0, *b], "slope": [level, *slope]}))
        return pd.concat(parts)

    return fold_gram(df, folds, x, y, ts, shift).groupBy("fold").applyInPandas(run, "fold int, alpha double, feature string, coef double, slope double")


def ols(df: DataFrame, folds: DataFrame, x: list[str], y: str, ts: str = "bar_ts") -> DataFrame:
    """(fold, alpha 0, feature, coef, slope): least squares a fold; the shortest solution where columns depend on each other.

    coef: of x and y scaled to mean 0 and deviation 1 by the fold's training rows; slope: in the
    units of the columns, with the level under the feature ``1``. Rows have no nulls.
    """
    return _fit(df, folds, x, y, [0.0], lambda g, r, alphas, n: [np.linalg.lstsq(g, r, rcond=None)[0]], ts)


def ridge(df: DataFrame, folds: DataFrame, x: list[str], y: str, alphas: list[float] = RIDGE_ALPHAS, ts: str = "bar_ts") -> DataFrame:
    """As ols, with alpha on the diagonal of the scaled system."""
    return _fit(df, folds, x, y, alphas, lambda g, r, alphas, n: [np.linalg.lstsq(g + a * np.eye(len(r)), r, rcond=None)[0] for a in alphas], ts)


def lasso(df: DataFrame, folds: DataFrame, x: list[str], y: str, alphas: list[float] = LASSO_ALPHAS, tol: float = 1e-4, max_iter: int = 1000, ts: str = "bar_ts") -> DataFrame:
    """As ols, with a penalty n * alpha on absolute coefficients of the scaled system.

    Coefficients stand still to tol or max_iter sweeps are over. All penalties of a fold are one
    path with warm starts and screening.
    """
    return _fit(df, folds, x, y, alphas, lambda g, r, alphas, n: _lasso_path(g, r, [n * a for a in alphas], tol, max_iter), ts)


def predict(df: DataFrame, folds: DataFrame, models: DataFrame, x: list[str], y: str, ts: str = "bar_ts") -> DataFrame:
    """(fold, alpha, ticker, ts, predicted, actual) for the test rows of each fold, in the units of y."""
    by_fold = models.groupBy("fold", "alpha").agg(F.map_from_entries(F.collect_list(F.struct("feature", "slope"))).alias("_slopes"))
    rows = df.join(folds.where("part = 'test'").select("fold", ts), ts).join(by_fold, "fold")
    total = F.col("_slopes")["1"]
    for name in x:
        total = total + F.col("_slopes")[name] * F.col(name)
    return rows.select("fold", "alpha", "ticker", ts, total.alias("predicted"), F.col(y).alias("actual"))


def _of_folds(df: DataFrame, folds: DataFrame, models: DataFrame, x: list[str], y: str, ts: str, emit, schema: str) -> DataFrame:
    """emit(alphas, table, predicted rows x alphas, actual) for the complete test rows of each fold.

    A fold's models meet its rows once, whatever the number of penalties. Terms are added feature
    by feature, so equal rows have equal predictions.
    """
    rows = df.join(folds.where("part = 'test'").select("fold", ts), ts)
    rows = rows.select("fold", "ticker", F.col(ts).cast("timestamp_ntz").alias("ts"), *[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate([*x, y])])
    place = {c: k for k, c in enumerate(["1", *x])}

    def run(t: pa.Table, m: pa.Table) -> pa.Table:
        values = [t.column(f"c{k}").to_numpy().astype(float) for k in range(len(place))]
        ok = ~np.isnan(np.column_stack(values)).any(axis=1)
        t, values = t.filter(pa.array(ok)), [v[ok] for v in values]
        alphas = sorted(set(m.column("alpha").to_pylist()))
        slopes, at = np.full((len(place), len(alphas)), np.nan), {a: k for k, a in enumerate(alphas)}
        for alpha, feature, slope in zip(*(m.column(c).to_pylist() for c in ("alpha", "feature", "slope")), strict=True):
            slopes[place[feature], at[alpha]] = slope
        predicted = np.repeat(slopes[:1], t.num_rows, axis=0)
        for v, slope in zip(values[:-1], slopes[1:], strict=True):
            predicted += v[:, None] * slope
        return emit(alphas, t, predicted, values[-1])

    return rows.groupBy("fold").cogroup(models.select("fold", "alpha", "feature", "slope").groupBy("fold")).applyInArrow(run, schema)


def predict_paths(df: DataFrame, folds: DataFrame, models: DataFrame, x: list[str], y: str, ts: str = "bar_ts") -> DataFrame:
    """(fold, ticker, ts, alphas array, predicted array, actual): a row of the panel is one row, whatever the number of penalties; rows with a null or NaN are left out."""

    def emit(alphas: list[float], t: pa.Table, predicted: np.ndarray, actual: np.ndarray) -> pa.Table:
        n, a = predicted.shape
        cells = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * a, pa.int32()), pa.array(v.ravel()))
        return pa.table({"fold": t.column("fold"), "ticker": t.column("ticker"), ts: t.column("ts"), "alphas": cells(np.tile(alphas, (n, 1))), "predicted": cells(predicted), "actual": pa.array(actual)})

    return _of_folds(df, folds, models, x, y, ts, emit, f"fold int, ticker string, {ts} timestamp_ntz, alphas array<double>, predicted array<double>, actual double")


def _ranks(v: np.ndarray) -> np.ndarray:
    """Ranks of each column from 1, ties at their mean."""
    order = np.argsort(v, axis=0, kind="stable")
    s = np.take_along_axis(v, order, axis=0)
    new = np.concatenate([np.ones((1, v.shape[1]), bool), s[1:] != s[:-1]])
    place = np.broadcast_to(np.arange(len(v))[:, None], v.shape)
    first = np.maximum.accumulate(np.where(new, place, 0), axis=0)
    ends = np.concatenate([new[1:], np.ones((1, v.shape[1]), bool)])
    last = np.minimum.accumulate(np.where(ends, place, len(v))[::-1], axis=0)[::-1]
    out = np.empty(v.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, axis=0)
    return out


def walk_forward_scores(df: DataFrame, folds: DataFrame, models: DataFrame, x: list[str], y: str, ts: str = "bar_ts") -> DataFrame:
    """(fold, alpha, ts, n, ic, rmse) of the test rows: rank correlation in percent and root of the mean squared error of a time's rows.

    All penalties of a time are ranked as one matrix, in the task that has its fold: what is sent
    on is a row a time and penalty. ic is null with under 2 distinct values on a side. A task
    holds the test rows of a fold, that is some times of all tickers; for panels whose times hold
    more rows than a task can, take ``predict`` with ``daily_ic`` and ``daily_rmse``.
    """

    def emit(alphas: list[float], t: pa.Table, predicted: np.ndarray, actual: np.ndarray) -> pa.Table:
        time = t.column("ts").cast(pa.int64()).to_numpy()
        order = np.argsort(time, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(time[order], prepend=time[order[:1]] - 1)), len(order)) if len(order) else np.zeros(1, int)
        out = {c: [] for c in ("alpha", "t", "n", "ic", "rmse")}
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[i:j]
            p, y = predicted[at], actual[at]
            a, b = _ranks(p), _ranks(y[:, None])
            a, b = a - a.mean(axis=0), b - b.mean()
            size = np.sqrt((a * a).sum(axis=0) * (b * b).sum())
            out["ic"] += [float(v) if s > 0 else None for v, s in zip(100 * (a * b).sum(axis=0) / np.where(size > 0, size, 1), size, strict=True)]
            out["rmse"] += np.sqrt(((p - y[:, None]) ** 2).mean(axis=0)).tolist()
            out["alpha"] += alphas
            out["t"] += [int(time[at[0]])] * len(alphas)
            out["n"] += [int(j - i)] * len(alphas)
        fold = t.column("fold")[0].as_py() if t.num_rows else 0
        return pa.table({
            "fold": pa.array([fold] * len(out["n"]), pa.int32()), "alpha": pa.array(out["alpha"], pa.float64()), ts: pa.array(out["t"], pa.int64()).cast(pa.timestamp("us")),
            "n": pa.array(out["n"], pa.int64()), "ic": pa.array(out["ic"], pa.float64()), "rmse": pa.array(out["rmse"], pa.float64()),
        })

    return _of_folds(df, folds, models, x, y, ts, emit, f"fold int, alpha double, {ts} timestamp_ntz, n long, ic double, rmse double")


def daily_ic(preds: DataFrame, by: tuple[str, ...] = ("alpha",), ts: str = "bar_ts") -> DataFrame:
    """(by, ts, ic): rank correlation of predicted and actual in percent; null with under 2 distinct values on a side."""
    keys = [*by, ts]
    ranked = preds.where("predicted IS NOT NULL AND actual IS NOT NULL").select(*keys, average_rank(F.col("predicted"), *keys, ascending=True).alias("a"), average_rank(F.col("actual"), *keys, ascending=True).alias("b"))
    s = ranked.groupBy(*keys).agg(F.regr_sxx("a", "b").alias("bb"), F.regr_syy("a", "b").alias("aa"), F.regr_sxy("a", "b").alias("ab"))
    ic = F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.try_divide(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb"))) * 100)
    return s.select(*keys, ic.alias("ic"))


def daily_rmse(preds: DataFrame, by: tuple[str, ...] = ("alpha",), ts: str = "bar_ts") -> DataFrame:
    d = F.col("predicted") - F.col("actual")
    return preds.groupBy(*by, ts).agg(F.sqrt(F.avg(d * d)).alias("rmse"))


def alpha_scores(ic: DataFrame) -> DataFrame:
    """(alpha, mean_ic, is_best): mean IC by alpha; the best is the largest, ties to the smaller alpha."""
    means = ic.groupBy("alpha").agg(F.avg("ic").alias("mean_ic"))
    best = F.max_by(F.col("alpha"), F.struct(F.col("mean_ic"), -F.col("alpha"))).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return means.select("alpha", "mean_ic", (F.col("alpha") == best).alias("is_best"))


def coef_stats(coefs: DataFrame) -> DataFrame:
    return coefs.groupBy("alpha", "feature").agg(F.avg("coef").alias("mean_coef"), F.stddev_samp("coef").alias("std_coef"), F.avg(F.abs("coef")).alias("mean_abs"))


def top_features(stats: DataFrame, k: int = 10, by: str = "mean_coef") -> DataFrame:
    """The k features of the largest absolute value of each alpha, ties by name."""
    w = Window.partitionBy("alpha").orderBy(F.desc(F.abs(by)), "feature")
    return stats.select("*", F.row_number().over(w).alias("place")).where(F.col("place") <= k)


def feature_corr(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) for all ordered pairs of columns: over rows that have both; null without variance.

    An Arrow batch gives, as matrix products, each pair's count, sums, squares and products over
    the rows that have both; a few numbers a pair and task are then added up. Columns are shifted
    by their means first, so large ones cost no digits.
    """
    p = len(columns)
    found = df.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(columns)]).first()
    shift = np.array([float(m) if m is not None and np.isfinite(m) else 0.0 for m in found])

    def sums(batches):
        total = np.zeros((6, p, p))
        for b in batches:
            v = np.column_stack([b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(p)]) - shift
            has = np.column_stack([np.asarray(b.column(k).is_valid()) for k in range(p)]).astype(float)
            v = np.where(has > 0, v, 0.0)
            total += np.stack([has.T @ has, v.T @ has, has.T @ v, (v * v).T @ has, has.T @ (v * v), v.T @ v])
        i, j = np.divmod(np.arange(p * p), p)
        yield pa.RecordBatch.from_pydict({"i": i, "j": j} | {n: total[k].ravel() for k, n in enumerate(("n", "x", "y", "xx", "yy", "xy"))})

    rows = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(sums, "i long, j long, n double, x double, y double, xx double, yy double, xy double")
    s = rows.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    c = F.col
    varies = lambda q, m: c(q) - F.try_divide(c(m) * c(m), c("n"))
    real = lambda q, m: varies(q, m) > 1e-14 * c(q)
    corr = F.when(real("xx", "x") & real("yy", "y"), (c("xy") - c("x") * c("y") / c("n")) / (F.sqrt(varies("xx", "x")) * F.sqrt(varies("yy", "y"))))
    names = F.array(*[F.lit(x) for x in columns])
    return s.select(F.get(names, c("i").cast("int")).alias("a"), F.get(names, c("j").cast("int")).alias("b"), F.when(c("i") == c("j"), F.when(corr.isNotNull(), 1.0)).otherwise(corr).alias("corr"))


def strong_features(corr: DataFrame, least: float = 0.7) -> DataFrame:
    return corr.where((F.col("a") != F.col("b")) & (F.abs("corr") >= least)).select(F.col("a").alias("feature")).distinct()


def rolling_scores(scores: DataFrame, columns: list[str], n: int = 21, by: tuple[str, ...] = ("alpha",), ts: str = "bar_ts") -> DataFrame:
    """Means over the last n times, full windows only."""
    w = Window.partitionBy(*by).orderBy(ts)
    return scores.select(*by, ts, *[full_mean(F.col(c), n, w).alias(f"{c}_{n}") for c in columns]).where(" AND ".join(f"{c}_{n} IS NOT NULL" for c in columns))


def ic_distribution(ic: DataFrame, bins: int = 30) -> DataFrame:
    """(alpha, bin, n, mean_ic, median_ic): counts in even bins from the least to the greatest IC of an alpha.

    Rank correlations fall on edges of bins; what lies within rounding of an edge goes up.
    """
    rows = ic.where("ic IS NOT NULL")
    s = rows.groupBy("alpha").agg(F.avg("ic").alias("mean_ic"), F.median("ic").alias("median_ic"), F.min("ic").alias("lo"), F.max("ic").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor(F.try_divide(F.col("ic") - F.col("lo"), width) + 1e-9), F.lit(bins - 1))).otherwise(0)
    return rows.join(s, "alpha").select("alpha", at.cast("int").alias("bin"), "mean_ic", "median_ic").groupBy("alpha", "bin").agg(F.count("*").alias("n"), F.first("mean_ic").alias("mean_ic"), F.first("median_ic").alias("median_ic"))
