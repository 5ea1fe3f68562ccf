"""Covariances and weights for many portfolios at once.

Returns are long: (portfolio, bar_ts, asset, ret). Everything up to the matrices is aggregates;
the steps on a p x p matrix run in parallel over portfolios.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.sources.folders import stored

CLOSE = 1e-6
#: Assets of a side of a tile.
TILE = 256
#: Shares in which the tiles of tasks are merged first.
SHARES = 64
#: Products that a task holds before it sends them on.
HELD_BYTES = 128 << 20


def returns_wide(returns: DataFrame, assets: list[str]) -> DataFrame:
    """One column an asset, rows with all of them only."""
    wide = returns.groupBy("portfolio", "bar_ts").pivot("asset", assets).agg(F.first("ret"))
    return wide.where(" AND ".join(f"`{a}` IS NOT NULL" for a in assets))


def _complete(returns: DataFrame) -> DataFrame:
    """(portfolio, bar_ts, r array<struct<asset, ret>>): the times at which every asset of a portfolio has one return, by asset."""
    assets = returns.groupBy("portfolio").agg(F.countDistinct("asset").alias("p"))
    rows = returns.where("ret IS NOT NULL").groupBy("portfolio", "bar_ts").agg(F.array_sort(F.collect_list(F.struct("asset", "ret"))).alias("r"))
    full = (F.size("r") == F.col("p")) & (F.size(F.array_distinct(F.col("r.asset"))) == F.col("p"))
    return rows.join(assets, "portfolio").where(full).select("portfolio", "bar_ts", "r")


_TILE = "ti int, tj int, share int, assets_i array<string>, assets_j array<string>, n long, mean_i array<double>, mean_j array<double>, products binary"
_TILE_ARROW = [
    ("ti", pa.int32()), ("tj", pa.int32()), ("share", pa.int32()), ("assets_i", pa.list_(pa.string())), ("assets_j", pa.list_(pa.string())),
    ("n", pa.int64()), ("mean_i", pa.list_(pa.float64())), ("mean_j", pa.list_(pa.float64())), ("products", pa.binary()),
]


def _merged(a: tuple | None, b: tuple) -> tuple:
    """(n, mean_i, mean_j, centred products) of two sets of rows together."""
    if a is None:
        return b
    n = a[0] + b[0]
    di, dj = b[1] - a[1], b[2] - a[2]
    return n, a[1] + di * (b[0] / n), a[2] + dj * (b[0] / n), a[3] + b[3] + np.outer(di, dj) * (a[0] * b[0] / n)


def _tiles(complete: DataFrame) -> DataFrame:
    """(portfolio, ti, tj, assets, n, means, products): centred products of complete rows, in tiles of TILE assets a side, ti <= tj.

    A task multiplies the times that it has as matrices and sends one set of tiles on; sets are
    merged by tile, first within SHARES shares of them, with what their different means add
    (Chan, Golub and LeVeque, 1979). Nothing is made for each time and pair, and a portfolio's
    times and tiles lie in any number of tasks.
    """
    schema = f"portfolio {complete.schema['portfolio'].dataType.simpleString()}, {_TILE}"

    def row(key, ti, tj, share, names, sums):
        n, mi, mj, m = sums
        return {"portfolio": key, "ti": ti, "tj": tj, "share": share, "assets_i": names[0], "assets_j": names[1], "n": n, "mean_i": mi.tolist(), "mean_j": mj.tolist(), "products": m.tobytes()}

    def products(batches):
        share = TaskContext.get().partitionId() % SHARES
        held: dict = {}

        def sent(arrow: pa.Schema):
            for key, (names, n, mean, m) in held.items():
                for i in range(0, len(names), TILE):
                    for j in range(i, len(names), TILE):
                        x, y = slice(i, i + TILE), slice(j, j + TILE)
                        yield pa.RecordBatch.from_pylist([row(key, i // TILE, j // TILE, share, (names[x], names[y]), (n, mean[x], mean[y], np.ascontiguousarray(m[x, y])))], schema=arrow)
            held.clear()

        arrow = None
        for b in batches:
            if not b.num_rows:
                continue
            arrow = pa.schema([("portfolio", b.schema.field(0).type), *_TILE_ARROW])
            code = b.column(0).dictionary_encode()
            which = code.indices.to_numpy(zero_copy_only=False)
            r = b.column(1)
            at, p = r.offsets.to_numpy()[:-1] - r.offsets[0].as_py(), r.value_lengths().to_numpy()
            flat = r.flatten()
            ret, names = flat.field("ret").to_numpy(zero_copy_only=False).astype(float), flat.field("asset")
            for k, key in enumerate(code.dictionary.to_pylist()):
                rows = np.flatnonzero(which == k)
                cells = at[rows][:, None] + np.arange(p[rows[0]])
                x = ret[cells]
                mean = x.mean(axis=0)
                x -= mean
                before = held.get(key)
                n, m, _, s = _merged(None if before is None else (before[1], before[2], before[2], before[3]), (len(x), mean, mean, x.T @ x))
                held[key] = (before[0] if before else names.take(pa.array(cells[0])).to_pylist(), n, m, s)
            if sum(h[3].nbytes for h in held.values()) > HELD_BYTES:
                yield from sent(arrow)
        yield from sent(arrow)

    def merge(t: pa.Table) -> pa.Table:
        total = None
        for x in t.to_batches(max_chunksize=1):
            x = x.to_pylist()[0]
            mi, mj = np.array(x["mean_i"]), np.array(x["mean_j"])
            total = _merged(total, (x["n"], mi, mj, np.frombuffer(x["products"]).reshape(len(mi), len(mj))))
            head = x
        return pa.Table.from_pylist([row(head["portfolio"], head["ti"], head["tj"], head["share"], (head["assets_i"], head["assets_j"]), total)], schema=pa.schema([("portfolio", t.schema.field("portfolio").type), *_TILE_ARROW]))

    sent = complete.select("portfolio", "r").mapInArrow(products, schema)
    for keys in (("portfolio", "ti", "tj", "share"), ("portfolio", "ti", "tj")):
        sent = sent.groupBy(*keys).applyInArrow(merge, schema)
    return sent.drop("share")


def _cov(tiles: DataFrame) -> DataFrame:
    """(portfolio, i, j, cov) for i <= j."""

    @F.pandas_udf("array<struct<i:int,j:int,cov:double>>")
    def cells(products: pd.Series, n: pd.Series, p: pd.Series, q: pd.Series, diagonal: pd.Series) -> pd.Series:
        out = []
        for m, k, a, b, d in zip(products, n, p, q, diagonal, strict=True):
            m = np.frombuffer(m).reshape(a, b) / k
            i, j = np.triu_indices(a) if d else np.divmod(np.arange(a * b), b)
            out.append([{"i": x, "j": y, "cov": v} for x, y, v in zip(i.tolist(), j.tolist(), m[i, j].tolist(), strict=True)])
        return pd.Series(out)

    found = tiles.select("portfolio", "assets_i", "assets_j", F.explode(cells("products", "n", F.size("assets_i"), F.size("assets_j"), F.col("ti") == F.col("tj"))).alias("c"))
    return found.select("portfolio", F.get("assets_i", F.col("c.i")).alias("i"), F.get("assets_j", F.col("c.j")).alias("j"), "c.cov")


def sample_cov(returns: DataFrame) -> DataFrame:
    """(portfolio, i, j, cov) for i <= j: population covariance of complete rows only.

    A time at which an asset of the portfolio has no return is left out for all pairs. A row of
    all assets is gathered as an array, and tasks multiply their rows as matrices (``_tiles``).
    """
    return _cov(_tiles(_complete(returns)))


def ledoit_wolf(returns: DataFrame, cov: DataFrame | None = None) -> DataFrame:
    """(portfolio, i, j, cov, shrinkage) for i <= j: covariance of complete rows shrunk to a multiple of the identity (Ledoit and Wolf, 2004).

    Complete rows and their tiles are written once; the fourth moments are a fold over a row's
    array, less the means that the tiles hold.
    """
    complete = stored(_complete(returns), "complete")
    tiles = stored(_tiles(complete), "tiles")
    cov = _cov(tiles) if cov is None else cov
    both = F.when(F.col("i") == F.col("j"), 1).otherwise(2)
    s = cov.groupBy("portfolio").agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("cov"))).alias("trace"), F.sum(both * F.col("cov") * F.col("cov")).alias("norm"), F.count_if(F.col("i") == F.col("j")).alias("p"))
    means = tiles.where("ti = tj").groupBy("portfolio").agg(F.array_sort(F.collect_list(F.struct("ti", "mean_i"))).alias("m"), F.max("n").alias("n"))
    means = means.select(F.col("portfolio").alias("of"), F.flatten("m.mean_i").alias("mean"), "n")
    square = F.aggregate(F.zip_with("r.ret", "mean", lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda a, x: a + x)
    fourth = complete.join(means, F.col("portfolio").eqNullSafe(F.col("of"))).select("portfolio", "n", square.alias("q")).groupBy("portfolio").agg(F.sum(F.col("q") * F.col("q")).alias("q2"), F.max("n").alias("n"))
    c = F.col
    mu = c("trace") / c("p")
    delta = (c("norm") - 2 * mu * c("trace") + c("p") * mu * mu) / c("p")
    beta = F.least(delta, (c("q2") / c("n") - c("norm")) / (c("p") * c("n")))
    shrink = s.join(fourth, "portfolio").select("portfolio", mu.alias("mu"), F.when(beta == 0, 0.0).otherwise(F.coalesce(F.try_divide(beta, delta), F.lit(0.0))).alias("shrinkage"))
    out = cov.join(shrink, "portfolio")
    return out.select("portfolio", "i", "j", ((1 - c("shrinkage")) * c("cov") + F.when(c("i") == c("j"), c("shrinkage") * c("mu")).otherwise(0.0)).alias("cov"), "shrinkage")


def cov_to_corr(cov: DataFrame) -> DataFrame:
    """(portfolio, i, j, corr): clipped to +-1, diagonal 1; a zero deviation counts as 1e-10."""
    diag = cov.where("i = j").select("portfolio", F.col("i").alias("a"), F.when(F.sqrt("cov") == 0, 1e-10).otherwise(F.sqrt("cov")).alias("s"))
    joined = cov.join(diag.select("portfolio", F.col("a").alias("i"), F.col("s").alias("si")), ["portfolio", "i"]).join(diag.select("portfolio", F.col("a").alias("j"), F.col("s").alias("sj")), ["portfolio", "j"])
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cov") / (F.col("si") * F.col("sj"))))
    return joined.select("portfolio", "i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(r).alias("corr"))


def _matrix(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    names = sorted(set(pdf["i"]) | set(pdf["j"]))
    at = {a: k for k, a in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    i, j = pdf["i"].map(at).to_numpy(), pdf["j"].map(at).to_numpy()
    m[i, j] = m[j, i] = pdf["cov"].to_numpy()
    return names, m


def denoise_cov(cov: DataFrame, n_rows: DataFrame) -> DataFrame:
    """(portfolio, i, j, cov): eigenvalues under median * (1 + sqrt(p/n))^2 become their mean, at least 0.

    n_rows: (portfolio, n). One matrix a task row group, portfolios in parallel.
    """

    def fix(pdf: pd.DataFrame) -> pd.DataFrame:
        names, m = _matrix(pdf)
        val, vec = np.linalg.eigh(m)
        low = val < np.median(val) * (1 + np.sqrt(len(names) / pdf["n"].iloc[0])) ** 2
        if low.any():
            val[low] = val[low].mean()
        out = (vec * np.maximum(val, 0)) @ vec.T
        out = (out + out.T) / 2
        i, j = np.triu_indices(len(names))
        return pd.DataFrame({"portfolio": pdf["portfolio"].iloc[0], "i": [names[k] for k in i], "j": [names[k] for k in j], "cov": out[i, j]})

    kind = cov.schema["portfolio"].dataType.simpleString()
    return cov.join(n_rows, "portfolio").groupBy("portfolio").applyInPandas(fix, f"portfolio {kind}, i string, j string, cov double")


def _leaf_order(dist: np.ndarray) -> list[int]:
    """Leaves of the single-linkage tree, of every pair the cluster with the lower number first.

    Assets are numbered by place and clusters by creation, after all assets, as linkage tables
    number them. Assets join one at a time, always the nearest to those that have, from the first
    asset on; the steps of that walk are merged in order of length, ties in order of the walk.
    """
    n = len(dist)
    near, left, x, steps = np.full(n, np.inf), np.ones(n, bool), 0, []
    for _ in range(n - 1):
        left[x] = False
        near = np.minimum(near, dist[x])
        y = int(np.argmin(np.where(left, near, np.inf)))
        steps.append((float(near[y]), x, y))
        x = y
    members, owner = {k: [k] for k in range(n)}, list(range(n))
    for k, (_, a, b) in enumerate(sorted(steps, key=lambda s: s[0])):
        low, high = sorted((owner[a], owner[b]))
        members[n + k] = members.pop(low) + members.pop(high)
        for i in members[n + k]:
            owner[i] = n + k
    return next(iter(members.values()))


def _bisect(m: np.ndarray, order: list[int]) -> np.ndarray:
    """Recursive bisection by inverse-variance cluster risk (Lopez de Prado, 2016)."""
    w, todo = np.ones(len(m)), [order]

    def risk(part: list[int]) -> float:
        sub = m[np.ix_(part, part)]
        inv = 1 / np.maximum(np.diag(sub), 1e-300)
        inv /= inv.sum()
        return float(inv @ sub @ inv)

    while todo:
        part = todo.pop()
        if len(part) > 1:
            left, right = part[: len(part) // 2], part[len(part) // 2 :]
            a, b = risk(left), risk(right)
            share = 1 - a / (a + b) if a + b > 0 else 0.5
            w[left] *= share
            w[right] *= 1 - share
            todo += [left, right]
    return w


def hrp_weights(cov: DataFrame) -> DataFrame:
    """(portfolio, asset, weight): hierarchical risk parity; weights under 1e-4 become 0, rounded to 5 places.

    Distances are the roots of (1 - correlation) / 2, with correlations rounded to 6 places, and
    the tree is that of single linkage (``_leaf_order``). One matrix a portfolio, portfolios in
    parallel.
    """

    def fix(pdf: pd.DataFrame) -> pd.DataFrame:
        names, m = _matrix(pdf)
        s = np.sqrt(np.maximum(np.diag(m), 0))
        s = np.where(s == 0, 1e-10, s)
        corr = np.round(np.clip(m / np.outer(s, s), -1, 1), 6)
        w = _bisect(m, _leaf_order(np.sqrt((1 - corr) / 2)))
        w = np.where(np.abs(w) < 1e-4, 0, np.round(w, 5))
        return pd.DataFrame({"portfolio": pdf["portfolio"].iloc[0], "asset": names, "weight": w})

    kind = cov.schema["portfolio"].dataType.simpleString()
    return cov.groupBy("portfolio").applyInPandas(fix, f"portfolio {kind}, asset string, weight double")


def complete_rows(returns: DataFrame) -> DataFrame:
    """(portfolio, n): times at which every asset of the portfolio has a return."""
    return _complete(returns).groupBy("portfolio").agg(F.count("*").alias("n"))


def denoised(returns: DataFrame) -> DataFrame:
    """(portfolio, i, j, cov): shrunk, then denoised with the number of the complete rows that the covariance used."""
    return denoise_cov(ledoit_wolf(returns).drop("shrinkage"), complete_rows(returns))


def hrp_portfolio(returns: DataFrame) -> DataFrame:
    """(portfolio, asset, weight) from returns: shrinkage, denoising and hierarchical risk parity in one."""
    return hrp_weights(denoised(returns))


def dataset_profile(df: DataFrame, ticker: str = "ticker", ts: str = "bar_ts") -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(ticker).alias("n_tickers"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.lit(len(df.columns)).alias("n_columns"))


def _all():
    return Window.partitionBy("portfolio")


def _scaled(value: Column) -> Column:
    return F.try_divide(value, F.sum(value).over(_all()))


def long_only(weights: DataFrame) -> DataFrame:
    """Unchanged if none is negative and they sum to 1 within 1e-6; else negatives become 0 and the rest is scaled."""
    w = F.col("weight")
    fine = (F.min(w).over(_all()) >= 0) & (F.abs(F.sum(w).over(_all()) - 1) <= CLOSE)
    return weights.withColumn("weight", F.when(fine, w).otherwise(_scaled(F.greatest(w, F.lit(0.0)))))


def min_position(weights: DataFrame, least: float = 0.05) -> DataFrame:
    """Weights under least become 0 and the others are scaled; equal weights if none is left."""
    if least <= 0:
        return weights
    w = F.col("weight")
    kept = F.when(w >= least, w).otherwise(0.0)
    n = F.count("*").over(_all())
    return weights.withColumn("weight", F.when(F.count_if(w >= least).over(_all()) == 0, 1.0 / n).otherwise(_scaled(kept)))


def max_position(weights: DataFrame, most: float = 0.2, strict: bool = True) -> DataFrame:
    """Caps the largest weights one by one and scales the rest to what remains; ties by asset name.

    A single asset gets 1; portfolios with a null weight get nulls. Where the caps take all weight there is (nothing remains to scale),
    every asset gets 1/n. A cap under 1/n can't hold: an error, or null if not strict. In order
    of weight, the k-th is capped if, scaled to what the k-1 caps before leave, it would exceed
    the cap, and all before it were capped: prefix sums and one running minimum instead of a loop.
    """
    w, c = F.col("weight"), F.lit(float(most))
    order = Window.partitionBy("portfolio").orderBy(F.desc("weight"), "asset")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    n = F.count("*").over(_all())
    ranked = weights.select("*", n.alias("_n"), F.max(w).over(_all()).alias("_max"), F.row_number().over(order).alias("_k"), (F.sum(w).over(_all()) - F.coalesce(F.sum(w).over(before), F.lit(0.0))).alias("_rest"))
    ranked = ranked.withColumn("_over", (w * (1 - (F.col("_k") - 1) * c) > c * F.col("_rest") + 1e-12).cast("int"))
    ranked = ranked.withColumn("_cap", F.min("_over").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    budget = 1 - F.sum("_cap").over(_all()) * c
    rest = F.sum(F.when(F.col("_cap") == 0, w).otherwise(0.0)).over(_all())
    capped = F.when(rest > 0, F.when(F.col("_cap") == 1, c).otherwise(w * budget / F.when(rest > 0, rest))).otherwise(1.0 / F.col("_n"))
    low = F.raise_error(F.concat(F.lit(f"the cap {most} is under 1/"), F.col("_n").cast("string"))).cast("double") if strict else F.lit(None).cast("double")
    out = F.when(F.count(w).over(_all()) < F.col("_n"), None).when(F.col("_n") == 1, 1.0).when(c < 1.0 / F.col("_n"), low).when(F.col("_max") <= c + 1e-10, w).otherwise(capped)
    return ranked.select(*[x for x in weights.columns if x != "weight"], out.alias("weight"))


def constrained_weights(weights: DataFrame, least: float = 0.05, most: float = 0.2, strict: bool = True) -> DataFrame:
    """The three rules in turn; a portfolio whose weights don't sum to 1 is an error, or has sums_to_one false if not strict."""
    out = max_position(min_position(long_only(weights), least), most, strict)
    total = F.sum("weight").over(_all())
    fine = F.coalesce(F.abs(total - 1) <= CLOSE, F.lit(False))
    if strict:
        fine = F.when(fine, True).otherwise(F.raise_error(F.concat(F.lit("weights sum to "), F.coalesce(total.cast("string"), F.lit("null")))).cast("boolean"))
    return out.withColumn("sums_to_one", fine)
