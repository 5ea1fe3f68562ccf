"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every document of a source is to be taken e = target / source size times: floor(e) whole copies
are certain, and the rest is the inclusion odds of one further copy. Documents are ranked by
random odds divided by inclusion odds, u/(1-u) : p/(1-p), and a source's documents are taken in
that order up to the words that its certain copies leave open: a sample of fixed size, in words.
A weight makes p differ within a source: expected copies are in proportion to it, up to the limit
of copies, and what lies above the limit is shared again among the others. The number u is a
digest of seed, id and text, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import stored

#: Bins of a source's ranking, and of the bin that its cut falls into: a source is never sorted as a whole, only the inner bin of the cut.
BINS = 256
#: Shares in which the repeated rows at a source's cut are numbered.
SHARES = 1024
WORD = r"[^\x20\x09-\x0D]+"
#: Binary digits that a weight counts with: the weights of a source are grouped by value, and this bounds the groups.
DIGITS = 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, n_rows) from (source, size).

    Sources by code point, null last, take the weights in turn and share ``share`` of all sizes by
    weight. A target stops at ``most`` times its source's size, and the excess is reshared by
    weight: sources in ascending order of limit/weight are held at their limit as long as the
    level that the others would get lies above it. The windows run over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("held", F.col("limit") / F.col("w") <= F.col("level"))
    # held sources are a prefix of the order: the level of the first free one is everyone's
    free = F.min(F.when(~F.col("held"), F.struct((F.col("limit") / F.col("w")).alias("k"), F.col("level").alias("level")))).over(everything)["level"]
    return per.select("source", "source_size", "n_rows", F.when(F.col("held"), F.col("limit")).otherwise(F.col("w") * free).alias("target"))


def root_of_size(text: Column) -> Column:
    """1 + the whole square root of a text's words: longer texts are likelier, without crowding out short ones."""
    return F.floor(F.sqrt(n_words(text).cast("double"))).cast("double") + 1.0


def _weight(given: Column | None) -> Column:
    """A weight to DIGITS binary digits; null, NaN or negative: 0."""
    if given is None:
        return F.lit(1.0)
    w = given.cast("double")
    unit = F.pow(F.lit(2.0), F.floor(F.log2(w)) - (DIGITS - 1))
    return F.when((w > 0) & (w < float("inf")), F.floor(w / unit) * unit).otherwise(0.0)


def _drawn(id_col: str, text_col: str, source_col: str, weight: Column | None, seed: int) -> list[Column]:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return [F.col(id_col).cast("long").alias("_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), _weight(weight).alias("_w"), u.alias("_u"), digest.alias("_d")]


def _rates(keys: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """(source, source_size, target, rate): expected copies are least(weight * rate, most), and their words add up to the target.

    In descending order of weight, documents are held at the limit as long as the rate that the
    others would get puts them above it. Windows run over the distinct weights of a source.
    """
    per = keys.groupBy("source", "_w").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy(F.desc("_w"))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    mass = F.col("_w") * F.col("words")
    before = F.coalesce(F.sum("words").over(earlier), F.lit(0)) * F.lit(float(most))
    rest = F.sum(mass).over(whole) - F.coalesce(F.sum(mass).over(earlier), F.lit(0.0))
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    level = per.select("source", "_w", before.alias("before"), rest.alias("rest")).join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    level = level.withColumn("level", F.try_divide(F.col("target") - F.col("before"), F.col("rest")))
    free = F.max(F.when(F.col("_w") * F.col("level") <= most, F.struct("_w", "level")))["level"]
    # no weight is free: all that weigh anything are at the limit
    return level.groupBy("source").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.coalesce(free, F.lit(float("inf"))).alias("rate"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken, row struct), one row for each row of docs.

    copies: how often the mix takes the document, 0 to ceil(most); taken = copies * size. row
    holds all columns of docs, so clashing names are no trouble. Null text: size 0. Null source:
    a source of its own, last. Repeated rows are drawn alike and rank side by side; where the
    cut falls among them, as many are taken as come nearest to the target. Documents of size 0 are taken with their certain copies and by rank like all
    others. weight: an expression over docs, None for even odds; null, NaN or negative counts as
    0, and a document of weight 0 is never taken. Very long texts are single documents like any
    other. Empty table: empty result.
    """
    spark = docs.sparkSession
    drawn = docs.select(*_drawn(id_col, text_col, source_col, weight, seed), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    # sizes and draws alone are kept: a few dozen bytes a document, so that texts are read twice but never shuffled
    keys = stored(drawn.select("_id", "source", "size", "_w", "_u", "_d"), "draws")
    targets = source_targets(keys, weights, share, most)
    plan = stored(_rates(keys, targets, most), "plan")
    e = F.when(F.col("_w") > 0, F.least(F.col("_w") * F.col("rate"), F.lit(float(most)))).otherwise(0.0)
    p = e - F.floor(e)
    odds = F.col("_u") / (1 - F.col("_u"))
    ranked = [
        F.floor(e).cast("int").alias("whole"),
        # p = 0: never a further copy; odds are compared through q/(1+q), which lies between 0 and 1
        F.when(p > 0, odds / (p / (1 - p))).alias("q"),
    ]

    def placed(df: DataFrame) -> DataFrame:
        small = plan.select(F.col("source").alias("s"), "source_size", "target", "rate")
        df = df.join(small, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        return df.select("*", *ranked).withColumn("inner", F.floor(F.col("q") / (1 + F.col("q")) * (BINS * BINS)).cast("int"))

    at = placed(keys)
    open_words = at.groupBy("source").agg((F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("open"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def cut_of(rows: DataFrame, start: DataFrame) -> DataFrame:
        """(source, bin, before, open): the bin in which the words reach what is open; start: (source, before, open)."""
        bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(upto))
        found = bins.alias("b").join(start.alias("o"), F.expr("b.source <=> o.source")).select("b.source", "bin", (F.col("upto") + F.col("before")).alias("upto"), "words", "open").where("upto > open")
        return found.groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"), "open")).alias("c")).select("source", "c.bin", "c.before", "c.open")

    ranked_rows = at.where("q is not null")
    outer = stored(cut_of(ranked_rows.select("source", "size", F.floor(F.col("inner") / BINS).cast("int").alias("bin")), open_words.select("source", F.lit(0).cast("long").alias("before"), "open")), "bins")
    within = ranked_rows.alias("a").join(outer.alias("c"), F.expr(f"a.source <=> c.source AND floor(a.inner / {BINS}) = c.bin")).select("a.source", "a.size", F.col("a.inner").alias("bin"))
    cut_bin = stored(cut_of(within, outer.select("source", "before", "open")), "bins")
    # only the bin of the cut is ranked, a row a key: repeated rows share their draw and are counted
    inside = at.alias("a").join(cut_bin.alias("c"), F.expr("a.source <=> c.source AND a.inner = c.bin")).select("a.source", "a.size", "a.q", "a._id", "a._d", "c.before", "c.open", "c.bin")
    inside = inside.groupBy("source", "bin", "q", "_id", "_d", "size", "before", "open").agg(F.count("*").alias("n"))
    running = Window.partitionBy("source").orderBy("q", F.col("_id").asc_nulls_first(), "_d").rowsBetween(Window.unboundedPreceding, -1)
    short = F.col("open") - F.col("before") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(running), F.lit(0))
    # the document that the cut falls into is taken if that comes nearer to the target; of repeated rows, as many as come nearest
    fit = F.when(F.col("size") == 0, F.when(short >= 0, F.col("n")).otherwise(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("n"), F.floor(short / F.col("size") + 0.5)))).cast("long")
    last = inside.withColumn("fit", fit).where("fit > 0").groupBy("source", "bin").agg(F.max(F.struct("q", "_id", "_d", "fit", "n")).alias("last"))
    cuts = stored(
        cut_bin.alias("c").join(last.alias("l"), F.expr("c.source <=> l.source"), "left").select(F.col("c.source").alias("cs"), F.col("c.bin").alias("cut"), F.struct("l.last.q", "l.last._id", "l.last._d").alias("last"), (F.col("l.last.n") > F.col("l.last.fit")).alias("partly"), F.col("l.last.fit").alias("fit")),
        "cuts",
    )
    full = placed(drawn)
    full = full.join(cuts, F.col("source").eqNullSafe(F.col("cs")), "left")
    key = F.struct("q", "_id", "_d")
    extra = F.when(F.col("q").isNull(), False).when(F.col("cut").isNull() | (F.col("inner") < F.col("cut")), True).when(F.col("inner") > F.col("cut"), False).otherwise(F.coalesce(key <= F.col("last"), F.lit(False)))

    def taken(df: DataFrame, one_more: Column) -> DataFrame:
        copies = F.col("whole") + one_more.cast("int")
        return df.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "row")

    if cuts.where("partly").isEmpty():
        return taken(full, extra)
    # repeated rows at a cut: numbered within shares of them, and by the counts of the shares before
    tie = F.coalesce(F.col("partly") & (F.col("inner") == F.col("cut")) & key.eqNullSafe(F.col("last")), F.lit(False))
    ties = full.where(tie).withColumn("_share", F.monotonically_increasing_id() % SHARES)
    counts = ties.groupBy("source", "_share").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = stored(counts.select(F.col("source").alias("_s"), F.col("_share").alias("_k"), before.alias("_before")), "shares")
    number = F.row_number().over(Window.partitionBy("source", "_share").orderBy("_share"))
    ties = ties.withColumn("_number", number).join(counts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_share") == F.col("_k")))
    return taken(full.where(~tie), extra).unionByName(taken(ties, F.col("_before") + F.col("_number") <= F.col("fit")))
