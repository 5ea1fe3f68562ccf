"""Dropping lines that many documents share, with DataFrame functions only.

Lines are exploded as normalised hashes with their positions. A first count of rows by hash is
combined before it is shuffled and rules out nearly all of them; the rest is counted by distinct
document. What is to go comes back to a text as positions, and the text is cut and joined again
between them, so lines themselves are never shuffled and nothing is held by line but two hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import stored

#: Stripped at both ends of a line: \x20 and \x09 to \x0D.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hashes(line: Column) -> list[Column]:
    """128 bits of a line's key: even at 10^12 lines no two keys are expected to share them."""
    key = F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def _without(text: Column, gone: Column) -> Column:
    """(n_lines, kept): the text without the lines at the positions gone, sorted and distinct; null for none.

    Slices between neighbouring positions are copied, so the cost is that of the text, however
    many lines it has and loses.
    """

    def cut(lines: Column) -> Column:
        def between(edges: Column) -> Column:
            spans = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.struct((edges[i - 1] + 2).alias("at"), (edges[i] - edges[i - 1] - 1).alias("n")))
            return F.array_join(F.transform(F.filter(spans, lambda s: s["n"] > 0), lambda s: F.array_join(F.slice(lines, s["at"], s["n"]), "\n")), "\n")

        edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
        # an array of one element binds what the lambda uses many times
        return F.struct(F.size(lines).cast("long").alias("n_lines"), F.when(gone.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.transform(F.array(edges), between)[0]).alias("kept"))

    return F.transform(F.array(_lines(text)), cut)[0]


def drop_common_lines(docs: DataFrame, least_docs: int = 5, least_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""(doc_id, n_lines, n_dropped, kept), one row for each row of docs.

    Lines end at \n. A line's key is the line stripped of ``BLANK`` and with A-Z lower-cased; keys
    of at least least_chars code points that at least least_docs documents hold lose all their
    lines but those of the largest doc_id that holds it. Null and empty texts are one empty line.
    Rows of equal doc_id are one document in the count, and all of them keep what the largest id
    keeps; rows without an id are together one document, below all ids. Repeated lines of a text
    count once and are dropped or kept together. Very long texts are cut in one pass. Empty table:
    empty result. Other columns of docs are left out, so names can't clash.
    """
    text = F.col("text")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = docs.withColumn("t", F.xxhash64("text"))
    each = keyed.select("doc_id", "t", F.posexplode(_lines(text)).alias("pos", "line")).where(F.char_length(F.btrim("line", F.lit(BLANK))) >= least_chars)
    lines = stored(each.select("doc_id", "t", "pos", *_hashes(F.col("line"))), "lines")
    # rows are at least as many as documents: combined in the task, then one row a hash and task is shuffled
    often = stored(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs).select("h1", "h2"), "often")
    found = stored(lines.join(often, ["h1", "h2"]), "found")
    n_docs = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    hot = stored(found.groupBy("h1", "h2").agg(n_docs.alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= least_docs).select("h1", "h2", "last"), "hot")
    gone = found.join(hot, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    gone = gone.groupBy(F.col("doc_id").alias("g_id"), F.col("t").alias("g_t")).agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    whole = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("t") == F.col("g_t")), "left")
    cut = whole.select("doc_id", F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_dropped"), _without(text, F.col("gone")).alias("cut"))
    return cut.select("doc_id", "cut.n_lines", "n_dropped", "cut.kept")


def digest(df: DataFrame) -> DataFrame:
    """The columns of the registered query, from what drop_common_lines returns."""
    return df.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
