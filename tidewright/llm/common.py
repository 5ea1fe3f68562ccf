"""What the operators of this package share: scratch tables, byte access, components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.sources.folders import scratch, stored

__all__ = ["components", "id_and_bytes", "opened", "regrouped", "scratch", "sliced", "stored"]


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path of a URI; s3a and s3n, Spark's names of s3, are taken for it."""
    scheme, rest = uri.split(":", 1)
    return pafs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + rest)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of so many rows at most: what is derived from a slice stays small. Spark bounds the bytes of a batch."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def id_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id as long and the whole text as UTF-8 bytes; other columns are left out, so names can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("data"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), both long: one row (node, root) for each node with a link.

    Each round maps every node to its neighbour (or itself) of the least hash and contracts the
    edges; the hash makes the number of nodes left fall by a constant factor whatever the order
    of ids. Edges shrink, so rounds get cheaper; each is a written table, not lineage.
    """
    e = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not e.isEmpty():
        both = e.union(e.select("b", "a")).toDF("u", "v")
        near = F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("to"))
        least = both.groupBy("u").agg(F.min(near).alias("m"))
        own = F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("to"))
        step = stored(least.select("u", F.least("m", own)["to"].alias("to")), "step")
        if labels is None:
            labels = step.select(F.col("u").alias("node"), F.col("to").alias("root"))
        else:
            labels = stored(
                labels.join(step.select(F.col("u").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")),
                "labels",
            )
        e = stored(
            e.join(step.select(F.col("u").alias("a"), F.col("to").alias("x")), "a")
            .join(step.select(F.col("u").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct(),
            "edges",
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return labels


def regrouped(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (node, root) of all edges so far, from labels, those of the earlier ones, and edges (a, b), the further ones.

    Edges are drawn between the roots found before, so the rounds are as many as the further
    edges need, however many there were earlier.
    """
    ends = [labels.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"]
    between = edges.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    more = components(between)
    moved = labels.join(more.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stored(moved.unionByName(more.join(labels.select("node"), "node", "left_anti")), "labels")
