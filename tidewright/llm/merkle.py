"""A Merkle manifest of a dataset as a persistent tree: an altered leaf makes a version that copies its ancestors only.

Leaves are numbered within their group by a range sort and counts by partition, never by one
window. Aligned blocks of ``FAN ** LEVELS`` nodes are hashed in one task each and give one node
of the next tier, until a group has one; the groups' nodes are the leaves of a tree above them.
On the way down a block hands every node the siblings above it, once a block. So an altered leaf
finds all untouched nodes of its version there: within its block its ancestors are copied from
the block's own nodes, and the version continues through the tiers above with what was handed
down, on whatever executor the block lies.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.series import places
from tidewright.llm.common import stored

FAN = 16
#: Levels of a block: FAN ** LEVELS nodes are hashed by one task.
LEVELS = 2
_PATH = "array<struct<left:binary,right:binary>>"
_PATH_ARROW = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))


def _hash(*parts: bytes) -> bytes:
    """sha256 of digests as hex text, concatenated."""
    return sha256(b"".join(parts).hex().encode()).digest()


def _levels(n: int, most: int) -> int:
    """How many levels a block of a tier of n nodes has: all until one node remains, most if more tiers follow."""
    k = 0
    while n > 1 and k < most:
        n, k = -(-n // FAN), k + 1
    return k


def _climb(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """A block's nodes, level by level from its lowest to the one on top."""
    out = [nodes]
    for _ in range(levels):
        low = out[-1]
        out.append([_hash(*low[i : i + FAN]) for i in range(0, len(low), FAN)])
    return out


def _siblings(tree: list[list[bytes]], k: int) -> list[tuple[bytes, bytes]]:
    """Of the k-th node of a block: what stands left and right of it and of its ancestors in their runs."""
    out = []
    for level in tree[:-1]:
        i = k // FAN * FAN
        out.append((b"".join(level[i:k]), b"".join(level[k + 1 : i + FAN])))
        k //= FAN
    return out


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"i div {FAN**levels}"))


def _ordered(table: pa.Table, levels: int) -> tuple[pa.Table, list[list[bytes]]]:
    """A block's rows by place, and its nodes."""
    table = table.sort_by("i")
    return table, _climb(table.column("digest").to_pylist(), _levels(table.column("n")[0].as_py(), levels))


def _tiers(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """leaves (g, i, n, digest, ...) and above them the tiers of block tops, up to one node a group."""

    def top(table: pa.Table) -> pa.Table:
        table, tree = _ordered(table, levels)
        n = -(-table.column("n")[0].as_py() // FAN**levels)
        return pa.table({"g": table.column("g")[:1], "i": table.column("block")[:1], "n": pa.array([n], pa.int64()), "digest": pa.array(tree[-1], pa.binary())})

    tiers = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        nodes = _blocks(tiers[-1].select("g", "i", "n", "digest"), levels)
        tiers.append(stored(nodes.groupBy("g", "block").applyInArrow(top, "g string, i long, n long, digest binary"), "tier"))
        most = -(-most // FAN**levels)
    return tiers


def _paths(nodes: pa.Table, over: pa.Table, levels: int) -> tuple[pa.Table, list[list[dict]]]:
    """A block's rows by place, and of each the siblings up to the root: the block's own, then what was handed down."""
    nodes, tree = _ordered(nodes, levels)
    rest = over.column("path")[0].as_py()
    return nodes, [[*({"left": a, "right": b} for a, b in _siblings(tree, k)), *rest] for k in range(nodes.num_rows)]


def _handed_down(tiers: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """(g, i, path, subroot) of the tier over the leaves; above: the same of the top tier."""

    def down(nodes: pa.Table, over: pa.Table) -> pa.Table:
        nodes, paths = _paths(nodes, over, levels)
        subroots = pa.array([over.column("subroot")[0].as_py()] * nodes.num_rows, pa.binary())
        return pa.table({"g": nodes.column("g"), "i": nodes.column("i"), "path": pa.array(paths, _PATH_ARROW), "subroot": subroots})

    for nodes in reversed(tiers[1:-1]):
        left = _blocks(nodes, levels).groupBy("g", "block")
        above = stored(left.cogroup(above.withColumnRenamed("i", "block").groupBy("g", "block")).applyInArrow(down, f"g string, i long, path {_PATH}, subroot binary"), "paths")
    return above


def _field(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; null as a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row's values in order."""
    return F.unhex(F.sha2(F.concat(*[_field(v) for v in values]), 256))


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), altered: Mapping[str, Column] | None = None, proofs: bool = False, levels: int = LEVELS, id_col: str = "doc_id", group_col: str = "source") -> DataFrame:
    """(doc_id, source, place, leaf, subroot, root, proof_sha256, altered_leaf, copied, folded_root, verified), one row for each row of docs.

    A group's leaves ascend by doc_id, null first, rows of equal id by digest; place counts from 0.
    Every FAN consecutive nodes become their parent, a last run of fewer too, while a group has
    several; what remains is its subroot, and the subroots, null group first and then bytewise,
    become root likewise. altered: expressions over docs by column, as the rows are now; where
    their leaf differs, copied holds the digests of the copied ancestors from the leaf's parent to
    the version's root, and is empty elsewhere: all other nodes are the manifest's own.
    folded_root is computed from the altered leaf and the original siblings; verified says
    whether it is root. A row's siblings are hashed into proof_sha256; proofs=True adds them as
    proof. levels: of a block. Nulls, empty and very long values are values like any other, repeated rows are leaves
    of their own. Empty table: empty result. Other columns of docs are left out.
    """
    spark, altered = docs.sparkSession, dict(altered or {})
    own = [docs[f"`{c}`"] for c in columns]
    group = docs[f"`{group_col}`"].cast("string")
    # null sorts first and joins with itself as a string of its own
    g = F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group))
    rows = docs.select(g.alias("g"), docs[f"`{id_col}`"].cast("long").alias("id"), leaf(*own).alias("digest"), leaf(*[altered.get(c, v) for c, v in zip(columns, own, strict=True)]).alias("now"))
    leaves = stored(places(rows, "g", ["id", "digest"], "i", "n"), "numbered")
    tiers = _tiers(leaves, levels)
    groups = stored(places(tiers[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), "g", ["name"], "i", "n"), "groups")
    upper = _tiers(groups, levels)
    found = upper[-1].first()
    root = found["digest"] if found else b""
    start = spark.createDataFrame([("", 0, [], root)], f"g string, i long, path {_PATH}, subroot binary")
    over_groups = _handed_down(upper, start, levels)

    def of_groups(nodes: pa.Table, over: pa.Table) -> pa.Table:
        if not nodes.num_rows:  # no rows at all
            return pa.table({"g": pa.array([], pa.string()), "i": pa.array([], pa.int64()), "path": pa.array([], _PATH_ARROW), "subroot": pa.array([], pa.binary())})
        nodes, paths = _paths(nodes, over, levels)
        return pa.table({"g": nodes.column("name"), "i": pa.array([0] * nodes.num_rows, pa.int64()), "path": pa.array(paths, _PATH_ARROW), "subroot": nodes.column("digest")})

    low = _blocks(groups, levels).groupBy("g", "block")
    tops = stored(low.cogroup(over_groups.withColumnRenamed("i", "block").groupBy("g", "block")).applyInArrow(of_groups, f"g string, i long, path {_PATH}, subroot binary"), "paths")
    above = _handed_down(tiers, tops, levels)
    names = ["doc_id", "source", "place", "leaf", "subroot", "root", "proof_sha256", "altered_leaf", "copied", "folded_root", "verified"] + ["proof"] * proofs

    def versions(nodes: pa.Table, over: pa.Table) -> pa.Table:
        nodes, tree = _ordered(nodes, levels)
        rest = [(x["left"], x["right"]) for x in over.column("path")[0].as_py()]
        rest_text = b"".join(a + b for a, b in rest)
        hashed, copied, folded, whole = [], [], [], []
        for k, (old, new) in enumerate(zip(nodes.column("digest").to_pylist(), nodes.column("now").to_pylist(), strict=True)):
            path = _siblings(tree, k)
            hashed.append(sha256((b"".join(a + b for a, b in path) + rest_text).hex().encode()).hexdigest())
            version = [new]
            for a, b in (*path, *rest):
                version.append(_hash(a, version[-1], b))
            folded.append(version[-1].hex())
            copied.append([x.hex() for x in version[1:]] if new != old else [])
            if proofs:
                whole.append([{"left": a, "right": b} for a, b in (*path, *rest)])
        held = lambda x: pa.array([x] * nodes.num_rows, pa.string())
        hexed = lambda c: pa.array([x.hex() for x in nodes.column(c).to_pylist()], pa.string())
        found = root.hex()
        out = [
            nodes.column("id"), pa.array([x[1:] if x else None for x in nodes.column("g").to_pylist()], pa.string()), nodes.column("i"), hexed("digest"), held(over.column("subroot")[0].as_py().hex()),
            held(found), pa.array(hashed), hexed("now"), pa.array(copied, pa.list_(pa.string())), pa.array(folded), pa.array([x == found for x in folded]),
        ]
        return pa.table([*out, *([pa.array(whole, _PATH_ARROW)] if proofs else [])], names)

    schema = "doc_id long, source string, place long, leaf string, subroot string, root string, proof_sha256 string, altered_leaf string, copied array<string>, folded_root string, verified boolean" + f", proof {_PATH}" * proofs
    return _blocks(leaves, levels).groupBy("g", "block").cogroup(above.withColumnRenamed("i", "block").groupBy("g", "block")).applyInArrow(versions, schema)


def check(row_leaf: str, proof: list, root: str) -> bool:
    """Whether a leaf's digest and its proof (left and right siblings by level) give the root."""
    return reduce(lambda d, x: _hash(bytes(x["left"]), d, bytes(x["right"])), proof, bytes.fromhex(row_leaf)).hex() == root
