"""Sharding by a hierarchical weighted hash tree.

A tree of regions, racks and shards carries integer weights; a node weighs what its shards weigh.  A
row descends from the root: at each level every child draws ``weight / -ln(u)`` with ``u`` a hash of
(key, child's path), and the largest draw wins.  A child's draw does not depend on its siblings, so a
changed weight moves rows only into or out of the subtree where it changed.  Growth by a subtree of its
own (:func:`grown`) therefore moves rows only into that subtree.

All expressions are Spark's own functions.  Slots are numbered per (shard, block), where blocks are
hashes of the key, and shifted by the counts of the blocks before, so that no task sorts a whole shard.

Cases: a null text has size 1 and the checksum of no bytes; a null key is hashed as the text 'null';
repeated rows get slots of their own; an empty table gives an empty result; columns of the input other
than the key and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leontia.llm.common import cut

Tree = dict[int, dict[int, dict[int, int]]]  # region -> rack -> shard -> weight

#: 16 shards: 4 regions of 2 racks of 2 shards.
DEFAULT_TREE: Tree = {r: {k: {4 * r + 2 * k + s: 1 for s in range(2)} for k in range(2)} for r in range(4)}
ROWS_PER_BLOCK = 4096


def weight(node) -> int:
    return node if isinstance(node, int) else sum(map(weight, node.values()))


def grown(tree: Tree, w: int = 1) -> Tree:
    """The tree with one more shard, in a region of its own."""
    shard = 1 + max(s for racks in tree.values() for shards in racks.values() for s in shards)
    return {**tree, 1 + max(tree): {0: {shard: w}}}


def _unit(key: Column, path: Column) -> Column:
    """A hash of (key, path) strictly between 0 and 1; md5, so that any engine can repeat it."""
    digest = F.md5(F.concat(key, F.lit("|"), path))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _nodes(node, path: str = "") -> dict[str, list[tuple[int, float]]]:
    """path -> (name, weight) of the children that weigh anything, for each inner node."""
    if isinstance(node, int):
        return {}
    out = {path: [(name, float(weight(c))) for name, c in node.items() if weight(c) > 0]}
    for name, c in node.items():
        out |= _nodes(c, f"{path}/{name}")
    return out


def assign(df: DataFrame, key: Column, tree: Tree, prefix: str = "") -> DataFrame:
    """Adds ``<prefix>region``, ``<prefix>rack`` and ``<prefix>shard``; only the children of the branch taken are drawn."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    nodes = F.create_map(*[x for path, cs in _nodes(tree).items() for x in (F.lit(path), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in cs]))])
    path = F.lit("")
    for level in ("region", "rack", "shard"):
        df = df.withColumn(prefix + level, _winner(key, nodes, path))
        path = F.concat(path, F.lit("/"), F.col(prefix + level).cast("string"))
    return df


def _winner(key: Column, nodes: Column, path: Column) -> Column:
    """The name of the child with the largest draw; the least name of equals."""

    def draw(child: Column) -> Column:
        unit = _unit(key, F.concat(path, F.lit("/"), child["name"].cast("string")))
        return F.struct((child["weight"] / -F.ln(unit)).alias("draw"), (-child["name"]).alias("n"))

    return -F.array_max(F.transform(F.element_at(nodes, path), draw))["n"]


def shard_documents(docs: DataFrame, tree: Tree = DEFAULT_TREE) -> DataFrame:
    """One row a document: shard by :func:`assign` on ``doc_id``, its gapless slot, and its shard in the tree grown by one."""
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"))
    rows = assign(rows, F.col("doc_id"), tree)
    rows = assign(rows, F.col("doc_id"), grown(tree), "grown_")
    rows = cut(rows)
    blocks = max(1, rows.count() // ROWS_PER_BLOCK)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "block").count().select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    at = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32")) - 1
    return (
        rows.withColumn("at", at)
        .join(starts, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), (F.col("start") + F.col("at")).cast("long").alias("slot"), F.col("grown_shard").cast("int"), F.col("region").cast("int"), F.col("rack").cast("int"))
    )
