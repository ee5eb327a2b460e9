"""Sharding by a hierarchical weighted hash tree (law ``key``).

A tree of regions, racks and shards has a weight per shard; a node weighs as
much as its shards. A document descends level by level: each child of a node
draws -ln(u) / weight with u from the hash of (document key, child), and the
least draw wins. So a child gets rows in proportion to its weight, and a child's
draw depends on the document, its own name and its own weight alone: when
weights change, rows move only into or out of subtrees whose weights changed.

``layout`` places the first ``founded`` shards in racks of 4 and regions of 3
racks; every later shard is a region of its own until a new layout is planned.
So one more shard changes no other subtree's weight and takes rows only into
itself. The children of all nodes are one literal map, so the plan does not grow
with the tree beyond that literal.

Slots number the rows of each shard without gaps in (doc_id, text CRC, size,
scan order): one range shuffle of narrow rows (no texts; scan order splits a hot
doc_id), written once, then counts per (range, shard) give each range's first
slot.

Defined cases: a NULL doc_id is the key ''; a NULL text has size 8 and CRC 0;
rows of equal doc_ids share a shard; repeated rows get a slot each; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.sizing import maybe_broadcast
from docmill.llm.common import quoted, written

RACK, REGION = 4, 3

Tree = dict[str, dict[str, dict[int, float]]]


def layout(shards: int, founded: int = 24) -> Tree:
    """Regions -> racks -> {shard: weight}, weight 1 each."""
    tree: Tree = {}
    for s in range(shards):
        rack = s // RACK
        region, rack = (f"r{rack // REGION}", f"r{rack // REGION}.{rack % REGION}") if s < founded \
            else (f"n{s}", f"n{s}.0")
        tree.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return tree


def children(tree: Tree) -> dict[str, list[tuple[str, float]]]:
    """Name and weight of each node's children; the root's name is ''."""
    weight = {region: {rack: sum(shards.values()) for rack, shards in racks.items()} for region, racks in tree.items()}
    out = {"": [(region, sum(racks.values())) for region, racks in weight.items()]}
    for region, racks in tree.items():
        out[region] = list(weight[region].items())
        for rack, shards in racks.items():
            out[rack] = [(str(s), w) for s, w in shards.items()]
    return {node: [(name, float(w)) for name, w in below if w > 0] for node, below in out.items()}


def draw(key: Column, name: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of md5(key/name)."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), name).cast("binary")), 1, 13), 16, 10)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 52)) / weight


def place(key: Column, tree: Tree) -> Column:
    """The shard of a string key: three descents by least draw."""
    below = F.create_map(*[x for node, kids in children(tree).items() for x in (
        F.lit(node), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in kids]))])
    node = F.lit("")
    for _ in ("region", "rack", "shard"):
        kids = F.element_at(below, node)
        node = F.array_min(F.transform(kids, lambda c: F.struct(
            draw(key, c["name"], c["weight"]).alias("draw"), c["name"].alias("name"))))["name"]
    return node.cast("int")


def shard(docs: DataFrame, tree: Tree, grown: Tree | None = None, doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard (the shard in the
    tree ``grown``, else NULL) of every row."""
    body = F.coalesce(F.col(quoted(text)).cast("binary"), F.lit(b""))
    key = F.coalesce(F.col(quoted(doc_id)).cast("string"), F.lit(""))
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"),
                       F.crc32(body).alias("text_crc32"), key.alias("key"),
                       F.monotonically_increasing_id().alias("o"))
    rows = rows.withColumn("shard", place(F.col("key"), tree)).withColumn(
        "grown_shard", place(F.col("key"), grown) if grown else F.lit(None).cast("int"))
    order = ["shard", "doc_id", "text_crc32", "size", "o"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "doc_id", "size", "text_crc32", "shard", "grown_shard", F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"))
    done = written(ranged, "shards")
    counts = done.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    starts = counts.select("part", "shard", (before - F.col("first")).alias("shift"))
    return done.join(maybe_broadcast(starts), ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("pos") + F.col("shift")).alias("slot"), "grown_shard")
