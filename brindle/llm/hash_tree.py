"""Sharding by a hierarchical weighted hash tree, in Spark expressions.

The tree has regions, racks and shards. At each level a node draws
-ln(u) / weight, with u hashed from the key and the node, and the least draw
wins, so a document descends with one draw per child of three nodes and not one
per shard. Weight that comes later is not added to a node but draws for itself,
beside the regions: a document that the new weight wins goes straight to the
shard that grew, and every other one descends as before. So documents move only
into what was added, and each addition costs one draw. A removed shard keeps its
place at the levels above; its documents go to the least draw of those that are
left in its rack, or of the racks left in its region, or of the regions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import cut, gapless

Tree = list[tuple[int, list[tuple[int, list[tuple[int, float]]]]]]
Growth = list[tuple[int, int, int, float]]

_SHARDS = "array<struct<id:int,weight:double>>"
_RACKS = f"array<struct<id:int,weight:double,below:{_SHARDS}>>"
_TOP = f"array<struct<id:int,weight:double,below:{_RACKS},event:int,rack:int,shard:int>>"


def even_tree(shards: int, shards_per_rack: int = 5, racks_per_region: int = 2) -> Tree:
    """[(region, [(rack, [(shard, weight)])])] for shards 0, 1, ... of weight 1.
    Beyond 40 shards racks and regions widen, so that the draws of a descent
    grow with the cube root of the shards."""
    wide = round(shards ** (1 / 3)) if shards > 40 else 0
    shards_per_rack, racks_per_region = max(shards_per_rack, wide), max(racks_per_region, wide)
    per_region = shards_per_rack * racks_per_region
    return [
        (g, [(r, [(s, 1.0) for s in range(r * shards_per_rack, min((r + 1) * shards_per_rack, shards))]) for r in range(g * racks_per_region, (g + 1) * racks_per_region) if r * shards_per_rack < shards])
        for g in range((shards + per_region - 1) // per_region)
    ]


def place_of(tree: Tree, shard: int) -> tuple[int, int]:
    """Region and rack for one more shard: those of the last shard while its
    rack has fewer shards than the first, else new ones."""
    region, racks = tree[-1]
    rack, leaves = racks[-1]
    if len(leaves) < len(tree[0][1][0][1]):
        return region, rack
    return (region, rack + 1) if len(racks) < len(tree[0][1]) else (region + 1, rack + 1)


def _table(tree: Tree, growth: Growth, removed: frozenset[int]) -> Column:
    """The tree as one constant: regions with what is below them, then growths."""
    def node(i: int, weight: float, below: list) -> dict:
        return {"id": i, "weight": weight, "below": below}

    rows = []
    for region, racks in tree:
        kept, total = [], 0.0
        for rack, leaves in racks:
            weight = float(sum(w for _, w in leaves))
            total += weight
            below = [{"id": s, "weight": float(w)} for s, w in leaves if w > 0 and s not in removed]
            kept += [node(rack, weight, below)] if below else []
        rows += [{**node(region, total, kept), "event": -1}] if kept else []
    for event, (region, rack, shard, weight) in enumerate(growth):
        rows += [{**node(region, float(weight), []), "event": event, "rack": rack, "shard": shard}] if weight > 0 and shard not in removed else []
    return F.from_json(F.lit(json.dumps(rows)), _TOP)


def _least(children: Column, level: int, key: Column, seed: int) -> Column:
    """The child of least draw; the hash's 53 bits are never all 0."""
    def draw(c: Column) -> Column:
        name = [F.lit(seed), F.lit(level), c["id"], *([c["event"]] if level == 0 else [])]
        u = (F.shiftrightunsigned(F.xxhash64(*name, key), 11).cast("double") + 0.5) / float(2**53)
        return F.struct((-F.ln(u) / c["weight"]).alias("draw"), c.alias("node"))

    return F.array_min(F.transform(children, draw))["node"]


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def place(rows: DataFrame, key: str, tree: Tree, growth: Growth = (), removed: frozenset[int] = frozenset(), seed: int = 3, out: str = "placed") -> DataFrame:
    """Add the struct ``out`` (region, rack, shard) from a tree, the weights
    added to it in turn as (region, rack, shard, weight), and removed shards. A
    null key is a key. Null if no shard has weight."""
    k = F.col(key)

    def named(region: Column, rack: Column, shard: Column) -> Column:
        return F.struct(region.alias("region"), rack.alias("rack"), shard.alias("shard"))

    def below(top: Column) -> Column:
        leaf = _bound(_least(top["below"], 1, k, seed), lambda rack: _bound(_least(rack["below"], 2, k, seed), lambda s: named(top["id"], rack["id"], s["id"])))
        return F.when(top["event"] >= 0, named(top["id"], top["rack"], top["shard"])).when(top.isNotNull(), leaf)

    return rows.withColumn(out, _bound(_least(_table(tree, list(growth), removed), 0, k, seed), below))


def shard_documents(docs: DataFrame, shards: int = 40, base: int | None = None, seed: int = 3) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, size, text_crc32,
    law (``key``), region, rack, shard, slot, grown_shard.

    ``base`` is the number of shards when the tree was laid out (all of them by
    default); those beyond came one by one, so raising ``shards`` by one moves
    rows only into the new one. The doc_id and the tree decide the shard, so
    equal texts need not meet and rows with a null doc_id share one shard. Size
    is the text's UTF-8 bytes plus 16; a null text has no bytes and checksum 0.
    Slots are gapless from 0 in each shard, in hashed order; repeated rows get
    slots of their own. An empty table gives an empty result; other columns are
    ignored.
    """
    tree, growth = even_tree(base or shards), []
    laid = [(g, [(r, list(leaves)) for r, leaves in racks]) for g, racks in tree]
    for s in range(base or shards, shards + 1):
        region, rack = place_of(laid, s)
        growth.append((region, rack, s, 1.0))
        if region == len(laid):
            laid.append((region, []))
        if not laid[-1][1] or laid[-1][1][-1][0] != rack:
            laid[-1][1].append((rack, []))
        laid[-1][1][-1][1].append((s, 1.0))
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data).cast("long").alias("text_crc32"))
    rows = place(rows, "doc_id", tree, growth[:-1], seed=seed, out="_now")
    rows = place(rows, "doc_id", tree, growth, seed=seed, out="_grown")
    rows = cut(
        rows.select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("_now.region").alias("region"), F.col("_now.rack").alias("rack"),
            F.col("_now.shard").alias("shard"), F.col("_grown.shard").alias("grown_shard"),
        )
    )
    return gapless(rows, ["shard"], ["doc_id", "size", "text_crc32"], "slot")
