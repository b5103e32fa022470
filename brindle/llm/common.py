"""Pieces shared by the training-data operators: lineage cuts in the shared
folder, gapless numbering without one task per key, block pairs for hot
groups, and connected components."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.
    Only where that is unset and the master is local, as in tests, a temporary
    folder is taken."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="brindle-shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder; a lost executor costs no recompute."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores before it that ``df`` has no
    column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def refuse_taken(df: DataFrame, names: list[str]) -> None:
    if clash := {c.lower() for c in df.columns} & {n.lower() for n in names}:
        raise ValueError(f"the table has columns {sorted(clash)}; name the new ones otherwise")


def word_count(text: Column) -> Column:
    """Number of words of a text, null counting none."""
    words = F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    return F.when(text.isNull(), 0).otherwise(words).cast("long")


def gapless(df: DataFrame, keys: list[str], order: list[str], out: str, rows_per_bucket: int = 20_000) -> DataFrame:
    """Add ``out``: numbers 0, 1, 2, ... within ``keys``, in seeded order.

    No task holds a whole key: rows are numbered inside hash buckets of
    ``order`` and each bucket starts where the buckets before it end. ``df``
    is read three times, so pass a materialised one.
    """
    buckets = max(1, math.ceil(df.count() / rows_per_bucket))
    with_bucket = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    places = with_bucket.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = places.select(*keys, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(F.xxhash64(F.lit(7), *order), *order)
    joined = with_bucket.join(places, [*keys, "_bucket"])
    return joined.withColumn(out, (F.row_number().over(within) - 1 + F.col("_before")).cast("long")).drop("_bucket", "_before")


def block_pairs(df: DataFrame, group: list[str], item: str, blocks: Column) -> DataFrame:
    """Deal the rows of each group into ``blocks`` blocks and repeat each row
    once for every pair of blocks it belongs to (``_lo`` <= ``_hi``); ``_block``
    is the row's own. Each pair of rows of a group meets in exactly one pair."""
    dealt = df.withColumn("_blocks", F.greatest(blocks.cast("int"), F.lit(1)))
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64(F.lit(11), item), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumn("_lo", F.least("_block", "_other")).withColumn("_hi", F.greatest("_block", "_other")).drop("_other", "_blocks")


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salt_by: list[str], rows: int, how: str = "inner", salts: int = 32) -> DataFrame:
    """Join on ``keys``, of which ``small`` has each once. A key with more than
    a thousandth of the ``rows`` of ``big`` (of such there are fewer than a
    thousand, so they are broadcast) is dealt by a hash of ``salt_by``."""
    if rows < 512:  # few for any task
        return big.join(small, keys, how)
    hot = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max(64, rows // 1000)).select(*keys)
    return _dealt_join(big, small, keys, salt_by, hot, how, salts)


def _dealt_join(big: DataFrame, small: DataFrame, keys: list[str], salt_by: list[str], hot: DataFrame | None, how: str, salts: int = 32) -> DataFrame:
    """Join on ``keys``; those in ``hot``, a few, are dealt by a hash of ``salt_by``."""
    if hot is None:
        return big.join(small, keys, how)
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    dealt = big.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    copies = small.join(hot, keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u, v)``, longs or structs of longs: one
    row (node, component) per node that is no component's smallest;
    ``component`` is the smallest node reachable. Alternates large-star and
    small-star steps, whose number grows with the logarithm of the longest
    path, until all that is left are stars. Nodes of many edges are salted."""
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    rows = edges.count()
    while rows:
        rows, unfinished, hot_u, hot_v = _ends(edges, rows)
        if not unfinished:
            break
        # what hangs on v hangs on the least that v hangs on
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        large = _dealt_join(edges, least.withColumnRenamed("u", "v"), ["v"], ["u"], hot_v, "left").select("u", F.coalesce("m", "v").alias("v"))
        # all that u hangs on, and u, hang on the least of them; no u has more edges than before
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _dealt_join(large, least, ["u"], ["v"], hot_u, "inner")
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").filter("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _ends(edges: DataFrame, before: int) -> tuple[int, int, DataFrame | None, DataFrame | None]:
    """In one pass over distinct ``edges``, u > v: their number, the number of
    nodes that keep them from being stars around the least node (none: each u
    hangs on one v, which hangs on nothing), and the u and the v of many edges,
    or None. ``before`` is the number of edges or that of the round before,
    which at most doubles, so there are fewer than 2,000 of either."""
    end = lambda c, up: F.struct(F.col(c).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    ends = edges.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.sum("e.down").alias("down"))
    seen, most = Observation(), max(64, before // 1000)
    often = ends.observe(seen, F.sum("up").alias("n"), F.expr("count_if(up > 1 or up > 0 and down > 0)").alias("unfinished")).filter(f"up > {most} or down > {most}").collect()

    def hot(name: str, count: str) -> DataFrame | None:
        found = [(r["node"],) for r in often if r[count] > most]
        return edges.sparkSession.createDataFrame(found, edges.select(name).schema) if found else None

    return seen.get["n"] or 0, seen.get["unfinished"] or 0, hot("u", "up"), hot("v", "down")


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of one key after another, from batches sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        turns = np.zeros(n - 1, dtype=bool)
        for c in columns:
            turns |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(turns) + 1).tolist(), n]
        goes_on = held and all(c[0] == held[-1].column(k)[0] for c, k in zip(columns, keys, strict=True))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and not (a == 0 and goes_on):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n nodes with edges (i, j), the least node reachable from each."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (before == root).all():
            return root


NODE = "struct<rep:bigint,tag:bigint>"


def node(rep: str = "rep", tag: str = "tag") -> Column:
    """A distinct item: the smallest id that holds it, and a hash of it, which
    tells items of one id apart. Ordered by id."""
    return F.struct(F.col(rep).alias("rep"), F.col(tag).alias("tag"))


def block_links(sides: list[dict], i: np.ndarray, j: np.ndarray, same: bool) -> pa.RecordBatch:
    """Links (i, j) of a block pair, as one row per linked item: the weight of
    what it links to, and the least item that these links join it to. A side
    has arrays ``rep``, ``tag`` and ``weight``."""
    if same:
        side = sides[0]
    else:
        side = {k: np.concatenate([s[k] for s in sides]) for k in ("rep", "tag", "weight")}
        j = j + len(sides[0]["rep"])
    n = len(side["rep"])
    links = np.bincount(i, weights=side["weight"][j], minlength=n) + np.bincount(j, weights=side["weight"][i], minlength=n)
    order = np.lexsort((side["tag"], side["rep"]))
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    root = order[roots(n, place[i], place[j])][place]
    at = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (side["rep"][at], side["tag"][at], links[at].astype("int64"), side["rep"][root[at]], side["tag"][root[at]])], ["rep", "tag", "links", "root_rep", "root_tag"]
    )


LINKS = "rep long, tag long, links long, root_rep long, root_tag long"


def link_classes(items: DataFrame, found: DataFrame) -> DataFrame:
    """``items(rep, tag, weight, ...)`` with n_links and class_id from the block
    links ``found``: other rows linked directly, own copies included, and the
    smallest id reachable."""
    found = cut(found.groupBy("rep", "tag", "root_rep", "root_tag").agg(F.sum("links").alias("links")))
    classes = components(found.select(node().alias("u"), node("root_rep", "root_tag").alias("v")))
    classes = classes.select("node.rep", "node.tag", F.col("component.rep").alias("_class"), F.col("component.tag").alias("_class_tag"))
    links = found.groupBy("rep", "tag").agg(F.sum("links").alias("_links"))
    out = items.join(links, ["rep", "tag"], "left").join(classes, ["rep", "tag"], "left")
    out = out.withColumn("n_links", F.coalesce("_links", F.lit(0)) + F.col("weight") - 1).withColumn("class_id", F.coalesce("_class", "rep"))
    return out.withColumn("is_root", F.col("_class").isNull()).drop("_links", "_class", "_class_tag")
