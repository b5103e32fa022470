"""Mixing sources to target weights by Sainte-Laguë apportionment.

Equal-token blocks are seats. Sources get seats by highest quotients
target / (2 k + 1), then each source's seats go to groups of its shards and in
them to shards, by highest quotients over their sizes: integer quotas per shard. Within a shard,
documents lie on a circle in seeded order and the shard takes as many
consecutive blocks as its quota says, from a seeded start, going round again
where the quota exceeds the circle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import cut, salted_join, word_count


def apportion(claims: DataFrame, keys: list[str], order: list[str], value: str, seats: str, out: str) -> DataFrame:
    """Sainte-Laguë: ``seats`` (one number per ``keys`` group) go to the rows
    of the group with the highest quotients value / (2 k + 1); ties go to the
    first in ``order``.

    Rounded shares are off by half a seat per row at most in sum, so only the
    seats around each row's share compete by rank: their number is a small
    multiple of the rows, not of the seats.
    """
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    rows = claims.withColumn("_all", F.sum(value).over(group)).withColumn("_n", F.count(F.lit(1)).over(group))
    fair = F.when(F.col("_all") > 0, F.col(value) * F.col(seats) / F.col("_all")).otherwise(0.0)
    rows = rows.withColumn("_fair", fair)
    reach = F.ceil(F.when(F.col("_all") > 0, F.col(value) / F.col("_all")).otherwise(0.0) * F.col("_n") / 2) + 2
    rows = rows.withColumn("_sure", F.greatest(F.floor("_fair") - reach, F.lit(0)).cast("long")).withColumn("_last", (F.ceil("_fair") + reach).cast("long"))
    rows = rows.withColumn("_open", (F.col(seats) - F.sum("_sure").over(group)).cast("long"))
    contest = rows.filter(F.col(value) > 0).select(*keys, *order, value, "_open", F.explode(F.sequence("_sure", "_last")).alias("_k"))
    ranked = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    place = F.row_number().over(ranked.orderBy(F.desc(F.col(value) / (2 * F.col("_k") + 1)), *order))
    won = contest.withColumn("_place", place).filter("_place <= _open").groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("_won"))
    joined = rows.join(won, [*keys, *order], "left")
    return joined.withColumn(out, F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_all", "_n", "_fair", "_sure", "_last", "_open", "_won")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """source, source_no, source_size, target for ``sizes(source, source_size)``.

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` times all sizes; none gets more than ``ceiling`` times its own
    size, and what exceeds that is shared again by weight. The level at which
    the sources fill up has a closed form over sources sorted by how early
    they reach their ceiling.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("source_no", F.row_number().over(by_name))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1)
    rows = rows.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * ceiling)
    rows = rows.withColumn("_budget", F.sum("source_size").over(everything) * share)
    rows = rows.withColumn("_fill", F.col("_cap") / F.col("_w"))
    full = everything.orderBy("_fill", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    rest = everything.orderBy("_fill", "source_no").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # with all sources before this one full, the level at which the rest spends the budget
    rows = rows.withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_cap").over(full), F.lit(0.0))) / F.sum("_w").over(rest))
    # this level rises while the source before lies below it and falls after
    target = F.least("_cap", F.max("_level").over(everything) * F.col("_w"))
    return rows.select("source", "source_no", "source_size", target.alias("target"))


def _items(docs: DataFrame, copies: int) -> DataFrame:
    """Items of a mix: rows of one doc_id, text and source are alike and are
    counted before anything is shuffled by them. (doc_id, text_hash, source,
    size, chunk, n): chunks of at most ``copies`` of the ``n`` alike rows, so
    that very many of them spread over shards."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), "source", word_count(text).alias("size"))
    alike = rows.groupBy("doc_id", "text_hash", "source", "size").agg(F.count(F.lit(1)).alias("_alike"))
    chunks = alike.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_alike") - 1) / copies))))
    return chunks.withColumn("n", F.least(F.col("_alike") - F.col("chunk") * copies, F.lit(copies))).drop("_alike")


def _spread(docs: DataFrame, weights: tuple[int, ...], share: float, ceiling: float, block_words: int, shard_words: int, shard_rows: int, group: int, copies: int, seed: int) -> DataFrame:
    """Items with the place [_begin, _begin + n * size) of their words on their
    shard's circle, and the shard's size and quota."""
    sized = cut(_items(docs, copies))
    per_source = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("_items"))
    targets = source_targets(per_source, weights, share, ceiling)
    targets = targets.withColumn("_seats", F.floor(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_words + 0.5).cast("long"))
    targets = cut(apportion(targets, [], ["source_no"], "target", "_seats", "blocks"))
    named = sized.withColumn("_null", F.col("source").isNull()).withColumn("_name", F.coalesce("source", F.lit("")))
    counted = per_source.select(F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_name"), "_items")
    keyed = targets.select(F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_name"), "source_no", "source_size", "target", "blocks")
    # bounded by words and by items, so that short texts do not pile up in a shard
    shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("_items") / shard_rows), F.lit(1)).cast("int")
    keyed = keyed.join(counted, ["_null", "_name"]).withColumn("_shards", shards).drop("_items")
    if targets.limit(10_001).count() <= 10_000:
        rows = named.join(F.broadcast(keyed), ["_null", "_name"])
    else:  # a source may hold a third of all documents
        rows = salted_join(named, keyed, ["_null", "_name"], ["doc_id", "text_hash", "chunk"], named.count())
    rows = rows.drop("_null", "_name")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash", "chunk"), F.col("_shards")).cast("int"))
    # first to groups of shards, then within a group: no task ranks all shards of a source
    sizes = rows.groupBy("source_no", "shard").agg(F.sum(F.col("size") * F.col("n")).alias("shard_size"), F.first("blocks").alias("blocks"))
    sizes = cut(sizes.withColumn("_group", F.floor(F.col("shard") / group).cast("int")))
    groups = sizes.groupBy("source_no", "_group").agg(F.sum("shard_size").alias("_size"), F.first("blocks").alias("blocks"))
    groups = apportion(groups, ["source_no"], ["_group"], "_size", "blocks", "_blocks").select("source_no", "_group", "_blocks")
    quotas = apportion(sizes.join(groups, ["source_no", "_group"]), ["source_no", "_group"], ["shard"], "shard_size", "_blocks", "quota").select("source_no", "shard", "shard_size", "quota")
    rows = rows.join(quotas, ["source_no", "shard"])
    order = [F.xxhash64(F.lit(seed + 1), "doc_id", "text_hash", "chunk"), "doc_id", "text_hash", "chunk"]
    around = Window.partitionBy("source_no", "shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_begin", F.sum(F.col("size") * F.col("n")).over(around) - F.col("size") * F.col("n"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, block_words: int = 16, shard_words: int = 2_000_000, shard_rows: int = 4000,
    shard_group: int = 1000, alike: int = 1000, seed: int = 1,
) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source)``: doc_id, size,
    source_size, target, taken.

    A text's size is its number of words, none for null. ``taken`` counts the
    words that the mix takes of the document, repeats counted, and is at most
    ``ceiling`` times its size (a whole number). Sources are cut into shards of
    about ``shard_words`` words or ``shard_rows`` documents, so no task holds a
    source. The outcome depends on the rows and the seed alone, so reruns
    agree; repeated rows each count, and null ids are told apart by their texts.
    An empty table gives an empty result; other columns are ignored.
    """
    rows = _spread(docs, weights, share, ceiling, block_words, shard_words, shard_rows, shard_group, alike, seed)
    rows = rows.withColumn("_nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("_begin", F.col("_begin") + F.col("_nth") * F.col("size"))
    rows = rows.withColumn("_end", F.col("_begin") + F.col("size"))
    return rows.select("doc_id", "size", "source_size", "target", _taken(seed, block_words, int(ceiling)).alias("taken"))


def _taken(seed: int, block_words: int, most: int) -> Column:
    """Words of [_begin, _end) under an arc of quota blocks on a circle of
    shard_size words that begins at a seeded block."""
    size = F.greatest(F.col("shard_size"), F.lit(1))
    arc = F.least(F.col("quota") * block_words, F.col("shard_size") * most)
    start = F.pmod(F.pmod(F.xxhash64(F.lit(seed + 2), "source_no", "shard"), F.ceil(size / block_words)) * block_words, size)
    rest = F.pmod(arc, size)

    def under(low: Column, high: Column) -> Column:
        return F.greatest(F.least(F.col("_end"), high) - F.greatest(F.col("_begin"), low), F.lit(0))

    once = under(start, F.least(start + rest, size)) + under(F.lit(0), start + rest - size)
    # whole rounds take all of the interval
    return (F.floor(arc / size) * (F.col("_end") - F.col("_begin")) + once).cast("long")


def mixed_documents(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, block_words: int = 16, shard_words: int = 2_000_000, shard_rows: int = 4000,
    shard_group: int = 1000, alike: int = 1000, seed: int = 1,
) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, in whole copies:
    words taken over size, rounded (only documents at the ends of an arc are
    taken in part). Texts without words are not taken. Rows of one doc_id,
    text and source share what the mix takes of them evenly, in the order of a
    hash of their other columns; all columns keep their names and values, and
    reruns agree.
    """
    items = _spread(docs, weights, share, ceiling, block_words, shard_words, shard_rows, shard_group, alike, seed).withColumn("_end", F.col("_begin") + F.col("n") * F.col("size"))
    key = ["doc_id", "text_hash", "source"]
    taken = items.filter("size > 0").withColumn("_taken", _taken(seed, block_words, int(ceiling))).groupBy(*key, "size").agg(F.sum("_taken").alias("_taken"), F.sum("n").alias("n"))
    taken = taken.select(*[F.col(k).alias(f"_{k}") for k in key], "n", F.floor(F.col("_taken") / F.col("size") + 0.5).alias("copies")).filter("copies > 0")
    taken = cut(taken)
    names = [f"`{c}`" for c in docs.columns]
    packed = docs.select(F.struct(*names).alias("row"), "doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), "source")

    def met(some: DataFrame) -> DataFrame:
        same = packed["doc_id"].eqNullSafe(some["_doc_id"]) & packed["text_hash"].eqNullSafe(some["_text_hash"]) & packed["source"].eqNullSafe(some["_source"])
        return packed.join(some, same)

    once = met(taken.filter("n = 1")).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
    comparable = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    variants = met(taken.filter("n > 1")).withColumn("_variant", F.xxhash64(*comparable)).groupBy(*key, "n", "copies", "_variant").agg(F.count(F.lit(1)).alias("m"), F.min_by("row", F.xxhash64(F.lit(5), *comparable)).alias("row"))
    upto = F.sum("m").over(Window.partitionBy(*key).orderBy("_variant").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    upto = variants.withColumn("_upto", upto)
    place = lambda c: F.floor(F.col("copies") * c / F.col("n"))
    upto = upto.withColumn("_times", place(F.col("_upto")) - place(F.col("_upto") - F.col("m"))).filter("_times > 0")
    # very many copies of one row are made by several tasks
    parts = upto.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / alike)))).repartition(*key, "_variant", "_part")
    again = parts.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("_times") - F.col("_part") * alike, F.lit(alike).cast("long")))).alias("_copy"))
    return once.unionByName(again).select(*[F.col(f"row.{n}").alias(n.strip("`")) for n in names])
