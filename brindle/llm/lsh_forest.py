"""N-gram Jaccard self-join of documents by a MinHash LSH forest.

Each document's set of five-word shingles gets a MinHash signature that is cut
into the labels of several trees. Sorted labels of a tree are its prefix trie:
documents whose labels share a prefix lie side by side. The matched prefix
starts at the whole label and is shortened hash by hash; after each round, the
similarities of the pairs met so far say how many pairs the round should have
met, and the shortening ends when the share met reaches the target recall.
What met is then verified exactly on whole shingle sets.

Nodes are distinct shingle sets, never ids, so texts that share an id are
compared like others.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import LINKS, SPACES, block_links, block_pairs, by_key, components, cut, link_classes, node, roots, salted_join
from brindle.llm.hashing import by_text, mix, shingles

SEED = 17
_BYTES = 2  # of each MinHash that a label keeps


def recall_at(depth: int, trees: int, similarity: float) -> float:
    """Probability that a pair shares a prefix of ``depth`` in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def least_depth(trees: int, longest: int, similarity: float, target: float) -> int:
    """The depth at which a pair at the threshold reaches the target, so that
    prefixes never need to be shorter."""
    depth = longest
    while depth > 1 and recall_at(depth, trees, similarity) < target:
        depth -= 1
    return depth


def measured_recall(met: dict[float, int], depth: int, trees: int, threshold: float) -> float:
    """Share of the pairs that have met at ``depth``: ``met`` counts them by
    similarity, and each stands for 1 / recall_at pairs. One pair at the
    threshold is added, so that with nothing met the threshold decides."""
    expected = sum(n / recall_at(depth, trees, s) for s, n in met.items()) + 1
    return (sum(met.values()) + recall_at(depth, trees, threshold)) / expected


def _texts(batch: pa.RecordBatch, step: int = 512):
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield part, part.column(part.schema.get_field_index("text")).to_pylist()


def _set_key(s: np.ndarray) -> bytes:
    """Two independent sums over a shingle set and its size identify equal sets."""
    return np.array([np.sum(mix(s)), np.sum(mix(s ^ np.uint64(SEED)))]).tobytes() + len(s).to_bytes(4, "big")


def _sketch(hashes: int):
    rng = np.random.default_rng(SEED)
    factors = (rng.integers(0, 2**31, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)

    def sketch(batches):
        for batch in batches:
            for part, texts in _texts(batch):
                keys, sizes, signatures = [], [], []
                for words in by_text(texts):
                    s = shingles(words)
                    sizes.append(len(s))
                    if not len(s):
                        keys.append(None)
                        signatures.append(None)
                        continue
                    half, least = (s >> np.uint64(32)).astype(np.uint32), np.full(hashes, 2**32 - 1, dtype=np.uint32)
                    for a in range(0, len(half), 1024):
                        np.minimum(least, (half[a : a + 1024, None] * factors).min(axis=0), out=least)
                    keys.append(_set_key(s))
                    signatures.append((mix(least.astype(np.uint64)) >> np.uint64(64 - 8 * _BYTES)).astype(">u2").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signatures, pa.binary())],
                    ["doc_id", "text_hash", "set_key", "n_shingles", "signature"],
                )

    return sketch


def _trie(longest: int, least: int):
    """Walk one range of sorted labels: the members of every trie node at
    depths ``least`` to ``longest`` where paths part (or whole labels repeat).
    The first and the last node of a range may go on in the next and are always
    given. ``run`` orders by depth, deepest first, then by tree."""

    def walk(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        tree = rows.column("tree").to_numpy().astype(np.uint8)
        labels = np.frombuffer(b"".join(rows.column("label").to_pylist()), dtype=np.uint8).reshape(len(tree), -1)
        hashes = labels.view(">u2")
        same = (hashes[1:] == hashes[:-1]) & (tree[1:] == tree[:-1])[:, None]
        common = np.cumprod(same, axis=1, dtype=np.int64).sum(axis=1)
        rep, tag = rows.column("rep").to_numpy(), rows.column("tag").to_numpy()
        for depth in range(longest, least - 1, -1):
            run = np.concatenate(([0], np.cumsum((common < depth) | (tree[1:] != tree[:-1]))))
            new = np.zeros(run[-1] + 1, dtype=bool)
            new[run[1:][(common >= depth) if depth == longest else (common == depth)]] = True
            new[0] = new[-1] = True
            at = np.flatnonzero(new[run])
            names = np.concatenate([np.full((len(at), 1), longest - depth, np.uint8), tree[at, None], labels[at, : _BYTES * depth]], axis=1)
            width = names.shape[1]
            names = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(at), [None, pa.py_buffer(names.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), depth, np.int32)), names, pa.array(rep[at]), pa.array(tag[at])], ["depth", "run", "rep", "tag"])

    return walk


def _meet(trees: int, longest: int, threshold: float, floor: int):
    """Pairs of a trie node whose signatures agree in ``floor`` hashes or more
    and that meet in no deeper node and no earlier tree: edges that join them
    (no more than members), and counts by agreeing hashes from the threshold on."""
    hashes = trees * longest

    def meet(batches):
        for group in by_key(batches, ["run", "_lo", "_hi"]):
            low, high, run = group["_lo"][0].as_py(), group["_hi"][0].as_py(), group["run"][0].as_py()
            depth, tree = longest - run[0], run[1]
            block = group["_block"].to_numpy()
            left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
            if not len(left) or not len(right) or (low == high and len(left) < 2):
                continue
            signed = np.frombuffer(b"".join(group["signature"].to_pylist()), dtype=">u2").astype(np.uint16).reshape(len(block), hashes)
            found_i, found_j, agreed = [], [], []
            step = max(1, 30_000_000 // (len(right) * hashes))
            for a in range(0, len(left), step):
                part = left[a : a + step]
                agree = (signed[part][:, None, :] == signed[right][None, :, :]).sum(axis=2)
                i, j = np.nonzero(agree >= floor)
                if low == high:
                    keep = i + a < j
                    i, j = i[keep], j[keep]
                count, i, j = agree[i, j], part[i], right[j]
                for b in range(0, len(i), 50_000):  # where do the pairs meet first?
                    pi, pj = i[b : b + 50_000], j[b : b + 50_000]
                    shared = np.cumprod((signed[pi] == signed[pj]).reshape(-1, trees, longest), axis=2, dtype=np.int8).sum(axis=2)
                    first = (shared.max(axis=1) == depth) & ((shared == depth).argmax(axis=1) == tree)
                    found_i.append(pi[first])
                    found_j.append(pj[first])
                    agreed.append(count[b : b + 50_000][first])
            i, j, agreed = (np.concatenate(x) if x else np.zeros(0, dtype=int) for x in (found_i, found_j, agreed))
            if not len(i):
                continue
            root = roots(len(block), i, j)
            at = np.flatnonzero(root != np.arange(len(block)))
            rep, tag = group["rep"].to_numpy(), group["tag"].to_numpy()
            counts = np.bincount(agreed[agreed >= math.ceil(threshold * hashes)], minlength=hashes + 1)
            bins = np.flatnonzero(counts)
            pad, none = [None] * len(bins), [None] * len(at)
            columns = [np.concatenate([x, np.zeros(len(bins), dtype=np.int64)]) for x in (rep[at], tag[at], rep[root[at]], tag[root[at]])]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), pa.array(none + bins.tolist(), pa.int32()), pa.array([0] * len(none) + counts[bins].tolist() if pad or none else [], pa.int64())],
                ["rep", "tag", "other_rep", "other_tag", "agreed", "pairs"],
            )

    return meet


def _sets(batches):
    for batch in batches:
        for part, texts in _texts(batch):
            names = [n for n in part.schema.names if n != "text"]
            columns = [part.column(part.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([shingles(w).tobytes() for w in by_text(texts)], pa.binary())], [*names, "shingles"])


def shared_counts(sets: list[np.ndarray], other: list[np.ndarray] | None = None) -> np.ndarray:
    """Matrix of intersection sizes, exact, by products of 0/1 blocks over the
    shingles that occur in more than one set."""
    both = sets if other is None else sets + other
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, number, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    often = count[number] > 1
    owner, number = owner[often], (np.cumsum(count > 1) - 1)[number[often]]
    n = len(sets)
    top = int(number.max()) + 1 if len(number) else 0
    if n == len(both) == 2:
        return np.array([[len(sets[0]), top], [top, len(sets[1])]], dtype=np.float32)
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    out = np.zeros((n, n if other is None else len(other)), dtype=np.float32)
    step = 4096
    for at in range(0, top, step):
        a, b = np.searchsorted(number, [at, at + step])
        dense = np.zeros((len(both), min(step, top - at)), dtype=np.float32)
        dense[owner[a:b], number[a:b] - at] = 1
        out += dense[:n] @ (dense if other is None else dense[n:]).T
    return out


_PAIR = ["cand.rep", "cand.tag", "lo.cls", "lo.block", "hi.cls", "hi.block"]
_PAIR_NAMES = [c.replace(".", "_") for c in _PAIR]


def _verify(threshold: float):
    def verify(batches):
        for group in by_key(batches, _PAIR_NAMES):
            cls, block = group["cls"].to_numpy(), group["block"].to_numpy()
            low, high = ((cls == group[f"{side}_cls"][0].as_py()) & (block == group[f"{side}_block"][0].as_py()) for side in ("lo", "hi"))
            same = bool((low == high).all())
            sides, sets = [], []
            for at in [low] if same else [low, high]:
                at = np.flatnonzero(at)
                names = np.stack([group["rep"].to_numpy()[at], group["tag"].to_numpy()[at]], axis=1)
                # a text may come in several rows of one id
                at = at[np.sort(np.unique(names, axis=0, return_index=True)[1])] if len(at) else at
                sides.append({k: group[k].to_numpy()[at] for k in ("rep", "tag", "weight")})
                shingled = group["shingles"]
                sets.append([np.frombuffer(shingled[int(k)].as_py(), dtype=np.uint64) for k in at])
            if not all(map(len, sets)) or (same and len(sets[0]) < 2):
                continue
            shared = shared_counts(*sets)
            union = np.array([len(s) for s in sets[0]])[:, None] + np.array([len(s) for s in sets[-1]])[None, :] - shared
            i, j = np.nonzero(shared >= threshold * union - 1e-6)
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield block_links(sides, i, j, same)

    return verify


def _size_blocks(members: DataFrame, threshold: float, block_docs: int, block_shingles: int) -> DataFrame:
    """``members(rep, tag, cand, n_shingles, ...)`` with their size class and
    block, once per block pair (``pair``) they are verified in. Classes grow by
    1 / threshold, so only neighbouring classes can hold similar sets."""
    members = members.withColumn("cls", F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(1 / threshold) if threshold < 1 else F.col("n_shingles")).cast("int"))
    sizes = members.groupBy("cand", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    sizes = sizes.withColumn("blocks", F.greatest(F.ceil(F.col("n") / block_docs), F.ceil(F.col("s") / block_shingles)).cast("int"))
    near = sizes.select("cand", "n", "blocks", F.col("cls").alias("_of"), F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1)).alias("cls"))
    side = lambda k, what: F.coalesce(F.max(F.when(F.col("_of") == F.col("cls") + k, F.col(what))), F.lit(0))
    around = near.groupBy("cand", "cls").agg(side(-1, "blocks").alias("below"), side(0, "blocks").alias("own"), side(1, "blocks").alias("above"), F.sum("n").alias("n"))
    rows = salted_join(members, around.filter("own > 0 and n > 1"), ["cand", "cls"], ["rep", "tag"], members.count())
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(11), "rep", "tag"), F.col("own")).cast("int"))
    none = F.array().cast("array<int>")

    def upto(n: str) -> Column:
        return F.when(F.col(n) > 0, F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0)))).otherwise(none)

    def place(cls: Column, block: Column) -> Column:
        return F.struct(cls.cast("int").alias("cls"), block.cast("int").alias("block"))

    own = place(F.col("cls"), F.col("block"))
    pairs = F.concat(
        F.transform(upto("below"), lambda b: F.struct(place(F.col("cls") - 1, b).alias("lo"), own.alias("hi"))),
        F.transform(upto("own"), lambda b: F.struct(place(F.col("cls"), F.least(b, F.col("block"))).alias("lo"), place(F.col("cls"), F.greatest(b, F.col("block"))).alias("hi"))),
        F.transform(upto("above"), lambda b: F.struct(own.alias("lo"), place(F.col("cls") + 1, b).alias("hi"))),
    )
    return rows.withColumn("pairs", pairs).drop("below", "own", "above", "n")


def _candidates(reps: DataFrame, threshold: float, trees: int, longest: int, target: float, run_docs: int, range_rows: int) -> DataFrame:
    """``reps(rep, tag, signature)`` to candidate classes (rep, tag, cand)."""
    width, least = _BYTES * longest, least_depth(trees, longest, threshold, target)
    entries = reps.select("rep", "tag", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    entries = entries.select("tree", F.substring(F.col("signature"), F.col("tree") * width + 1, F.lit(width)).alias("label"), "rep", "tag")
    ranges = max(1, math.ceil(reps.count() * trees / range_rows))
    # the tag in the order lets a label that many share go over several ranges
    entries = entries.repartitionByRange(ranges, "tree", "label", "tag").sortWithinPartitions("tree", "label", "tag")
    placed = cut(entries.mapInArrow(_trie(longest, least), "depth int, run binary, rep long, tag long"))
    # nodes of equal members meet once: in the deepest, then in the first tree
    runs = placed.groupBy("run").agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep", "tag")).alias("x"), F.bit_xor(F.xxhash64("tag", "rep")).alias("y"))
    runs = runs.filter("n > 1").groupBy("n", "x", "y").agg(F.min("run").alias("run")).select("run", "n")
    members = salted_join(placed, runs, ["run"], ["rep", "tag"], placed.count()).join(reps.select("rep", "tag", "signature"), ["rep", "tag"])
    members = cut(block_pairs(members, ["run"], "tag", F.ceil(F.col("n") / run_docs)).drop("n"))
    # agreement of a pair at the threshold lies below this once in ten million
    floor = math.floor(trees * longest * threshold - 5.2 * math.sqrt(trees * longest * threshold * (1 - threshold)))
    edges, met = [], {}
    for depth in range(longest, least - 1, -1):
        here = members.filter(F.col("depth") == depth).drop("depth").repartition("run", "_lo", "_hi").sortWithinPartitions("run", "_lo", "_hi")
        here = cut(here.mapInArrow(_meet(trees, longest, threshold, floor), "rep long, tag long, other_rep long, other_tag long, agreed int, pairs long"))
        edges.append(here.filter("agreed is null").select(node().alias("u"), node("other_rep", "other_tag").alias("v")))
        for r in here.filter("agreed is not null").groupBy("agreed").agg(F.sum("pairs").alias("pairs")).collect():  # a row per count of agreeing hashes
            s = r["agreed"] / (trees * longest)
            met[s] = met.get(s, 0) + r["pairs"]
        if measured_recall(met, depth, trees, threshold) >= target:
            break
    joined = edges[0]
    for more in edges[1:]:
        joined = joined.unionByName(more)
    near = components(joined)
    near = near.unionByName(near.select(F.col("component").alias("node"), "component").distinct())
    return near.select("node.rep", "node.tag", F.col("component").alias("cand"))


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text: a row's document is its id and its text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _classes(docs: DataFrame, threshold: float, trees: int, longest: int, target: float, run_docs: int, block_docs: int, block_shingles: int, range_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, set_key or null), and per set: set_key, rep,
    text_hash, tag, weight, n_links, class_id, is_root."""
    texts = _identified(docs)
    rows = cut(texts.mapInArrow(_sketch(trees * longest), "doc_id long, text_hash long, set_key binary, n_shingles int, signature binary"))
    good = rows.filter("doc_id is not null and set_key is not null")
    reps = good.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("of"), F.count(F.lit(1)).alias("weight"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    reps = cut(reps.select("set_key", F.col("of.doc_id").alias("rep"), F.col("of.text_hash").alias("text_hash"), F.xxhash64("set_key").alias("tag"), "weight", "n_shingles", "signature"))
    members = cut(_candidates(reps, threshold, trees, longest, target, run_docs, range_rows).join(reps.drop("signature"), ["rep", "tag"]))
    sized = _size_blocks(members, threshold, block_docs, block_shingles)
    sets = texts.join(sized.withColumn("doc_id", F.col("rep")), ["doc_id", "text_hash"]).select("rep", "tag", "weight", "cls", "block", "cand", "pairs", "text")
    pair = "struct<lo:struct<cls:int,block:int>,hi:struct<cls:int,block:int>>"
    sets = sets.mapInArrow(_sets, f"rep long, tag long, weight long, cls int, block int, cand struct<rep:long,tag:long>, pairs array<{pair}>, shingles binary")
    met = sets.select("rep", "tag", "weight", "cls", "block", "cand", F.explode("pairs").alias("pair"), "shingles").select("*", "pair.lo", "pair.hi")
    met = met.select("rep", "tag", "weight", "cls", "block", "shingles", *[F.col(c).alias(n) for c, n in zip(_PAIR, _PAIR_NAMES, strict=True)])
    found = met.repartition(*_PAIR_NAMES).sortWithinPartitions(*_PAIR_NAMES).mapInArrow(_verify(threshold), LINKS)
    return rows.select("doc_id", "text_hash", "set_key"), link_classes(reps.drop("signature", "n_shingles"), found)


def jaccard_classes(
    docs: DataFrame,
    threshold: float = 0.8,
    trees: int = 24,
    longest: int = 8,
    target: float = 0.999,
    run_docs: int = 128,
    block_docs: int = 128,
    block_shingles: int = 1_000_000,
    range_rows: int = 400_000,
) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_links, class_id, kept.

    Two documents are linked if the Jaccard similarity of their shingle sets
    reaches the threshold; ``n_links`` counts all linked documents, copies
    included, and ``class_id`` is the smallest doc_id reachable by links.
    Words are split at ASCII white space and compared as they are. A text of
    one to four words is one shingle. Null texts, texts without words and rows
    with a null doc_id link with nothing and are their own class, kept. Equal
    sets are compared once and counted as often as they occur; rows of one id
    with different texts are compared like others, and each row has the links
    of its own text. An empty table gives an empty result; other columns are
    ignored. A trie node beyond ``run_docs`` documents, and a candidate class
    beyond ``block_docs`` documents or ``block_shingles`` shingles, is treated
    block pair by block pair, blocks of sizes too far apart left out.
    """
    rows, per_set = _classes(docs, threshold, trees, longest, target, run_docs, block_docs, block_shingles, range_rows)
    done = rows.filter("doc_id is not null and set_key is not null")
    done = salted_join(done, per_set.select("set_key", "n_links", "class_id"), ["set_key"], ["doc_id"], rows.count())
    done = done.select("doc_id", "n_links", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    alone = rows.filter("doc_id is null or set_key is null").select("doc_id", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return done.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, **options) -> DataFrame:
    """The rows of ``docs`` of which one stays per class: a row with the class's
    smallest doc_id and the text that represents it.

    Rows with a null doc_id, null texts and texts without words all stay.
    Different texts under one id are different documents: the representatives
    of two classes both stay, whatever their ids. Rows that repeat an id and
    its text count as copies, of which one stays, the same in every run.
    """
    defaults = {"trees": 24, "longest": 8, "target": 0.999, "run_docs": 128, "block_docs": 128, "block_shingles": 1_000_000, "range_rows": 400_000}
    rows, per_set = _classes(docs, threshold, **(defaults | options))
    names = [f"`{c}`" for c in docs.columns]
    text = F.col("text").cast("string")
    packed = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), (F.coalesce(F.translate(text, SPACES, ""), F.lit("")) == "").alias("wordless"))
    times = rows.filter("doc_id is not null").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times"))
    stays = per_set.filter("is_root").select(F.col("rep").alias("doc_id"), "text_hash").join(times, ["doc_id", "text_hash"])
    once = packed.join(stays.filter("times = 1"), ["doc_id", "text_hash"], "left_semi").select("row")
    comparable = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    again = packed.join(stays.filter("times > 1"), ["doc_id", "text_hash"], "left_semi").groupBy("doc_id", "text_hash").agg(F.min_by("row", F.xxhash64(*comparable)).alias("row")).select("row")
    rest = packed.filter("doc_id is null or wordless").select("row")
    return once.unionByName(again).unionByName(rest).select(*[F.col(f"row.{c}").alias(c.strip("`")) for c in names])
