"""Embedding near-duplicates by spherical-cap filters.

Filter directions are structured random product codes: the (randomly
rotated) space is cut into a few blocks of coordinates, each block has its own
random unit code words, and a filter is one code word of each block. A vector
passes a filter if its cosine with the direction is at least a cap height. All
filters that a vector passes are list-decoded block by block, pruning on the
best that the remaining blocks can add. Short sketches of the vectors meet in a
join on filters; what they join is verified in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import LINKS, block_links, block_pairs, by_key, components, cut, link_classes, node, roots, salted_join

SEED = 5


def _upper(power: float, steps: int = 20_001) -> tuple[np.ndarray, np.ndarray]:
    """Grid u on [-1, 1] and the integral of (1 - v^2)^power from u to 1."""
    u = np.linspace(-1, 1, steps)
    v = np.maximum(1 - u * u, 0.0) ** power
    areas = (v[1:] + v[:-1]) / 2 * (u[1] - u[0])
    return u, np.concatenate([np.cumsum(areas[::-1])[::-1], [0.0]])


def cap_share(height: float, dim: int) -> float:
    """Share of the unit vectors within a cap: their cosine with its direction
    is ``height`` or more."""
    u, upper = _upper((max(dim, 3) - 3) / 2)
    return float(np.interp(height, u, upper) / upper[0])


def joint_share(height: float, cosine: float, dim: int) -> float:
    """Probability that a random direction's cap holds both of a pair. Of a
    direction, the parts along the first vector and across it to the second
    have the density (1 - a^2 - b^2)^((dim - 4) / 2) on the disc."""
    power = (max(dim, 4) - 4) / 2
    u, upper = _upper(power)
    a = np.linspace(height, 1, 4001)[:-1]
    across = np.sqrt(1 - a * a)
    least = (height - cosine * a) / (math.sqrt(max(1e-12, 1 - cosine * cosine)) * across)
    inner = across ** (2 * power + 1) * np.interp(np.clip(least, -1, 1), u, upper)
    return float(np.sum((inner[1:] + inner[:-1]) / 2) * (a[1] - a[0]) * (power + 1) / math.pi)


def plan_filters(n: int, dim: int, threshold: float, expected: float = 10.0, bucket: int = 128, most_words: int = 2048) -> dict:
    """Cap height and code sizes for n vectors of dim coordinates.

    The cap is so high that a filter holds about ``bucket`` unrelated vectors,
    and filters are so many that a pair at the threshold passes ``expected`` of
    them together (missing all: about exp(-expected)). Both follow n by one
    formula at every size, so recall stays and the work per vector does too.
    The filters of one product code are not independent directions, so they are
    dealt to 12 codes of their own rotation and words, each with as few blocks
    as keep its words per block at ``most_words``. With more than one block the
    filters of a code still come and go together; then there are 48 codes, and
    2.4 times as many filters (tests/llm/recall.py measures both).
    """
    share = min(0.2, bucket / max(n, 1))
    low, high = 0.0, 1.0
    for _ in range(50):
        h = (low + high) / 2
        low, high = (h, high) if cap_share(h, dim) > share else (low, h)
    for codes, wanted in ((12, expected), (48, 2.4 * expected)):
        filters = wanted / max(joint_share(low, threshold, dim), 1e-12) / codes
        blocks = max(1, min(dim, math.ceil(math.log(max(filters, 2)) / math.log(most_words))))
        if blocks == 1:
            break
    return {"dim": dim, "codes": codes, "blocks": blocks, "words": max(2, math.ceil(filters ** (1 / blocks))), "height": low}


def _codes(plan: dict) -> list[tuple]:
    """(rotation, [(coordinates, code words)]) of each product code."""
    out = []
    for k in range(plan["codes"]):
        rng = np.random.default_rng([SEED, plan["dim"], k])
        rotation, _ = np.linalg.qr(rng.standard_normal((plan["dim"], plan["dim"])))
        words = []
        for part in np.array_split(np.arange(plan["dim"]), plan["blocks"]):
            w = rng.standard_normal((plan["words"], len(part)))
            # by its share of the coordinates, so that a whole direction is a unit vector
            words.append((part, (w / np.linalg.norm(w, axis=1, keepdims=True)) * math.sqrt(len(part) / plan["dim"])))
        out.append((rotation, words))
    return out


def _decode(scores: list[np.ndarray], height: float) -> tuple[np.ndarray, np.ndarray]:
    """(vector, filter) of all filters whose block scores add up to height or
    more; ``scores`` has, per block, a row per vector and a column per word."""
    best_rest = np.cumsum([s.max(axis=1) for s in scores][::-1], axis=0)[::-1]
    best_rest = np.concatenate([best_rest[1:], np.zeros((1, len(scores[0])))])
    vector, number, total = np.arange(len(scores[0])), np.zeros(len(scores[0]), dtype=np.int64), np.zeros(len(scores[0]))
    for s, rest in zip(scores, best_rest, strict=True):
        step, found = max(1, 4_000_000 // s.shape[1]), []
        for a in range(0, len(vector), step):
            v = vector[a : a + step]
            sums = total[a : a + step, None] + s[v]
            i, j = np.nonzero(sums >= height - rest[v][:, None])
            found.append((v[i], number[a : a + step][i] * s.shape[1] + j, sums[i, j]))
        vector, number, total = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (vector, number, total)
    return vector, number


def _passed(x: np.ndarray, plan: dict, codes: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(vector, filter) of all filters, of all codes, that unit vectors pass."""
    per_code, vectors, filters = plan["words"] ** plan["blocks"], [], []
    for k, (rotation, words) in enumerate(codes):
        y = x @ rotation.T
        v, f = _decode([y[:, part] @ w.T for part, w in words], plan["height"])
        vectors.append(v)
        filters.append(f + k * per_code)
    return np.concatenate(vectors), np.concatenate(filters)


SKETCHED = 64  # coordinates of a sketch at most


def _sketch_basis(dim: int) -> np.ndarray:
    """Rotation, or above 64 coordinates a projection, before rounding: it
    spreads a vector's length over all coordinates, whatever the vector."""
    rng = np.random.default_rng([SEED, dim, 999])
    if dim <= SKETCHED:
        return np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    return rng.standard_normal((dim, SKETCHED)) / math.sqrt(SKETCHED)


def _sketch_step(dim: int) -> float:
    """Up to 32 coordinates are rounded to a byte, more to half a byte that
    reaches 3.2 standard deviations."""
    return 1 / 127 if dim <= 32 else 3.2 / 7 / math.sqrt(min(dim, SKETCHED))


def sketch_floor(dim: int, threshold: float) -> float:
    """6.5 standard deviations of a sketch's error below the threshold."""
    rounding = math.sqrt(2 / 12) * _sketch_step(dim)
    projecting = (1 - threshold * threshold) / math.sqrt(SKETCHED) if dim > SKETCHED else 0.0
    return threshold - 6.5 * math.hypot(rounding, projecting)


def sketches(x: np.ndarray) -> np.ndarray:
    """At most 32 bytes per unit vector (row), from which cosines can be guessed."""
    dim = x.shape[1]
    y = np.rint((x @ _sketch_basis(dim)) / _sketch_step(dim))
    if dim <= 32:
        return np.clip(y, -127, 127).astype(np.int8).view(np.uint8)
    half = (np.clip(y, -7, 7) + 8).astype(np.uint8)
    if half.shape[1] % 2:
        half = np.concatenate([half, np.full((len(half), 1), 8, np.uint8)], axis=1)
    return half[:, 0::2] * np.uint8(16) + half[:, 1::2]


def read_sketches(raw: np.ndarray, dim: int) -> np.ndarray:
    """Unit vectors near those that were sketched."""
    if dim <= 32:
        y = raw.view(np.int8).astype(np.float32)
    else:
        y = np.empty((len(raw), raw.shape[1] * 2), dtype=np.float32)
        y[:, 0::2], y[:, 1::2] = raw >> 4, raw & 15
        y -= 8
    return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_DIM_SHIFT = 1 << 44


def _assign(plans: dict[int, dict]):
    made: dict[int, list] = {}

    def assign(batches):
        for batch in batches:
            column = batch.column(2)
            dims = pc.list_value_length(column).to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                if dim not in made:
                    made[dim] = _codes(plans[dim])
                for a in range(0, rows.num_rows, 512):
                    part = rows.slice(a, 512)
                    x = _matrix(part.column(2))
                    vector, number = _passed(x, plans[dim], made[dim])
                    drawn = sketches(x)
                    payload = pa.FixedSizeBinaryArray.from_buffers(pa.binary(drawn.shape[1]), len(vector), [None, pa.py_buffer(np.ascontiguousarray(drawn[vector]).tobytes())]).cast(pa.binary())
                    rep, tag = (part.column(k).to_numpy()[vector] for k in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(number + dim * _DIM_SHIFT), pa.array(rep), pa.array(tag), payload], ["filter", "rep", "tag", "sketch"])

    return assign


def _meet(threshold: float):
    """Edges that join the vectors of a filter whose sketches are near; no more
    than vectors."""
    def meet(batches):
        for group in by_key(batches, ["filter", "_lo", "_hi"]):
            low, high, dim = group["_lo"][0].as_py(), group["_hi"][0].as_py(), group["filter"][0].as_py() // _DIM_SHIFT
            block = group["_block"].to_numpy()
            left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
            if not len(left) or not len(right) or (low == high and len(left) < 2):
                continue
            raw = np.frombuffer(b"".join(group["sketch"].to_pylist()), dtype=np.uint8).reshape(len(block), -1)
            y = read_sketches(raw, dim)
            i, j = np.nonzero(y[left] @ y[right].T >= sketch_floor(dim, threshold))
            i, j = left[i], right[j]
            if low == high:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            root = roots(len(block), i, j)
            at = np.flatnonzero(root != np.arange(len(block)))
            rep, tag = group["rep"].to_numpy(), group["tag"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (rep[at], tag[at], rep[root[at]], tag[root[at]])], ["rep", "tag", "other_rep", "other_tag"])

    return meet


_BLOCK_PAIR = ["cand_rep", "cand_tag", "_lo", "_hi"]


def _verify(threshold: float):
    def verify(batches):
        for group in by_key(batches, _BLOCK_PAIR):
            low, high, block = group["_lo"][0].as_py(), group["_hi"][0].as_py(), group["_block"].to_numpy()
            same = low == high
            parts = [group.filter(pa.array(block == b)) for b in ([low] if same else [low, high])]
            if not all(p.num_rows for p in parts) or (same and parts[0].num_rows < 2):
                continue
            units = [_matrix(p["x"].combine_chunks()) for p in parts]
            i, j = np.nonzero(units[0] @ units[-1].T >= threshold)
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield block_links([{k: p[k].to_numpy() for k in ("rep", "tag", "weight")} for p in parts], i, j, same)

    return verify


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, block: int = 1024, class_block: int = 128, expected: float = 10.0) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding)``: vec_id, n_links,
    component_id, kept; other columns are ignored.

    Only vectors of one length are compared. Vectors that are null, empty,
    zero or hold null or non-finite components, and rows with a null vec_id,
    link with nothing: no links, their own component, kept. Equal vectors are
    compared once and counted as often as they occur; rows of one id with
    different vectors are compared like others, and each row has the links of
    its own vector. An empty table gives an empty result. A filter of
    more than ``block`` vectors, and a class of candidates of more than
    ``class_block``, is treated block pair by block pair, so no task holds a hot
    one.

    What meets in a filter is a sketch of each vector; the vectors themselves
    are verified once, among those that sketches join.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select("vec_id", F.col("embedding").cast(kind).alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("x", F.when(usable, F.col("embedding"))).select("vec_id", "x", F.xxhash64("x").alias("tag"), F.xxhash64(F.lit(1), "x").alias("tag2"))
    good = rows.filter(F.col("x").isNotNull())
    reps = good.groupBy("tag", "tag2").agg(F.min("vec_id").cast("long").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("x").alias("x"))  # by 128 bits of hash
    reps = cut(reps.select("rep", "tag", "tag2", "weight", "x"))
    # one plan per vector length; lengths are the columns of the embedding models at hand, a handful
    sizes = {r["dim"]: r["n"] for r in reps.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    plans = {d: plan_filters(n, d, threshold, expected) for d, n in sizes.items()}
    entries = cut(reps.select("rep", "tag", "x").mapInArrow(_assign(plans), "filter long, rep long, tag long, sketch binary"))
    large = entries.groupBy("filter").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("filter", F.ceil(F.col("n") / block).alias("blocks"))
    large = F.broadcast(large) if large.limit(10_001).count() <= 10_000 else large
    met = block_pairs(entries.join(large, "filter", "left"), ["filter"], "tag", F.coalesce("blocks", F.lit(1))).drop("blocks")
    met = met.repartition("filter", "_lo", "_hi").sortWithinPartitions("filter", "_lo", "_hi")
    edges = met.mapInArrow(_meet(threshold), "rep long, tag long, other_rep long, other_tag long")
    near = components(edges.select(node().alias("u"), node("other_rep", "other_tag").alias("v")))
    near = near.unionByName(near.select(F.col("component").alias("node"), "component").distinct())
    members = cut(near.select("node.rep", "node.tag", F.col("component.rep").alias("cand_rep"), F.col("component.tag").alias("cand_tag")))
    sized = members.groupBy("cand_rep", "cand_tag").agg(F.ceil(F.count(F.lit(1)) / class_block).alias("blocks"))
    members = salted_join(members, sized, ["cand_rep", "cand_tag"], ["rep", "tag"], members.count()).join(reps.drop("tag2"), ["rep", "tag"])
    pairs = block_pairs(members, ["cand_rep", "cand_tag"], "tag", F.col("blocks")).drop("blocks")
    found = pairs.repartition(*_BLOCK_PAIR).sortWithinPartitions(*_BLOCK_PAIR).mapInArrow(_verify(threshold), LINKS)
    per_rep = link_classes(reps.drop("x"), found).select("tag", "tag2", "n_links", F.col("class_id").alias("component_id"))
    named = good.select("vec_id", "tag", "tag2")
    done = salted_join(named, per_rep, ["tag", "tag2"], ["vec_id"], sum(sizes.values()))
    done = done.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = rows.filter(F.col("x").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return done.unionByName(alone)
