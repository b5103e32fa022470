"""Packing documents into sequences by length patterns.

Tokenised documents are cut only where they exceed a sequence. All pieces of
one length are alike, so the plan is made on the histogram of lengths, which
has no more bars than a sequence has tokens: patterns of a few documents that
fill a sequence are enumerated, their repeat counts fitted to the histogram by
non-negative least squares and rounded, and what is left is packed best fit
first. Pieces then get numbers within their length, and the plan says which
sequence and place each number has.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import cut, gapless
from brindle.llm.hashing import mix, pieces, span_hashes

# A worker keeps what it once took, so both bound its memory: units in the cache,
# and bytes of text handled at once (about 60 times as many in arrays).
_CACHED_UNITS = 500_000
_PIECE_BYTES = 1 << 19
_tokenizers: dict[str, _Units | _Whole] = {}

# The normaliser and pre-tokenizer whose units _Units finds itself.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

# Classes of bytes in lower-cased UTF-8. White space and changes of class end a
# pre-token of the tokenizer's pattern, and every digit is one of its own. Bytes
# that this does not decide (apostrophes, which begin contractions, and all
# beyond Latin-1 letters) leave their whole word to the tokenizer.
_SPACE, _LETTER, _DIGIT, _OTHER, _UNSURE = range(5)
_CLASS = np.full(256, _UNSURE, dtype=np.uint8)
_CLASS[32:127] = _OTHER
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[97:123] = _LETTER
_CLASS[ord("'")] = _UNSURE
_LATIN = 0xC3  # first byte of the letters of Latin-1


def _hidden() -> dict[int, int]:
    """Byte-level alphabet: visible Latin-1 bytes stand for themselves, the
    others, in order, for the characters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - own))}


class _Whole:
    """Token ids of texts by a tokenizer of any kind."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype=np.uint32) for t in texts]


def _encoder(path: str) -> _Units | _Whole:
    """Units are looked up only for the tokenizer they are known to hold for."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    plain = all(t["content"].startswith("<|") and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in said.get("added_tokens", []))
    known = said.get("normalizer") == _NORMALIZER and said.get("pre_tokenizer") == _PRE_TOKENIZER and said["model"]["type"] == "BPE" and plain
    return _Units(path) if known else _Whole(path)


class _Units:
    """Token ids of texts from the ids of their pre-tokens.

    Pre-tokens are found and hashed with array operations; each distinct one
    is tokenised once by the tokenizer's model, and those met before are
    looked up. The cache is bounded and starts again when it is full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.alphabet = _hidden()
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)  # ascending
        self.start = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def _learn(self, units: list[bytes], whole: np.ndarray) -> list[list[int]]:
        model, alphabet = self.tokenizer.model, self.alphabet
        out = []
        for unit, odd in zip(units, whole.tolist(), strict=True):
            if odd:
                out.append(self.tokenizer.encode(unit.decode(), add_special_tokens=False).ids)
            else:
                out.append([t.id for t in model.tokenize(unit.decode("latin-1").translate(alphabet))])
        return out

    def _numbers(self, hashes: np.ndarray, raw: bytes, low: bytes, starts, ends, whole) -> np.ndarray:
        """Places in the cache of all units, learning the new ones."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        known[at < len(self.hashes)] = self.hashes[at[at < len(self.hashes)]] == distinct[at < len(self.hashes)]
        if not known.all():
            if len(self.hashes) + (~known).sum() > _CACHED_UNITS and len(self.hashes):
                self.clear()
                known[:] = False
            new = first[~known]
            units = [(raw if w else low)[a:b] for a, b, w in zip(starts[new].tolist(), ends[new].tolist(), whole[new].tolist(), strict=True)]
            ids = self._learn(units, whole[new])
            length = np.array([len(x) for x in ids], dtype=np.int64)
            start = len(self.flat) + np.cumsum(length) - length
            self.flat = np.concatenate([self.flat, np.array([t for x in ids for t in x], dtype=np.uint32)])
            every = np.concatenate([self.hashes, distinct[~known]])
            order = np.argsort(every, kind="stable")
            self.hashes, self.start, self.length = every[order], np.concatenate([self.start, start])[order], np.concatenate([self.length, length])[order]
            at = np.searchsorted(self.hashes, distinct)
        return at[inverse]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for first, last, data in pieces(texts, _PIECE_BYTES):
            out += self._encode(texts[first:last], data)
        return out

    def _encode(self, texts: list[str], data: bytes) -> list[np.ndarray]:
        raw = np.frombuffer(data, dtype=np.uint8)
        low = raw.copy()
        low[(raw >= 65) & (raw <= 90)] += 32
        after_latin = np.concatenate(([False], raw[:-1] == _LATIN))
        low[after_latin & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)] += 32
        kind = _CLASS[low]
        letter = after_latin & (low != 0x97) & (low != 0xB7)
        kind[letter] = _LETTER
        kind[:-1][(raw[:-1] == _LATIN) & letter[1:]] = _LETTER
        # words, and whether one of their bytes, or a special token, is unsure
        solid = np.concatenate(([False], kind != _SPACE, [False]))
        turns = np.flatnonzero(solid[1:] != solid[:-1])
        word_start, word_end = turns[0::2], turns[1::2]
        unsure = np.concatenate(([0], np.cumsum((kind == _UNSURE) | (np.concatenate((raw[:-1] == 60, [False])) & np.concatenate((raw[1:] == 124, [False]))), dtype=np.int32)))
        odd = unsure[word_end] > unsure[word_start]
        # units begin at changes of class and at digits, in odd words only once
        begins = np.concatenate(([True], kind[1:] != kind[:-1])) | (kind == _DIGIT)
        begins &= kind != _SPACE
        inside_odd = np.zeros(len(raw) + 1, dtype=np.int8)
        np.add.at(inside_odd, word_start[odd], 1)
        np.add.at(inside_odd, word_end[odd], -1)
        begins &= np.cumsum(inside_odd[:-1], dtype=np.int8) == 0
        begins[word_start[odd]] = True
        starts = np.flatnonzero(begins)
        word = np.searchsorted(word_start, starts, side="right") - 1
        ends = np.minimum(np.append(starts[1:], len(raw)), word_end[word]) if len(starts) else starts
        whole = odd[word] if len(starts) else np.zeros(0, dtype=bool)
        hashes = span_hashes(low, starts, ends)
        # case matters to the tokenizer only inside odd words, kept apart by their own bytes
        if whole.any():
            hashes[whole] = mix(span_hashes(raw, starts[whole], ends[whole]) + np.uint64(1))
        at = self._numbers(hashes, data, low.tobytes(), starts, ends, whole)
        length = self.length[at]
        total = np.cumsum(length)
        ids = self.flat[np.arange(total[-1] if len(total) else 0) + np.repeat(self.start[at] - total + length, length)]
        borders = np.cumsum([len((t or "").encode("utf-8", "replace")) + 1 for t in texts])
        units = np.searchsorted(starts, borders)
        token_ends = np.concatenate(([0], total))[units]
        return [ids[a:b] for a, b in zip(np.concatenate(([0], token_ends[:-1])), token_ends, strict=True)]


def _pieces(path: str, longest: int, end_id: int):
    def cut_up(batches):
        units = _tokenizers.get(path) or _tokenizers.setdefault(path, _encoder(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024).to_pydict()
                cols: list[list] = [[], [], [], [], []]
                for doc_id, ids in zip(rows["doc_id"], units.encode([t or "" for t in rows["text"]]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), longest)):
                        part = ids[start : start + longest]
                        for col, value in zip(cols, (doc_id, k, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                            col.append(value)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut_up


# ---- the plan, on the histogram -------------------------------------------


def patterns(lengths: np.ndarray, capacity: int, fan: int = 12) -> np.ndarray:
    """Rows of three lengths (0: none) that add up to ``capacity``: all pairs,
    and for every length triples with partners spread over the rest."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[lengths] = True
    rows = [(a, capacity - a, 0) for a in lengths if a * 2 <= capacity and have[capacity - a]]
    for a in lengths:
        rest = capacity - a
        for k in range(1, fan + 1):
            b = rest * k // (2 * fan)
            if 0 < b <= rest - b and b <= a and have[b] and have[rest - b]:
                rows.append((a, rest - b, b))
    return np.unique(np.sort(np.array(rows, dtype=np.int64).reshape(-1, 3), axis=1), axis=0)


def fit_repeats(shapes: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares of repeat counts x, histogram ~ A x, where A
    counts each length in each pattern; multiplicative updates keep x >= 0."""
    if not len(shapes):
        return np.zeros(0)
    flat, size = shapes.ravel(), len(histogram)

    def spread(x: np.ndarray) -> np.ndarray:  # A x
        out = np.bincount(flat, weights=np.repeat(x, shapes.shape[1]), minlength=size)
        out[0] = 0
        return out

    def gather(h: np.ndarray) -> np.ndarray:  # A' h
        h = h.copy()
        h[0] = 0
        return h[shapes].sum(axis=1)

    goal = gather(histogram.astype(float))
    x = goal / max(1.0, float(len(shapes)))
    for _ in range(steps):
        x *= goal / np.maximum(gather(spread(x)), 1e-12)
    return x


def plan_packing(histogram: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(sequences, [(length, pieces of it per sequence)])] for a histogram of
    lengths 0..capacity: full pieces, fitted patterns, then best fit of the
    rest, longest first. Every piece has a place, no sequence exceeds capacity."""
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[int, list[tuple[int, int]]]] = []
    if left[capacity]:
        plan.append((int(left[capacity]), [(capacity, 1)]))
        left[capacity] = 0
    shapes = patterns(np.flatnonzero(left), capacity)
    repeats = np.floor(fit_repeats(shapes, left) + 0.5).astype(np.int64)
    for k in np.argsort(-repeats, kind="stable"):
        if not repeats[k]:
            break
        lengths, each = np.unique(shapes[k][shapes[k] > 0], return_counts=True)
        n = int(min(repeats[k], (left[lengths] // each).min()))
        if n > 0:
            left[lengths] -= n * each
            plan.append((n, [(int(a), int(b)) for a, b in zip(lengths, each, strict=True)]))
    # best fit, longest first; alike sequences are handled together
    open_by_room: dict[int, list[list]] = {}
    rooms = np.zeros(capacity + 1, dtype=np.int64)

    def put(n: int, shape: list[tuple[int, int]], room: int) -> None:
        if n and room:
            open_by_room.setdefault(room, []).append([n, shape])
            rooms[room] += n
        elif n:
            plan.append((n, shape))

    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                each = min(capacity // length, count)
                put(count // each, [(length, each)], capacity - each * length)
                count -= count // each * each
                continue
            room = length + int(fits[0])
            group = open_by_room[room][-1]
            each = min(room // length, count)
            n = min(group[0], count // each)
            group[0] -= n
            rooms[room] -= n
            if not group[0]:
                open_by_room[room].pop()
            put(n, [*group[1], (length, each)], room - each * length)
            count -= n * each
    for groups in open_by_room.values():
        plan += [(n, shape) for n, shape in groups if n]
    return plan


def _places(plan: list, spark: SparkSession) -> DataFrame:
    """For each length: pieces numbered first to last go, ``each`` to a
    sequence, to sequences from ``sequence`` on, at ``place``. The plan follows
    the number of lengths, at most the capacity, not the number of documents."""
    rows, sequence, used = [], 0, {}
    for n, shape in plan:
        place = 0
        for length, each in shape:
            first = used.get(length, 0)
            rows.append((length, first, first + n * each, each, sequence, place))
            used[length] = first + n * each
            place += length * each
        sequence += n
    return spark.createDataFrame(rows, "length long, first long, last long, each long, sequence long, place long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``: doc_id, piece, start,
    length, ids_crc32, sequence_id, offset.

    A null text is empty and has the one piece [end_id]. Only documents longer
    than ``capacity`` are cut; texts are tokenised whole, whatever their length.
    Repeated rows are packed as often as they occur, a null doc_id like any
    other; pieces of one length are alike to the plan and get their places in
    hashed order. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = cut(rows.mapInArrow(_pieces(tokenizer_path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # capacity rows at most
        histogram[row["length"]] = row["count"]
    places = _places(plan_packing(histogram, capacity), docs.sparkSession)
    numbered = gapless(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "_nth")
    placed = numbered.join(F.broadcast(places), "length").filter((F.col("_nth") >= F.col("first")) & (F.col("_nth") < F.col("last")))
    inside = F.col("_nth") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(inside / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("place") + F.pmod(inside, F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )
