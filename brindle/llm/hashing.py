"""Whole-array word hashing in numpy for code inside Spark tasks.

A text is one byte array; word borders, 64-bit word hashes and five-word
shingles come from a few array operations, with no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_WEIGHTS = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PIECE = 1 << 20
_powers: dict[str, np.ndarray] = {}

#: ASCII white space, as in ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything ASCII that is no letter; bytes of other scripts count as letters.
NO_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits of the result depend on all bits of h."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, _PIECE + 4096), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.cumprod(steps)
    return have


def pieces(texts: list[str | None], limit: int = _PIECE, border: bytes = b"\n") -> Iterator[tuple[int, int, bytes]]:
    """(first, last + 1, joined bytes) for runs of texts of about ``limit``
    bytes, each text ended by the byte ``border``; a longer text is a run of
    its own."""
    run, size, first = [], 0, 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        if run and size + len(data) > limit:
            yield first, i, border.join(run) + border
            run, size, first = [], 0, i
        run.append(data)
        size += len(data) + 1
    if run:
        yield first, len(texts), border.join(run) + border


def words_of(data: bytes, separators: np.ndarray = SPACE, prefixes: tuple[int, ...] = ()):
    """Starts, ends and 64-bit hashes of the words in ``data`` and, for each of
    ``prefixes``, hashes of each word's first so many bytes; a word that goes on
    behind its prefix has another hash than the prefix as a word."""
    if len(data) > 4 * _PIECE:
        return _long_words(data, separators, prefixes)
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.concatenate(([False], ~separators[raw], [False]))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[0::2], turns[1::2]
    out = [starts, ends, span_hashes(raw, starts, ends)]
    return (*out, *(_head(span_hashes(raw, starts, np.minimum(ends, starts + n)), n, ends - starts) for n in prefixes))


def _head(hashes: np.ndarray, n: int, lengths: np.ndarray) -> np.ndarray:
    return mix(hashes + np.uint64(77 + 2 * n) + (lengths > n).astype(np.uint64))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * _power("up", _BASE, len(raw))[: len(raw)], out=sums[1:])
    back = _power("down", _BASE_INVERSE, len(raw) + 1)[starts]
    return mix((sums[ends] - sums[starts]) * back + (ends - starts).astype(np.uint64))


def _long_words(data: bytes, separators: np.ndarray, prefixes: tuple[int, ...]):
    """As words_of, in pieces that end at separators, for very long texts."""
    raw = np.frombuffer(data, dtype=np.uint8)
    cuts, at = [0], 0
    while len(raw) - at > 2 * _PIECE:
        found = np.flatnonzero(separators[raw[at + _PIECE : at + 2 * _PIECE]])
        if not len(found):
            break
        at += _PIECE + int(found[0]) + 1
        cuts.append(at)
    cuts.append(len(raw))
    if len(cuts) == 2:  # one word of many megabytes
        return _one_long_word(data, separators, prefixes)
    parts = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = words_of(data[a:b], separators, prefixes) if b - a <= 4 * _PIECE else _one_long_word(data[a:b], separators, prefixes)
        parts.append((part[0] + a, part[1] + a, *part[2:]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _one_long_word(data: bytes, separators: np.ndarray, prefixes: tuple[int, ...]):
    """Words of bytes whose separators are too rare to cut at: each word is
    hashed in pieces of a megabyte, to the hash that span_hashes gives."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.concatenate(([False], ~separators[raw], [False]))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[0::2], turns[1::2]
    hashes = np.array([_long_hash(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.uint64)
    heads = [np.array([_long_hash(raw[a : min(b, a + n)]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.uint64) for n in prefixes]
    return starts, ends, mix(hashes), *(_head(mix(h), n, ends - starts) for h, n in zip(heads, prefixes, strict=True))


def _long_hash(word: np.ndarray) -> int:
    """The rolling sum of a word's bytes plus its length, piece by piece."""
    total = len(word)
    for at in range(0, len(word), _PIECE):
        part = word[at : at + _PIECE]
        piece = int(np.sum(_BYTE[part] * _power("up", _BASE, len(part))[: len(part)]))
        total += piece * pow(int(_BASE), at, 2**64)
    return total % 2**64


def by_text(texts: list[str | None], separators: np.ndarray = SPACE, prefixes: tuple[int, ...] = ()) -> Iterator:
    """For each text, in order, the hashes of its words (and prefixes); texts
    are parted by a separator, so that no word crosses their border."""
    border = bytes([10 if separators[10] else int(np.flatnonzero(separators)[0])])
    for first, last, data in pieces(texts, border=border):
        found = words_of(data, separators, prefixes)
        if last - first == 1:
            yield found[2:] if prefixes else found[2]
            continue
        ends = np.cumsum([len((t or "").encode("utf-8", "replace")) + 1 for t in texts[first:last]])
        borders = np.concatenate(([0], np.searchsorted(found[0], ends)))
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            yield tuple(x[a:b] for x in found[2:]) if prefixes else found[2][a:b]


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; a text of fewer
    words has one shingle of all its words, one of no words has none."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    if n < width:
        return mix(np.array([np.sum(words * _WEIGHTS[:n]) + np.uint64(n)], dtype=np.uint64))
    total = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        total += words[k : n - width + 1 + k] * _WEIGHTS[k]
    return np.unique(mix(total + np.uint64(width)))
