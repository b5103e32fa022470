"""Quality by co-training a text-content and a page-metadata classifier.

The content view sees hashed words and hashed runs of non-letters; the metadata
view sees the language, the source and the stored length, and nothing of the
text. Both are logistic models fitted in numpy on a bounded labelled sample and
calibrated on a fold of their own. In each round all unlabelled documents are
scored by both views in tasks, and each view hands the other those it is surest
of as pseudo-labels. In the end the views are weighted by their skill on the
calibration fold, and all documents are scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import cut, refuse_taken
from brindle.llm.conv_classifier import bucket
from brindle.llm.hashing import NO_LETTER, by_text

HASHED, SHAPES, META_SIZE = 1 << 14, 16, 4096
CONTENT_SIZE = HASHED + SHAPES


def content_features(texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: hashed features with their normalised log counts, and how
    repetitive its words are."""
    out = []
    letters = by_text([(t or "").lower() for t in texts], NO_LETTER)
    others = by_text([(t or "").replace(" ", "") for t in texts], ~NO_LETTER)
    half = np.uint64(HASHED // 2)
    for words, runs in zip(letters, others, strict=True):
        rows, counts = np.unique(np.concatenate([words % half, runs % half + half]), return_counts=True)
        values = np.log1p(counts)
        # both halves of one weight, so that long texts do not drown the marks
        for side in (rows < half, rows >= half):
            values[side] /= max(1e-9, np.linalg.norm(values[side]))
        # how much of the text its commonest word makes up, in steps of a tenth
        top = np.unique(words, return_counts=True)[1].max() / len(words) if len(words) else 0.0
        shape = HASHED + (min(9, int(top * 10)) if len(words) >= 20 else 10)
        out.append((np.append(rows, shape).astype(np.int32), np.append(values, 1.0).astype(np.float32)))
    return out


def meta_features(lang, source, n_chars) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a page's metadata: language, source and stored
    length by half powers of two, and their pairs. No text."""
    size = "none" if n_chars is None else str(int(2 * np.log2(max(0, n_chars) + 1)))
    named = [(f"lang {lang}", 0.5), (f"source {source}", 0.5), (f"size {size}", 0.5), (f"lang {lang} size {size}", 0.3), (f"lang {lang} source {source}", 0.3)]
    at = np.array([0] + [1 + zlib.crc32(name.encode()) % (META_SIZE - 1) for name, _ in named], dtype=np.int32)
    rows, place = np.unique(at, return_inverse=True)
    return rows.astype(np.int32), np.bincount(place, weights=[1.0] + [v for _, v in named]).astype(np.float32)


class Logistic:
    """Logistic regression on sparse rows, full-batch Adam."""

    def __init__(self, size: int):
        self.weights, self.bias, self.slope, self.shift = np.zeros(size), 0.0, 1.0, 0.0

    def fit(self, rows: list, y: np.ndarray, steps: int = 200, rate: float = 0.08, decay: float = 1e-4) -> Logistic:
        index, values = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).clip(0.2, 5) / len(y)
        w, b = np.zeros(len(self.weights)), 0.0
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for t in range(1, steps + 1):
            z = np.bincount(owner, weights=values * w[index], minlength=len(rows)) + b
            error = weight * (1 / (1 + np.exp(-z)) - y)
            g = np.bincount(index, weights=values * error[owner], minlength=len(w)) + decay * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            gb = error.sum()
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
        self.weights, self.bias = w, b
        return self

    def raw(self, rows: list) -> np.ndarray:
        return np.array([float(r[1] @ self.weights[r[0]]) + self.bias for r in rows])

    def calibrate(self, rows: list, y: np.ndarray) -> Logistic:
        self.slope, self.shift = _platt(self.raw(rows), y)
        return self

    def logit(self, rows: list) -> np.ndarray:
        return np.clip(self.slope * self.raw(rows) + self.shift, -12, 12)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logit, fitted on rows kept apart."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton steps on two numbers
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        h = p * (1 - p) + 1e-6
        gradient = np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()])
        hessian = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(a), float(b)


class CoTrained:
    """Both views, the weights of their calibrated logits, and the least score kept."""

    def __init__(self, content: Logistic, meta: Logistic):
        self.content, self.meta, self.weights, self.slope, self.shift, self.least = content, meta, (1.0, 0.0), 1.0, 0.0, 0.5

    def logits(self, content: list, meta: list) -> tuple[np.ndarray, np.ndarray]:
        return self.content.logit(content), self.meta.logit(meta)

    def scores(self, content: list, meta: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of each view and of both."""
        a, b = self.logits(content, meta)
        both = np.clip(self.slope * (self.weights[0] * a + self.weights[1] * b) + self.shift, -12, 12)
        return tuple(1 / (1 + np.exp(-z)) for z in (a, b, both))

    def combine(self, content: list, meta: list, y: np.ndarray) -> CoTrained:
        """Weigh the views by their skill on rows kept apart: how much of the
        log loss of the base rate their calibrated probabilities save."""
        z = self.logits(content, meta)
        loss = lambda p: -np.mean(np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-6, 1)))
        skill = [max(0.0, 1 - loss(1 / (1 + np.exp(-v))) / loss(np.full(len(y), y.mean()))) for v in z]
        total = sum(skill)
        self.weights = tuple(s / total for s in skill) if total > 0 else (0.5, 0.5)
        self.slope, self.shift = _platt(self.weights[0] * z[0] + self.weights[1] * z[1], y)
        self.least = _lenient_cut(self.scores(content, meta)[2], y)
        return self


#: (model, pseudo-labels so far) to what the views hand over: for each view that
#: learns, rows of its features and their labels.
Exchange = Callable[["CoTrained"], list[tuple[list, np.ndarray]]]


def co_train(known: list[list], y: np.ndarray, apart: np.ndarray, exchange: Exchange | None, rounds: int = 2) -> CoTrained:
    """``known`` holds the rows of both views, [content, meta]; rows ``apart``
    calibrate. After each of ``rounds`` fits, ``exchange`` lets each calibrated
    view label unlabelled rows for the other."""
    fit, held = np.flatnonzero(~apart), np.flatnonzero(apart)
    own, labels = [[known[v][k] for k in fit] for v in (0, 1)], [y[fit], y[fit]]
    aside = [[known[v][k] for k in held] for v in (0, 1)]
    both = CoTrained(Logistic(CONTENT_SIZE), Logistic(META_SIZE))
    for turn in range(rounds + 1):
        for v, model in enumerate((both.content, both.meta)):
            model.fit(own[v], labels[v])
            model.calibrate(aside[v], y[held])
        if turn < rounds and exchange is not None:
            for v, (rows, taught) in enumerate(exchange(both)):
                own[v] += rows
                labels[v] = np.append(labels[v], taught)
    return both.combine(*aside, y[held])


def _lenient_cut(p: np.ndarray, y: np.ndarray) -> float:
    """Among the cuts that reject at most 1 in 500 good rows, the one with the
    most right verdicts, placed in the middle of its gap and at most at 0.5."""
    order = np.argsort(p, kind="stable")
    q, good = p[order], y[order]
    wrong, right = np.cumsum(good), np.cumsum(1 - good)
    fair = wrong <= max(0, int(good.sum() * 0.002))
    if not fair.any():
        return 0.0
    k = int(np.flatnonzero(fair)[np.argmax((right - wrong)[fair])])
    above = q[k + 1] if k + 1 < len(q) else 1.0
    return float(min(0.5, (q[k] + above) / 2))


_USED = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _columns(docs: DataFrame) -> DataFrame:
    """The columns used; a missing lang, source or n_chars counts as null."""
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in _USED.items()])


def _views(part: pa.RecordBatch) -> tuple[list, list]:
    """Both views' rows of a batch, from whole texts."""
    got = {c: part.column(part.schema.get_field_index(c)).to_pylist() if c in part.schema.names else [None] * part.num_rows for c in ("text", "lang", "source", "n_chars")}
    return content_features(got["text"]), [meta_features(*x) for x in zip(got["lang"], got["source"], got["n_chars"], strict=True)]


def _parts(batches, step: int = 256):
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _gathered(rows: DataFrame) -> pd.DataFrame:
    """(doc_id, key) and both views of a bounded number of rows on the driver;
    of texts of one id and key one counts."""
    def features(batches):
        for part in _parts(batches):
            content, meta = _views(part)
            columns = [[x.tobytes() for x in side] for view in (content, meta) for side in zip(*view, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(part.schema.get_field_index("key")), *[pa.array(c, pa.binary()) for c in columns]], ["doc_id", "key", "ids", "counts", "meta_ids", "meta_counts"])

    found = rows.mapInArrow(features, "doc_id long, key long, ids binary, counts binary, meta_ids binary, meta_counts binary")
    return found.groupBy("doc_id", "key").agg(*[F.first(c).alias(c) for c in ("ids", "counts", "meta_ids", "meta_counts")]).toPandas().sort_values(["doc_id", "key"])


def _rows_of(frame: pd.DataFrame) -> tuple[list, list]:
    read = lambda a, b: [(np.frombuffer(x, dtype=np.int32), np.frombuffer(y, dtype=np.float32)) for x, y in zip(frame[a], frame[b], strict=True)]
    return read("ids", "counts"), read("meta_ids", "meta_counts")


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 4000, rounds: int = 2, handed: int = 100, sure: float = 0.95) -> CoTrained | None:
    """Fit on at most ``sample`` labelled rows, in hashed order. Fold 2 of
    crc32(doc_id) mod 4 is left out (for tests), fold 3 calibrates.

    In each round every unlabelled document is scored by both calibrated views
    in tasks, and each view hands the other its surest ``handed`` texts of each
    label among all of them, if their probability reaches ``sure``; equal texts
    count once. None if a class has no labelled row to fit or calibrate.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = known.filter(bucket(F.col("doc_id")) != 2)
    ordered = [F.xxhash64(F.lit(29), "doc_id"), F.col("doc_id")]
    bad, good = (known.filter(F.col("quality") == q).orderBy(*ordered).limit(n) for q, n in ((0, sample // 3), (1, sample - sample // 3)))
    picked = cut(bad.unionByName(good))  # sample rows at most
    used = _columns(docs).withColumn("key", F.xxhash64("text"))
    rows = _gathered(used.join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi"))
    rows = rows.drop_duplicates("doc_id").merge(picked.toPandas(), on="doc_id").sort_values("doc_id")
    y = rows["quality"].to_numpy().astype(float)
    apart = np.array([zlib.crc32(str(k).encode()) % 4 == 3 for k in rows["doc_id"]], dtype=bool)
    if any(len(np.unique(y[s])) < 2 for s in (apart, ~apart)):
        return None
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    handed_over: list[set] = [set(), set()]  # texts that each view has learnt from

    def exchange(model: CoTrained) -> list[tuple[list, np.ndarray]]:
        shared = docs.sparkSession.sparkContext.broadcast(model)  # two weight vectors

        def judge(batches):
            for part in _parts(batches):
                p = [1 / (1 + np.exp(-z)) for z in shared.value.logits(*_views(part))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(part.schema.get_field_index("key")), *map(pa.array, p)], ["doc_id", "key", "p0", "p1"])

        # all are judged and the labelled ones left out afterwards, so that no text is shuffled
        judged = used.filter("doc_id is not null").mapInArrow(judge, "doc_id long, key long, p0 double, p1 double").join(labelled, "doc_id", "left_anti")
        judged = cut(judged.groupBy("key").agg(F.min(F.struct("doc_id", "p0", "p1")).alias("r")).select("key", "r.*"))
        chosen = []  # (doc_id, key, learning view, label)
        for view in (0, 1):
            for label in (0, 1):
                surety = F.col(f"p{view}") if label else 1 - F.col(f"p{view}")
                top = judged.filter(surety >= sure).orderBy(F.desc(surety), F.xxhash64("key"), "key").limit(handed + len(handed_over[1 - view])).select("doc_id", "key").collect()
                fresh_ones = [(r["doc_id"], r["key"]) for r in top if r["key"] not in handed_over[1 - view]][:handed]
                handed_over[1 - view] |= {k for _, k in fresh_ones}
                chosen += [(*pair, 1 - view, label) for pair in fresh_ones]
        out: list[tuple[list, np.ndarray]] = [([], np.zeros(0)), ([], np.zeros(0))]
        if chosen:
            wanted = docs.sparkSession.createDataFrame(sorted({c[:2] for c in chosen}), "doc_id long, key long")  # 4 * handed rows at most
            frame = _gathered(used.join(F.broadcast(wanted), ["doc_id", "key"], "left_semi"))
            place = {pair: k for k, pair in enumerate(zip(frame["doc_id"].tolist(), frame["key"].tolist(), strict=True))}
            views = _rows_of(frame)
            for v in (0, 1):
                mine = [(place[c[:2]], c[3]) for c in chosen if c[2] == v and c[:2] in place]
                out[v] = ([views[v][k] for k, _ in mine], np.array([label for _, label in mine], dtype=float))
        return out

    return co_train(list(_rows_of(rows)), y, apart, exchange, rounds)


_SCORES = ["_content_score", "_meta_score", "_score", "_kept"]


def score_rows(docs: DataFrame, model: CoTrained | None, names: list[str] = _SCORES) -> DataFrame:
    """``docs(doc_id, text, lang, source, n_chars)`` with its columns as they
    are and four columns appended under ``names``: the content, metadata and
    combined score (0 to 1, high is good) and whether the row is kept.

    Whole texts are scored; nulls in any column and empty texts have features
    like any other value, and a missing column counts as null. Names that
    ``docs`` has already raise. Without a model (no labelled rows of both
    classes) scores are null and all rows are kept. Repeated rows are scored
    alike; an empty table gives an empty result.
    """
    refuse_taken(docs, names)
    if model is None:
        return docs.withColumns({**{c: F.lit(None).cast("double") for c in names[:3]}, names[3]: F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two weight vectors

    def score(batches):
        for part in _parts(batches):
            scores = shared.value.scores(*_views(part))
            yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, scores), pa.array(scores[2] >= shared.value.least)], [*part.schema.names, *names])

    added = [*[T.StructField(c, T.DoubleType()) for c in names[:3]], T.StructField(names[3], T.BooleanType())]
    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, *added]))


def score_quality(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, content_score, meta_score, score,
    kept, as score_rows."""
    return score_rows(_columns(docs), model).select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("content_score", "meta_score", "score", "kept")])
