"""Toxicity: a convolutional text classifier in numpy.

A word's vector is the sum of rows of a hashed embedding table, one for the
word and one for each of several beginnings of it, which tell whether the word
goes on. Filters of several widths run over the words, the maximum over the
whole text of each filter feeds a logistic layer.
The model is fitted on a bounded sample of labelled documents; scores are then
calibrated so that each language's own threshold, found on rows kept out of the
fit, lies at one common score. The language is guessed from the text itself.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import cut, refuse_taken
from brindle.llm.divergence import COMMON_WORDS
from brindle.llm.hashing import NO_LETTER, by_text

PREFIXES = (5, 6, 7, 8)  # bytes
WIDTHS = (1, 2, 3)
_LANGS = sorted(COMMON_WORDS)
# function words by their hashes, in the languages' order
_STOP = [np.unique(next(by_text([" ".join(COMMON_WORDS[lang])], NO_LETTER))) for lang in _LANGS]


def _prepare(texts: list, rows: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text an array of the table rows of its words (first column) and
    their beginnings, and its language: the index of the list with the most words in the text,
    -1 if none has any."""
    half, ids, langs = np.uint64(rows // 2), [], np.full(len(texts), -1)
    for at in range(0, len(texts), 256):
        for k, (words, *heads) in enumerate(by_text([(t or "").lower() for t in texts[at : at + 256]], NO_LETTER, PREFIXES), at):
            ids.append(np.stack([words % half, *(h % half + half for h in heads)], axis=1).astype(np.int32))
            votes = [np.isin(words, listed).sum() for listed in _STOP]
            if max(votes):
                langs[k] = int(np.argmax(votes))
    return ids, langs


class ConvClassifier:
    """Hashed embeddings, filters of widths 1 to 3, max pooling, logistic output."""

    def __init__(self, rows: int = 1 << 17, size: int = 8, filters: int = 8, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.rows, self.size = rows, size
        self.table = (rng.standard_normal((rows, size)) * 0.05).astype(np.float32)
        self.kernels = [(rng.standard_normal((w, size, filters)) * 0.3).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(filters, dtype=np.float32) for _ in WIDTHS]
        self.out = (rng.standard_normal(filters * len(WIDTHS)) * 0.1).astype(np.float32)
        self.out_bias = np.float32(0)
        self.cuts = np.zeros(len(_LANGS) + 1)  # logit thresholds by guessed language

    # -- forward ------------------------------------------------------------

    def _pooled(self, ids: np.ndarray, most: int | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Maxima of all filters over their windows inside the text, and where
        they lie; at most the first ``most`` windows. A text shorter than a
        window has one, filled up with zeros."""
        pad = max(WIDTHS) - 1
        x = np.zeros((max(len(ids), 1) + pad, self.size), dtype=np.float32)
        for column in ids.T:
            x[: len(ids)] += self.table[column]
        best, places = [], []
        for w, kernel, bias in zip(WIDTHS, self.kernels, self.bias, strict=True):
            n = max(1, len(ids) - w + 1)
            n = n if most is None else min(n, most)
            conv = x[:n] @ kernel[0]
            for k in range(1, w):
                conv += x[k : n + k] @ kernel[k]
            at = conv.argmax(axis=0)
            places.append(at)
            best.append(np.maximum(conv[at, np.arange(conv.shape[1])] + bias, 0))
        return np.concatenate(best), places, x

    def logits(self, texts: list, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
        """Logit and language of each text; a very long one in pieces that
        overlap, so that each window lies in one piece."""
        all_ids, langs = _prepare(texts, self.rows)
        out = np.empty(len(texts))
        for k, ids in enumerate(all_ids):
            # the last piece begins early enough to hold a whole window of each width
            last = max(len(ids) - max(WIDTHS) + 1, 1)
            parts = [self._pooled(ids[a : a + step + max(WIDTHS) - 1], step if a + step < last else None)[0] for a in range(0, last, step)]
            out[k] = float(np.max(parts, axis=0) @ self.out + self.out_bias)
        return out, langs

    # -- fit ----------------------------------------------------------------

    def fit(self, texts: list, labels: np.ndarray, epochs: int = 8, rate: float = 0.01, batch: int = 32, seed: int = 12) -> ConvClassifier:
        ids, _ = _prepare(texts, self.rows)
        self._start(ids, labels)
        rng = np.random.default_rng(seed)
        slots = {name: [np.zeros_like(p) for p in self._parameters(name)] for name in ("kernels", "bias", "out")}
        table_slot = np.full(self.rows, 1e-3, dtype=np.float32)
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6)).clip(0.2, 5)
        for _ in range(epochs):
            order = rng.permutation(len(ids))
            for at in range(0, len(order), batch):
                grads = {name: [np.zeros_like(p) for p in self._parameters(name)] for name in slots}
                out_bias, touched = 0.0, []
                for d in order[at : at + batch]:
                    pooled, places, x = self._pooled(ids[d])
                    error = weight[d] * (1 / (1 + np.exp(-(pooled @ self.out + self.out_bias))) - labels[d])
                    out_bias += error
                    grads["out"][0] += error * pooled
                    back = (error * self.out * (pooled > 0)).reshape(len(WIDTHS), -1)
                    for v, w in enumerate(WIDTHS):
                        grads["bias"][v] += back[v]
                        for k in range(w):
                            rows = places[v] + k
                            grads["kernels"][v][k] += x[rows].T * back[v][None, :]
                            real = rows < len(ids[d])
                            step = (self.kernels[v][k] * back[v][None, :]).T[real]
                            for side in ids[d][rows[real]].T:
                                touched.append((side, step))
                n = len(order[at : at + batch])
                for name, slot in slots.items():
                    for p, g, s in zip(self._parameters(name), grads[name], slot, strict=True):
                        g /= n
                        s += g * g
                        p -= rate * g / (np.sqrt(s) + 1e-6)
                self.out_bias -= np.float32(rate * 5 * out_bias / n)
                rows = np.concatenate([r for r, _ in touched]) if touched else np.zeros(0, dtype=int)
                if len(rows):
                    steps = np.concatenate([s for _, s in touched]) / n
                    unique, inverse = np.unique(rows, return_inverse=True)
                    total = np.zeros((len(unique), self.size), dtype=np.float32)
                    np.add.at(total, inverse, steps)
                    table_slot[unique] += (total * total).mean(axis=1)
                    self.table[unique] -= rate * total / (np.sqrt(table_slot[unique])[:, None] + 1e-6)
        return self

    def _parameters(self, name: str) -> list[np.ndarray]:
        value = getattr(self, name)
        return value if isinstance(value, list) else [value]

    def _start(self, ids: list[np.ndarray], labels: np.ndarray) -> None:
        """Start the first embedding coordinate at the log odds of the label
        given the row, and one filter of each width along it."""
        seen = np.zeros((2, self.rows))
        for rows, label in zip(ids, labels, strict=True):
            seen[int(label), np.unique(rows)] += 1
        n = np.bincount(labels.astype(int), minlength=2)
        odds = np.log((seen[1] + 0.3) / (n[1] + 1)) - np.log((seen[0] + 0.3) / (n[0] + 1))
        self.table[:, 0] += np.where(seen.sum(axis=0) >= 3, np.clip(odds, -4, 4) / 4, 0).astype(np.float32)
        for kernel in self.kernels:
            kernel[:, 0, : kernel.shape[2] // 2] = np.abs(kernel[:, 0, : kernel.shape[2] // 2]) + 1.0
        for bias in self.bias:
            bias[: len(bias) // 2] = -0.5
        self.out[:] = np.abs(self.out) * 3
        self.out_bias = np.float32(-2)

    def calibrate(self, texts: list, labels: np.ndarray, least: int = 40) -> ConvClassifier:
        """Per guessed language, the logit threshold of the best F1 on these
        rows; languages with fewer than ``least`` toxic rows share one."""
        logits, langs = self.logits(texts)
        self.cuts[:] = _best_cut(logits, labels)
        for k in range(len(_LANGS)):
            own = langs == k
            if labels[own].sum() >= least and (1 - labels[own]).sum() >= least:
                self.cuts[k] = _best_cut(logits[own], labels[own])
        return self

    def scores(self, texts: list, cut_score: float = 0.3) -> np.ndarray:
        """Scores in [0, 1]; a text at its language's threshold gets ``cut_score``."""
        logits, langs = self.logits(texts)
        return 1 / (1 + np.exp(-(np.clip(logits - self.cuts[langs], -30, 30) + np.log(cut_score / (1 - cut_score)))))


def _best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the widest gap among thresholds of the highest F1."""
    order = np.argsort(-logits)
    sorted_logits, hits = logits[order], np.cumsum(labels[order])
    if not len(order) or not hits[-1]:
        return float(logits.max() + 5) if len(order) else 0.0
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + hits[-1])
    after = np.append(sorted_logits[1:], sorted_logits[-1] - 2)
    gap = np.where(f1 >= f1.max() - 0.002, sorted_logits - after, -1)
    k = int(gap.argmax())
    return float((sorted_logits[k] + after[k]) / 2)


def bucket(doc_id, parts: int = 4):
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(parts))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 6000, longest: int = 100_000, most_chars: int = 40_000_000, epochs: int = 8) -> ConvClassifier:
    """Fit on at most ``sample`` labelled rows outside the held-out fold
    (crc32(doc_id) mod 4 = 2), in hashed order, a third of them toxic ones;
    fold 3 of them calibrates. The fit runs in one task. To bound its memory, texts beyond
    ``longest`` code points are not fitted on, and the sample ends where its
    texts reach ``most_chars`` code points together; scoring has no such bounds.
    Of several texts of one id the least is taken, of several labels the highest."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(bucket(F.col("doc_id")) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.xxhash64(F.lit(23), "doc_id")
    toxic, clean = (known.filter(F.col("toxic") == t).orderBy(place, "doc_id").limit(n) for t, n in ((1, sample // 3), (0, sample - sample // 3)))
    picked = cut(toxic.unionByName(clean))  # sample rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") <= longest)
    texts = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    texts = cut(texts.withColumn("place", place))
    sizes = texts.select("doc_id", F.sum(F.length("text")).over(Window.partitionBy(F.lit(0)).orderBy("place", "doc_id")).alias("upto"))  # sample rows at most
    rows = texts.join(F.broadcast(sizes.filter(F.col("upto") <= most_chars)), "doc_id").select("text", "toxic", (bucket(F.col("doc_id")) == 3).alias("held"), "doc_id")
    found = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(_fitted(epochs), "model binary").first()
    return pickle.loads(found["model"]) if found else ConvClassifier()


def _fitted(epochs: int):
    def fit(batches):
        model, rows = ConvClassifier(), list(batches)
        if rows:
            texts, y, held = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in rows]) for k in range(3))
            y, held = y.astype(float), held.astype(bool)
            if held.all():
                held[:] = False
            model.fit(texts[~held].tolist(), y[~held], epochs)
            apart = held if held.any() else ~held
            model.calibrate(texts[apart].tolist(), y[apart])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    return fit


def score_rows(docs: DataFrame, model: ConvClassifier, cut_score: float = 0.3, name: str = "_score") -> DataFrame:
    """``docs`` with its columns as they are and a score (0 to 1) appended.

    Whole texts are scored, very long ones in pieces that lose no window; null
    and empty texts get the score of no words. Columns other than the text never
    enter a score. A ``name`` that ``docs`` has already raises. Repeated rows
    are scored alike; an empty table gives an empty result.
    """
    refuse_taken(docs, [name])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB whatever the input

    def score(batches):
        for batch in batches:
            at_text = batch.schema.get_field_index("text")
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = pa.array(shared.value.scores(part.column(at_text).to_pylist(), cut_score), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], [*part.schema.names, name])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score_toxicity(docs: DataFrame, model: ConvClassifier, cut_score: float = 0.3) -> DataFrame:
    """doc_id and score (0 to 1) for every row of ``docs(doc_id, text)``, as score_rows."""
    return score_rows(docs.select("doc_id", "text"), model, cut_score).select("doc_id", F.col("_score").alias("score"))
