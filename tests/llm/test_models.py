"""Classifiers on held-out rows, edge rows, and the pipeline on a small corpus."""

import random
import zlib

import numpy as np
import pytest
from brindle.llm import conv_classifier, cotrain
from brindle.llm.common import fresh
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score int"


def make(n, seed):
    """Documents in two languages; toxic ones hold insults, junk is in capitals."""
    rng = random.Random(seed)
    words = {"en": ["the", "of", "and", "river", "stone", "walks", "green", "house"], "de": ["der", "die", "und", "haus", "stein", "geht", "grün", "fluss"]}
    insults = {"en": ["moron", "scum"], "de": ["lump", "depp"]}
    docs, labels = [], []
    for k in range(n):
        lang = rng.choice(["en", "de"])
        text = [rng.choice(words[lang]) for _ in range(rng.randint(20, 80))]
        toxic, junk = rng.random() < 0.25, rng.random() < 0.25
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(insults[lang])
        body = " ".join(text)
        body = body.upper().replace(" ", "!! ") if junk else body
        docs.append((k, body, lang, f"s{k % 5}", len(body), 1))
        labels.append((k, int(not junk), int(toxic)))
    return docs, labels


def fold(k):
    return zlib.crc32(str(k).encode()) % 4


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = make(900, 1)
    return docs, labels, spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels[:700], "doc_id long, quality int, toxic int")


EDGE = [(None, None, None, None, None, 1), (90001, "", "xx", "", 0, 1), (90002, "word " * 300_000, "en", "s", 5, 1), (90003, "x" * 3_000_000, None, "s", 5, 1)]


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels, df, known = tables
    model = conv_classifier.fit_toxicity(df, known)
    scores = {r["doc_id"]: r["score"] for r in conv_classifier.score_toxicity(df, model).collect()}
    held = [(k, t) for k, _, t in labels if fold(k) == 2]
    right = sum((scores[k] >= 0.3) == bool(t) for k, t in held)
    assert right >= 0.95 * len(held)
    edge = conv_classifier.score_toxicity(spark.createDataFrame(EDGE, DOCS), model).collect()
    assert len(edge) == 4 and all(0 <= r["score"] <= 1 for r in edge)
    by_id = {r["doc_id"]: r["score"] for r in edge}
    assert by_id[None] == by_id[90001]


def test_toxic_word_far_inside_a_long_text(spark, tables):
    docs, labels, df, known = tables
    model = conv_classifier.fit_toxicity(df, known)
    filler = "the river stone walks green house " * 40_000
    got = model.scores([filler, filler + " moron scum " + filler])
    assert got[0] < 0.3 <= got[1]


def plain_logit(model, ids):
    """The forward pass word by word and window by window."""
    x = [sum(model.table[row].astype(float) for row in word) for word in ids] or [np.zeros(model.size)]
    pooled = []
    for kernel, bias in zip(model.kernels, model.bias, strict=True):
        w = len(kernel)
        windows = [x[k : k + w] for k in range(max(1, len(x) - w + 1))]
        for f in range(kernel.shape[2]):
            pooled.append(max(0.0, max(sum(float(v @ kernel[k, :, f]) for k, v in enumerate(win)) for win in windows) + float(bias[f])))
    return float(np.dot(pooled, model.out) + model.out_bias)


def test_forward_pass_matches_a_plain_loop_whatever_the_pieces():
    rng = random.Random(2)
    model = conv_classifier.ConvClassifier(rows=1 << 10, size=4, filters=3)
    texts = [None, "", "a", "a b", "a b c"] + [" ".join(f"w{rng.randrange(60)}x{rng.randrange(9)}yyyy" for _ in range(n)) for n in (4, 17, 64, 65, 66, 200)]
    ids, _ = conv_classifier._prepare(texts, model.rows)
    want = [plain_logit(model, i) for i in ids]
    for step in (1 << 16, 64, 63, 7, 3):
        assert model.logits(texts, step)[0] == pytest.approx(want, abs=1e-4), step


def test_training_adds_to_its_start(tables):
    """Toxic if two harmless words meet: no word alone says it."""
    rng = random.Random(3)
    words = ["river", "stone", "walks", "green", "house", "light"]
    texts, y = [], []
    for _ in range(1200):
        text = [rng.choice(words) for _ in range(25)]
        joined = " ".join(text).replace("green house", "green light")
        toxic = rng.random() < 0.3
        texts.append(joined + (" green house " if toxic else " walks river ") + " ".join(rng.choice(words[:2]) for _ in range(8)))
        y.append(float(toxic))
    y = np.array(y)
    right = []
    for epochs in (0, 8):
        model = conv_classifier.ConvClassifier().fit(texts[:800], y[:800], epochs).calibrate(texts[800:1000], y[800:1000])
        right.append(((model.scores(texts[1000:]) >= 0.3) == (y[1000:] == 1)).mean())
    assert right[1] >= 0.95 and right[1] > right[0] + 0.1, right


def test_toxicity_without_labels(spark, tables):
    model = conv_classifier.fit_toxicity(tables[2], tables[3].limit(0))
    assert conv_classifier.score_toxicity(tables[2], model).count() == 900
    assert conv_classifier.score_toxicity(tables[2].limit(0), model).count() == 0


def test_quality_features_do_not_depend_on_the_neighbours():
    texts = ["a b!", "# Title 1", "1. one", "123 ...", "", None, "<html> x", "word", "?!"]
    together = cotrain.content_features(texts)
    for text, (rows, values) in zip(texts, together, strict=True):
        alone = cotrain.content_features([text])[0]
        assert list(rows) == list(alone[0]) and list(values) == list(alone[1])
    # a hash of the marks and one of the shape, even where a text has no letter
    assert [len(rows) for rows, _ in cotrain.content_features(["word", "?!", "word ?!"])] == [2, 2, 3]


def test_quality_on_held_out_rows(spark, tables):
    docs, labels, df, known = tables
    model = cotrain.fit_quality(df, known)
    out = cotrain.score_quality(df, model).collect()
    kept = {r["doc_id"]: r["kept"] for r in out}
    held = [(k, q) for k, q, _ in labels if fold(k) == 2]
    assert sum(kept[k] == bool(q) for k, q in held) >= 0.97 * len(held)
    assert sum(not kept[k] for k, q in held if q) <= 0.01 * len(held)
    edge = cotrain.score_quality(spark.createDataFrame(EDGE, DOCS), model).collect()
    assert len(edge) == 4 and all(0 <= r["score"] <= 1 for r in edge)
    assert cotrain.score_rows(df, model).columns[: len(df.columns)] == df.columns


def test_views_teach_each_other():
    """Source decides quality and so do words: half of each view's vocabulary
    is unlabelled, and the exchange brings it in."""
    rng = random.Random(5)

    def page(k, known):
        good = rng.random() < 0.5
        half = 0 if known else rng.randrange(2)
        words = [("good" if good else "bad") + "xy"[half] + chr(97 + rng.randrange(6)) for _ in range(8)] + ["any" + chr(97 + rng.randrange(26)) for _ in range(8)]
        return " ".join(words), f"{'g' if good else 'b'}{rng.randrange(3) if known else rng.randrange(6)}", float(good)

    known, free, test = [page(k, True) for k in range(80)], [page(k, False) for k in range(3000)], [page(k, False) for k in range(600)]
    views = lambda rows: [cotrain.content_features([r[0] for r in rows]), [cotrain.meta_features("en", r[1], 9) for r in rows]]
    k, f, t = views(known), views(free), views(test)
    y, truth = np.array([r[2] for r in known]), np.array([r[2] for r in test])
    used = [set(), set()]

    def exchange(model):
        p = [1 / (1 + np.exp(-z)) for z in model.logits(*f)]
        out = []
        for learner in (0, 1):
            rows, labels = [], []
            for label in (0, 1):
                surety = p[1 - learner] if label else 1 - p[1 - learner]
                best = [i for i in np.argsort(-surety, kind="stable") if surety[i] >= 0.9 and i not in used[learner]][:200]
                used[learner] |= set(best)
                rows += [f[learner][i] for i in best]
                labels += [label] * len(best)
            out.append((rows, np.array(labels, dtype=float)))
        return out

    apart = np.arange(80) % 3 == 0
    right = []
    for rounds in (0, 2):
        used[:] = [set(), set()]
        model = cotrain.co_train(k, y, apart, exchange, rounds)
        right.append([((s >= 0.5) == (truth == 1)).mean() for s in model.scores(*t)])
    assert all(b > a + 0.05 for a, b in zip(*right, strict=True)) and right[1][2] > 0.95, right


def test_scores_under_taken_names(spark, tables):
    docs, labels, df, known = tables
    clash = df.withColumn("_score", F.lit(1)).withColumn("_KEPT", F.lit(2))
    model = cotrain.fit_quality(clash, known)
    with pytest.raises(ValueError, match="_score"):
        cotrain.score_rows(clash, model)
    assert fresh(clash, "_score", "_kept", "x") == ["__score", "__kept", "x"]
    assert cotrain.score_rows(clash, model, ["a", "b", "c", "d"]).count() == len(docs)
    assert cotrain.score_quality(df.limit(0), model).count() == 0


def test_quality_without_labels_keeps_all(spark, tables):
    model = cotrain.fit_quality(tables[2], tables[3].limit(0))
    assert model is None and cotrain.score_quality(tables[2], model).filter("kept").count() == 900


def test_pipeline_stages(spark, tables, tmp_path):
    import corpus_pipeline

    docs, labels, df, known = tables
    copies = [(5000 + k, docs[k][1] + " tail" * (k % 2), *docs[k][2:]) for k in range(0, 60)]
    frame = spark.createDataFrame(docs + copies, DOCS)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = current.columns
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, current, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        current = spark.read.parquet(f"{tmp_path}/out{k}")
        if name != "packing":
            assert current.columns == columns
        seen.append({r["doc_id"] for r in current.select("doc_id").collect()})
    bad = {k for k, q, _ in labels if not q}
    toxic = {k for k, _, t in labels if t}
    clean = {k for k, q, t in labels if q and not t}
    assert len(seen[0] & bad) <= 0.05 * len(bad) and len(clean - seen[0]) <= 0.01 * len(clean)
    assert len(seen[1] & toxic & clean) == 0 and len(clean - seen[1]) <= 0.03 * len(clean)
    assert len(seen[2] & {5000 + k for k in range(0, 60, 2)}) == 0
    assert seen[3] <= seen[2] and seen[4] == seen[3]


def test_pipeline_stages_on_edge_rows(spark, tables, tmp_path):
    """Nulls everywhere, empty and long texts, repeated ids and rows, and columns
    named like the stages' own; every stage keeps the columns as they are."""
    import corpus_pipeline

    docs, labels, df, known = tables
    known.write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(*d[:5], 1, "k", d[0] % 3) for d in docs[:80]]
    rows += [(None, None, None, None, None, None, None, None), (None, "a null id", "en", "s1", 9, 1, "k", 1), (90001, "", "xx", "", 0, 1, "k", 1), (90002, "word " * 100_000, "en", "s", 5, 1, "k", 1)]
    rows += [(90003, "x" * 300_000, None, "s1", 5, 1, "k", 1), rows[3], rows[3], (rows[4][0], "another text under an id that is there " * 3, "en", "s1", 9, 1, "k", 1)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, _score int, `_kept` string, copies int"
    edge = spark.createDataFrame(rows, columns)
    spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/empty.parquet")
    empty = spark.read.parquet(f"{tmp_path}/empty.parquet")
    given = {str(r) for r in edge.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edge, str(tmp_path))
        got = out.collect()
        assert stage(spark, empty, str(tmp_path)).count() == 0
        if name == "packing":
            assert sum(r["piece"] == 0 for r in got) == len(rows)
            continue
        assert out.dtypes == edge.dtypes and {str(r) for r in got} <= given
        if name == "jaccard":
            ids = [r["doc_id"] for r in got]
            assert ids.count(rows[3][0]) <= 1 and ids.count(rows[4][0]) == 2 and ids.count(None) == 2 and {90001, 90002, 90003} <= set(ids)
        if name == "mixture":
            assert all(r["text"] and r["text"].strip() for r in got) and len(got) > len(rows)
