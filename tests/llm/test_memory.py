"""What a worker or the driver holds at once."""

import random
import tracemalloc

from brindle.llm import common, conv_classifier, pattern_pack
from brindle.llm.queries import tokenizer_path


def test_packing_holds_few_bytes_beside_its_texts():
    """Pipeline, packing: 110 MB were taken here beside the ids."""
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=5000)) for _ in range(120)]
    units = pattern_pack._Units(tokenizer_path())
    units.encode(texts[:1])
    tracemalloc.start()
    ids = units.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak - sum(a.nbytes for a in ids) < 40e6
    assert ids[7].tolist() == units.tokenizer.encode(texts[7], add_special_tokens=False).ids


def test_toxicity_is_not_fitted_on_the_driver(spark, monkeypatch):
    """Pipeline, driver: the sample's texts came to it."""
    monkeypatch.setattr(conv_classifier.ConvClassifier, "fit", lambda *a, **k: 1 / 0)
    docs = spark.createDataFrame([(k, "vile words" if k % 2 else "kind words") for k in range(40)], "doc_id long, text string")
    model = conv_classifier.fit_toxicity(docs, spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int"))
    bad, good = model.scores(["vile words", "kind words"])
    assert bad > good


def test_components_end_with_stars(spark, monkeypatch):
    """Pipeline, driver on check_h: each round is some 2,700 tasks; there was one more than needed."""
    rounds, cut = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df: rounds.append(1) or cut(df))
    node = "struct<rep:bigint,tag:bigint>"
    stars = [((k, 1), (k % 3, 0)) for k in range(3, 900)]
    got = common.components(spark.createDataFrame(stars, f"u {node}, v {node}"))
    assert {tuple(r["node"]): tuple(r["component"]) for r in got.collect()} == dict(stars)
    assert len(rounds) == 1
    # a hub that is not the least, a hub below which many lie, and a path
    edges = [(500, 500 + k) for k in range(1, 700)] + [(9000, k) for k in range(1, 400)] + [(500, 450), (450, 440)] + [(20_000 + k, 20_001 + k) for k in range(50)]
    got = common.components(spark.createDataFrame([((a, 0), (b, 0)) for a, b in edges], f"u {node}, v {node}"))
    want = {k: 440 for k in [450, *range(500, 1200)]} | {k: 1 for k in [9000, *range(2, 400)]} | {k: 20_000 for k in range(20_001, 20_051)}
    assert {r["node"]["rep"]: r["component"]["rep"] for r in got.collect()} == want
