"""Near-duplicate operators against brute force, with edge rows."""

import random
import re

import numpy as np

from brindle.llm import cap_filters, lsh_forest
from brindle.llm.common import block_pairs, components, gapless
from brindle.llm.hashing import by_text, span_hashes
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, extra string, rep int"


def classes(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return ({tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) if w else set()


def brute_jaccard(rows):
    sets = [shingle_set(t) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    links = np.bincount(np.array(pairs, dtype=int).ravel(), minlength=len(rows))
    ids = [r[0] for r in rows]
    group = classes(len(rows), pairs)
    return {i: (int(links[k]), min(ids[j] for j in range(len(rows)) if group[j] == group[k])) for k, i in enumerate(ids)}


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(60):
        words = rng.choices(vocab, k=rng.randint(3, 150))
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3])):
            near = list(words)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = "x"
            texts.append(" ".join(near))
    texts += ["", "   ", "one", "one", "one  two", "one two", "é é é é é é", "a " * 30_000, "a " * 30_000]
    return [(k * 3 + 1, t) for k, t in enumerate(texts)]


def test_jaccard_matches_brute_force(spark):
    rows = corpus()
    got = lsh_forest.jaccard_classes(spark.createDataFrame([(i, t, "e", 1) for i, t in rows], DOCS)).collect()
    assert {r["doc_id"]: (r["n_links"], r["class_id"]) for r in got} == brute_jaccard(rows)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_jaccard_blocks_agree_with_whole_groups(spark):
    rows = corpus(5)
    docs = spark.createDataFrame([(i, t, "e", 1) for i, t in rows], DOCS)
    got = lsh_forest.jaccard_classes(docs, block_docs=2).collect()
    assert {r["doc_id"]: (r["n_links"], r["class_id"]) for r in got} == brute_jaccard(rows)


def test_jaccard_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "a b c d e f", None, None), (4, None, None, None), (5, "a b c d e f", None, None), (5, "a b c d e f", None, None)]
    got = sorted(((r["doc_id"], r["n_links"], r["class_id"], r["kept"]) for r in lsh_forest.jaccard_classes(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (4, 0, 4, True), (5, 1, 5, True), (5, 1, 5, True)], key=str)
    kept = lsh_forest.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["4", "5", "None"]
    assert lsh_forest.jaccard_classes(spark.createDataFrame([], DOCS)).count() == 0


def test_long_words_are_hashed_whole(spark):
    word = "x" * 5_000_000
    other = word[:2_500_000] + "y" + word[2_500_001:]
    inner = [f"a {'z' * 1_500_000}{c}{'z' * 1_500_000} b {'q' * 3_000_000}" for c in "12"]
    a, b, c, d = by_text([word, other, *inner])
    assert a[0] != b[0] and c[1] != d[1] and list(c[[0, 2, 3]]) == list(d[[0, 2, 3]])
    for text, hashes in ((word, a), (inner[0], c)):
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        at = [m.span() for m in re.finditer(r"\S+", text)]
        assert list(span_hashes(raw, np.array([x for x, _ in at]), np.array([y for _, y in at]))) == list(hashes)
    heads = [h[1:] for h in by_text([word, "x" * 9, "xxxx"], prefixes=(4, 9))]
    assert heads[0][0] == heads[1][0] != heads[2][0] and heads[0][1] != heads[1][1]
    got = lsh_forest.jaccard_classes(spark.createDataFrame([(1, word, None, None), (2, other, None, None), (3, word, None, None)], DOCS)).collect()
    assert {r["doc_id"]: (r["n_links"], r["class_id"]) for r in got} == {1: (1, 1), 2: (0, 2), 3: (1, 1)}


def test_jaccard_counts_different_texts_of_one_id(spark):
    rng = random.Random(8)
    t, u = (" ".join(f"{c}{rng.randrange(500)}" for _ in range(80)) for c in "tu")
    rows = [(1, t), (2, t + " q"), (2, u), (3, u + " r"), (5, u + " r s"), (2, u)]
    docs = spark.createDataFrame([(i, x, "e", k) for k, (i, x) in enumerate(rows)], DOCS)
    got = sorted((r["doc_id"], r["n_links"], r["class_id"]) for r in lsh_forest.jaccard_classes(docs).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (2, 3, 2), (2, 3, 2), (3, 3, 2), (5, 3, 2)]
    kept = lsh_forest.drop_near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, t), (2, u)]
    apart = spark.createDataFrame([(1, t, "e", 1), (1, u, "e", 1), (1, t + " q", "e", 1)], DOCS)
    assert sorted(r["text"] for r in lsh_forest.drop_near_duplicates(apart).collect()) in ([t, u], sorted([t + " q", u]))


def test_a_group_of_near_copies_over_many_ranges_and_blocks(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(60)]
    texts = []
    for k in range(150):
        near = list(base)
        near[rng.randrange(60)] = f"x{k % 40}"
        texts.append(" ".join(near) + f" y{k % 3}" * (k % 2))
    texts += [" ".join(f"w{rng.randrange(5000)}" for _ in range(50)) for _ in range(50)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "e", 1) for i, t in rows], DOCS)
    got = lsh_forest.jaccard_classes(docs, range_rows=300, run_docs=24, block_docs=16).collect()
    assert {r["doc_id"]: (r["n_links"], r["class_id"]) for r in got} == brute_jaccard(rows)


def test_prefixes_shorten_until_the_target():
    least = lsh_forest.least_depth(24, 8, 0.8, 0.999)
    assert lsh_forest.recall_at(least, 24, 0.8) >= 0.999 > lsh_forest.recall_at(least + 1, 24, 0.8)
    # nothing met: the threshold decides; near copies met: no shortening; pairs at the threshold: shortening
    assert lsh_forest.measured_recall({}, 8, 24, 0.8) < 0.999 <= lsh_forest.measured_recall({}, least, 24, 0.8)
    assert lsh_forest.measured_recall({0.95: 1000}, 8, 24, 0.8) >= 0.999 > lsh_forest.measured_recall({0.95: 1000, 0.8: 1000}, 8, 24, 0.8)


def vectors(n=500, dim=32, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for k in range(0, n, 4):  # cosines around the threshold
        x[k + 1] = x[k] / np.linalg.norm(x[k]) + rng.standard_normal(dim) * rng.uniform(0.02, 0.13)
    x[3] = x[7] = x[11]
    return x


def test_embeddings_match_brute_force(spark):
    x = vectors()
    df = spark.createDataFrame([(k + 10, [float(v) for v in row], 1) for k, row in enumerate(x)], "vec_id long, embedding array<double>, x int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    group = classes(len(x), zip(*np.nonzero(near), strict=True))
    for block, class_block in ((1024, 128), (8, 4)):
        got = cap_filters.near_duplicates(df, block=block, class_block=class_block).orderBy("vec_id").collect()
        assert [r["n_links"] for r in got] == near.sum(axis=1).tolist()
        assert [r["component_id"] for r in got] == [10 + g for g in group]
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_embeddings_of_one_id(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [0.0, 1.0]), (3, [0.01, 1.0]), (4, [-1.0, 0.0]), (4, [-1.0, 0.0])]
    got = sorted(tuple(r) for r in cap_filters.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (2, 1, 2, True), (3, 1, 2, False), (4, 1, 4, True), (4, 1, 4, True)]


def test_sketches_stay_above_their_floor():
    rng = np.random.default_rng(3)
    for dim in (2, 7, 32, 33, 64, 65, 384):
        for sparse in (False, True):
            x = rng.standard_normal((4000, dim)) * ((rng.random((4000, dim)) < 2 / dim) if sparse else 1)
            x[np.abs(x).sum(axis=1) == 0, 0] = 1
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            other = rng.standard_normal(x.shape)
            other -= (other * x).sum(axis=1, keepdims=True) * x
            other /= np.linalg.norm(other, axis=1, keepdims=True)
            y = 0.9 * x + np.sqrt(1 - 0.81) * other
            a, b = (cap_filters.read_sketches(cap_filters.sketches(v), dim) for v in (x, y))
            guessed = (a * b).sum(axis=1)
            assert guessed.min() > cap_filters.sketch_floor(dim, 0.9), (dim, sparse, guessed.min())


def test_decoding_finds_all_filters():
    rng = np.random.default_rng(4)
    for blocks in (1, 2, 3):
        plan = {"dim": 12, "codes": 2, "blocks": blocks, "words": 5, "height": 0.3}
        codes = cap_filters._codes(plan)
        x = rng.standard_normal((40, 12))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        got = set(zip(*map(np.ndarray.tolist, cap_filters._passed(x, plan, codes)), strict=True))
        want = set()
        for c, (rotation, words) in enumerate(codes):
            for f in range(5**blocks):
                digits = [f // 5 ** (blocks - 1 - b) % 5 for b in range(blocks)]
                cosine = sum(x @ rotation.T[:, part] @ w[d] for (part, w), d in zip(words, digits, strict=True))
                want |= {(v, f + c * 5**blocks) for v in np.flatnonzero(cosine >= 0.3).tolist()}
        assert got == want


def test_embeddings_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (None, [1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [-1.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cap_filters.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9, None, 11, 12))
    assert cap_filters.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components_and_helpers(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 1 for k in range(2, 41)}, 150: 100, 200: 100}
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    numbered = gapless(df, ["k"], ["id"], "n", rows_per_bucket=10).collect()
    for k in range(3):
        assert sorted(r["n"] for r in numbered if r["k"] == k) == list(range(sum(r["k"] == k for r in numbered)))
    met = block_pairs(df, ["k"], "id", F.lit(4)).collect()
    pairs = {(r["k"], r["_lo"], r["_hi"], r["id"]) for r in met}
    ids = [r["id"] for r in df.filter("k = 0").collect()]
    blocks = {r["id"]: r["_block"] for r in met}
    for a in ids:
        for b in ids:
            lo, hi = sorted((blocks[a], blocks[b]))
            assert (0, lo, hi, a) in pairs and (0, lo, hi, b) in pairs
