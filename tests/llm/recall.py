"""Measured recall of the two similarity joins; not a test, run by hand:
python tests/llm/recall.py [embeddings] [jaccard]

embeddings: the share of random pairs at a given cosine that pass a common
filter, with the plan of a table of n vectors. Only pairs are drawn, so n may
be of any size. jaccard: a corpus of 50,000 texts, whose links are counted
exactly over an inverted index of shingles and compared with the operator's.
"""

import os
import random
import sys
import tempfile
from collections import Counter, defaultdict
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[2])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT

import numpy as np  # noqa: E402
from brindle.llm import cap_filters, lsh_forest  # noqa: E402


def embeddings(dim: int = 64, pairs: int = 1000) -> None:
    rng = np.random.default_rng(1)
    for n in (5_000, 50_000, 1_000_000, 20_000_000, 200_000_000):
        plan = cap_filters.plan_filters(n, dim, 0.9)
        codes = cap_filters._codes(plan)
        found, passed = {}, 0
        for cosine in (0.9, 0.92, 0.95):
            x, other = rng.standard_normal((2, pairs, dim))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            other -= (other * x).sum(axis=1, keepdims=True) * x
            other /= np.linalg.norm(other, axis=1, keepdims=True)
            y = cosine * x + np.sqrt(1 - cosine * cosine) * other
            a, b = (cap_filters._passed(v, plan, codes) for v in (x, y))
            passed = len(a[0]) / pairs
            mine = set(zip(a[0].tolist(), a[1].tolist(), strict=True))
            found[cosine] = len({v for v, f in zip(b[0].tolist(), b[1].tolist(), strict=True) if (v, f) in mine}) / pairs
        print(f"{n} vectors of {dim}: {plan['codes']} codes of {plan['words']}^{plan['blocks']} filters, {passed:.1f} passed by a vector; recall by cosine {found}", flush=True)


def jaccard(n: int = 50_000) -> None:
    from pyspark.sql import SparkSession

    rng = random.Random(2)
    texts = []
    while len(texts) < n:
        words = [f"w{rng.randrange(30_000)}" for _ in range(rng.randint(20, 120))]
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 2])):
            near = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 40))):
                near[rng.randrange(len(near))] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(near))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for shingle in s:
            holders[shingle].append(k)
    shared = Counter((a, b) for held in holders.values() for i, a in enumerate(held) for b in held[i + 1 :])
    similar = {pair: m / (len(sets[pair[0]]) + len(sets[pair[1]]) - m) for pair, m in shared.items()}
    want = Counter(k for pair, s in similar.items() if s >= 0.8 for k in pair)
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    got = {r["doc_id"]: r["n_links"] for r in lsh_forest.jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    near = sum(0.8 <= s < 0.85 for s in similar.values())
    print(f"{len(texts)} texts: {sum(got.values())} link ends found of {sum(want.values())} ({near} links between 0.8 and 0.85); {sum(got[k] > want[k] for k in got)} texts have links too many")


if __name__ == "__main__":
    for name in sys.argv[1:] or ["embeddings", "jaccard"]:
        {"embeddings": embeddings, "jaccard": jaccard}[name]()
