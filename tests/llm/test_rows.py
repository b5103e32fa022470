"""Operators on single documents, chats, pages and mixes."""

import hashlib
import io
import re
import struct
import zipfile
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import chat_format, divergence, hash_tree, mixing, pattern_pack, wacz
from brindle.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- chats


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "<turn user>\n", "a\\lb\\\\s\\", "<part/>", "", None, "é</turn>\n<turn x>"]
    rows = [(1, k, ["user", "assistant", "assistant", "a>b", None][k % 5], t) for k, t in enumerate(nasty)]
    rows += [(None, 0, "user", "x"), (2, None, "assistant", "y"), (2, None, "assistant", "y"), (3, 1, "user", "q" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    out = chat_format.format_chats(df)
    got = {r["conv_id"]: r for r in out.select("*", chat_format.read_turns(F.col("formatted")).alias("read"), chat_format.read_loss(F.col("pieces"), F.col("loss_mask")).alias("loss")).collect()}
    want = [((["user", "assistant", "assistant", "a>b", None][k % 5]) or "", t or "") for k, t in enumerate(nasty)]
    assert [tuple(x) for x in got[1]["read"]] == want
    assert got[1]["loss"] == "".join(t for r, t in want if r == "assistant")
    assert got[1]["n_blocks"] == sum(1 for k, (r, _) in enumerate(want) if k == 0 or want[k - 1][0] != r)
    assert [tuple(x) for x in got[2]["read"]] == [("assistant", "y")] * 2 and got[2]["n_blocks"] == 1
    assert got[None]["loss"] == "" and len(got[3]["read"][0]["text"]) == 100_000
    assert all("".join(r["pieces"]) == r["formatted"] for r in got.values())
    assert chat_format.format_chats(df.limit(0)).count() == 0


# ---- quality rules


def expected(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts(spark):
    texts = [None, "", " \t\n", "a b c d e", "a b c d e a b c d e f g h i j", "x " * 40, "é ü\n\né ü\né ü", "a|b #c\r\na|b #c", "one two three four five six seven eight nine ten " * 3, "w " * 5 + "v " * 30]
    texts += [" ".join(f"w{k % 37}" for k in range(n)) for n in (9, 10, 41, 42, 43, 5000)]
    rows = [(k, t, ["en", None, "xx"][k % 3], 5) for k, t in enumerate(texts)]
    got = divergence.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, classes int")).collect()
    assert {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got} == {k: expected(t) for k, t in enumerate(texts)}
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert divergence.quality_verdicts(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_jensen_shannon(spark):
    rows = [([1, 1], [1, 1]), ([1, 0], [0, 1]), ([3, 1], [1, 3]), ([0, 0], [1, 1])]
    got = [r[0] for r in spark.createDataFrame(rows, "p array<long>, q array<long>").select(divergence.jensen_shannon(F.col("p"), F.col("q"))).collect()]

    def js(p, q):
        p, q = np.array(p) / sum(p), np.array(q) / sum(q)
        kl = lambda a, b: sum(x * np.log2(x / y) for x, y in zip(a, b, strict=True) if x)
        return np.sqrt((kl(p, (p + q) / 2) + kl(q, (p + q) / 2)) / 2)

    assert got[:3] == pytest.approx([js(*r) for r in rows[:3]], abs=1e-9) and got[3] is None


def test_verdicts_match_a_plain_computation(spark):
    """Both distances and the verdict, word by word and character by character."""
    rng = np.random.default_rng(8)
    vocabulary = {"en": divergence.COMMON_WORDS["en"] + ["Stone", "river,", "42", "walk!"], "de": divergence.COMMON_WORDS["de"] + ["Häuser", "fließt.", "#x"], "xx": ["ab", "cd"], None: ["ab", "Cd"]}
    rows = []
    for k in range(120):
        lang = list(vocabulary)[k % 4]
        words = rng.choice(vocabulary[lang] if k % 11 else ["ZZZ", "qqq", "漢字", "%%"], rng.integers(5, 160))
        rows.append((k % 100, [" ", "\n"][k % 2].join(words), lang, "x"))
    rows.append((None, None, "en", "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    got = Counter((r["doc_id"], r["n_words"], r["class_distance"] and round(r["class_distance"], 6), r["common_distance"] and round(r["common_distance"], 6), r["kept"]) for r in divergence.quality_verdicts(docs).collect())

    def classes(text):
        sets = [divergence.SMALL, divergence.CAPITAL, divergence.DIGITS, " \t\n\x0b\x0c\r", divergence.MARKS, divergence.SYMBOLS]
        counts = [sum(c in s for c in text) for s in sets]
        return np.array(counts + [len(text) - sum(counts)], dtype=float)

    def common(text, lang):
        words = WORD.findall(text)
        return np.array([words.count(w) for w in divergence.COMMON_WORDS.get(lang, [])], dtype=float)

    def distance(p, q):
        if not p.sum() or not q.sum():
            return None
        p, q = p / p.sum(), q / q.sum()
        kl = lambda a, b: sum(x * np.log2(x / y) for x, y in zip(a, b, strict=True) if x)
        return float(np.sqrt(max(0.0, (kl(p, (p + q) / 2) + kl(q, (p + q) / 2)) / 2)))

    texts = [(i, t or "", lang) for i, t, lang, _ in rows]
    want = Counter()
    for i, t, lang in texts:
        same = [x for _, x, y in texts if y == lang]
        n, *_, failed = expected(t)
        c = distance(classes(t), sum(map(classes, same))) if len(t) >= 200 else None
        m = None
        if n >= 60 and lang in divergence.COMMON_WORDS:
            total = sum(common(x, lang) for x in same)
            m = distance(common(t, lang), total) if common(t, lang).sum() else 1.0 if total.sum() else None
        kept = not failed and not (c or 0) > 0.30 and not (m or 0) > 0.70
        want[i, n, c and round(c, 6), m and round(m, 6), kept] += 1
    assert got == want and len({k[-1] for k in want}) == 2


def test_sql_of_the_quality_rules(spark):
    import duckdb
    from brindle.llm.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("no tables here")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    relation = connection.sql(ORACLE_SQL["op4_quality_rules"])
    near = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(tuple(near(v) for v in row) for row in relation.fetchall())
    got = QUERIES["op4_quality_rules"](spark, sf)
    assert got.columns == relation.columns and sorted(tuple(near(v) for v in row) for row in got.collect()) == want


def test_gibberish_is_rejected_by_its_common_words_alone(spark):
    rng = np.random.default_rng(5)
    common, nouns = divergence.COMMON_WORDS["en"], [f"{a}{b}{c}" for a in ("tra", "mo", "shel") for b in ("ven", "lid", "par") for c in ("ing", "er", "ton")]
    prose = [" ".join(rng.choice(common if rng.random() < 0.25 else nouns) for _ in range(150)) for _ in range(60)]
    gibberish = [" ".join("".join(rng.permutation(list(w))) for w in rng.choice(nouns, 150)) for _ in range(5)]
    rows = [(k, t, "en") for k, t in enumerate(prose + gibberish)] + [(-1, gibberish[0], "xx")]
    got = {r["doc_id"]: r for r in divergence.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k]["kept"] and got[k]["common_distance"] < 0.7 for k in range(60))
    for k in range(60, 65):
        assert not got[k]["base_failed"] and got[k]["class_distance"] < 0.3 and got[k]["common_distance"] == 1 and not got[k]["kept"]
    assert got[-1]["common_distance"] is None


# ---- mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not full:
            return target | share
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_mixing_targets_and_takes(spark):
    rows, k = [], 0
    for source, n, words in (("b", 300, 40), ("a", 5, 100), (None, 50, 30), ("é", 80, 20), ("Z", 1, 5000), ("none", 3, 0)):
        for _ in range(n):
            rows.append((k, ("w " * words) if words else None, source, 1))
            k += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    sizes = Counter()
    for i, t, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = brute_targets(dict(sizes))
    taken = Counter()
    source = {r[0]: r[2] for r in rows}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], rel=1e-9, abs=1e-6) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 16 + 0.01 * want[s] for s in sizes)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert mixing.mix(df.limit(0)).count() == 0
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and abs(sum(len(WORD.findall(r["text"] or "")) for r in mixed.collect()) - 1.5 * sum(sizes.values())) < 0.05 * sum(sizes.values())


def test_mixing_in_many_shards_and_groups(spark):
    rows = [(k, "w " * (1 + k % 7), ["a", "b"][k % 3 > 0], k % 2) for k in range(3000)] + [(None, f"n{k} x", "a", 0) for k in range(300)] + [(7777, "same words here", "b", 0)] * 900
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    options = {"shard_rows": 50, "shard_group": 4, "alike": 100}
    got = mixing.mix(df, **options).collect()
    assert len(got) == len(rows)
    for source, want in {(r["source_size"], r["target"]) for r in got}:
        taken = sum(r["taken"] for r in got if r["source_size"] == source)
        assert abs(taken - want) <= 0.02 * want, (taken, want)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5), **options).collect()))
    mixed = mixing.mixed_documents(df, **options)
    assert mixed.columns == df.columns
    out = Counter(map(tuple, mixed.collect()))
    assert abs(sum(len(WORD.findall(r[1])) * n for r, n in out.items()) - 1.5 * sum(len(WORD.findall(r[1])) for r in rows)) < 0.03 * sum(len(WORD.findall(r[1])) for r in rows)
    times = Counter(rows)
    assert all(n <= 2 * times[r] for r, n in out.items()) and out == Counter(map(tuple, mixing.mixed_documents(df.repartition(3), **options).collect()))


def test_mixed_rows_of_one_id_keep_their_texts(spark):
    rows = [(1, "a b c", "x", {"k": 1}), (1, "d e f", "x", {"k": 2}), (1, "d e f", "y", {"k": 3}), (None, "g h i", None, None), (2, None, "x", None), (3, "", "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size map<string,int>")
    out = mixing.mixed_documents(df, weights=(1,), share=2.0, block_words=1).collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in out) == Counter({(1, "a b c", "x"): 2, (1, "d e f", "x"): 2, (1, "d e f", "y"): 2, (None, "g h i", None): 2})
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_sainte_lague(spark):
    votes = {1: 53_000.0, 2: 24_000.0, 3: 23_000.0, 4: 10.0, 5: 0.0}
    for seats in (0, 1, 7, 100, 101):
        df = spark.createDataFrame([(k, v, seats) for k, v in votes.items()], "p long, v double, seats long")
        got = {r["p"]: r["won"] for r in mixing.apportion(df, [], ["p"], "v", "seats", "won").collect()}
        want = Counter()
        for _ in range(seats):
            want[max(votes, key=lambda p: (votes[p] / (2 * want[p] + 1), -p))] += 1
        assert got == {p: want[p] for p in votes}


# ---- sharding


def test_sharding(spark):
    rows = [(k, "é" * (k % 50), 1) for k in range(3000)] + [(None, None, 1), (None, None, 1), (7, "x", 1)]
    got = hash_tree.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard int")).collect()
    assert len(got) == len(rows)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(40)) and max(sizes.values()) < 2 * min(sizes.values())
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    assert all(r["grown_shard"] in (r["shard"], 40) for r in got) and 20 < sum(r["grown_shard"] == 40 for r in got) < 150
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows}
    assert hash_tree.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def shards_of(keys, *args, **options):
    return {r["id"]: r["p"]["shard"] for r in hash_tree.place(keys, "id", *args, out="p", **options).collect()}


def test_tree_confines_movement(spark):
    keys = spark.range(6000)
    tree = hash_tree.even_tree(20)
    before = shards_of(keys, tree)
    heavier = [(0, 0, 4, 2.0)]  # growth inside a rack
    after = shards_of(keys, tree, heavier)
    moved = {k for k in before if before[k] != after[k]}
    assert moved and all(after[k] == 4 for k in moved)
    assert 2.4 < Counter(after.values())[4] / Counter(before.values())[4] < 3.6
    grown, events = after, list(heavier)
    for event in [(1, 2, 13, 1.0), (2, 4, 20, 1.0), (0, 1, 21, 1.0), (0, 0, 4, 0.5)]:  # in turn: a rack's shard, a new region, a new shard in an old rack, again the first
        events.append(event)
        now = shards_of(keys, tree, events)
        assert all(now[k] in (grown[k], event[2]) for k in now) and any(now[k] != grown[k] for k in now)
        grown = now
    sizes = Counter(grown.values())
    weights = {s: 1.0 for s in range(22)} | {4: 3.5, 13: 2.0}
    for s, w in weights.items():
        assert 0.75 < sizes[s] / (6000 * w / sum(weights.values())) < 1.25, (s, sizes[s])
    gone = shards_of(keys, tree, events, removed=frozenset({4, 13}))
    rack = {s: r for _, racks in tree for r, leaves in racks for s, _ in leaves}
    assert all(gone[k] == grown[k] for k in grown if grown[k] not in (4, 13)) and not {4, 13} & set(gone.values())
    assert any(rack[gone[k]] == rack[4] for k in grown if grown[k] == 4)
    whole = shards_of(keys, tree, removed=frozenset(range(5)))  # a whole rack
    assert all(whole[k] == before[k] for k in before if before[k] > 4) and {whole[k] for k in before if before[k] < 5} == set(range(5, 10))


def test_descents_of_large_trees(spark):
    tree = hash_tree.even_tree(10_000)
    assert sum(len(leaves) for _, racks in tree for _, leaves in racks) == 10_000
    assert max(len(tree) + len(racks) + len(leaves) for _, racks in tree for _, leaves in racks) < 80
    found = shards_of(spark.range(20_000), tree)
    assert len(set(found.values())) > 8000 and max(Counter(found.values()).values()) < 14


def test_one_more_shard_takes_rows_only_into_itself(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    last = None
    for n in (40, 41, 42, 47):
        got = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in hash_tree.shard_documents(docs, n, base=40).collect()}
        assert {s for s, _ in got.values()} == set(range(n)) and all(g in (s, n) for s, g in got.values()) and any(g == n for _, g in got.values())
        if n in (41, 42):
            assert {k: s for k, (s, _) in got.items()} == {k: g for k, (_, g) in last.items()}
        last = got


# ---- archives


def test_archives_round_trip(spark, tmp_path):
    big = "x" * 1000
    html = {1: big, 2: big, 3: "small", 4: "small", 5: None, 6: "", 7: "é" * 600, 8: "é" * 600 + " ", 9: big, 10: "\r\n\r\nWARC/1.1\r\n" * 200}
    rows = [(k, f"http://e/{k}\r\nX: y" if k % 2 else None, h, 1) for k, h in html.items()] + [(None, "u", big, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload int").repartition(3)
    manifest = wacz.write_archives(df, f"file://{tmp_path}/w", most_records=2)
    assert manifest.count() >= 6 and all(r["records"] <= 2 for r in manifest.collect())
    got = wacz.read_archives(manifest, with_payload=True, chunk_bytes=300).collect()
    assert len(got) == len(rows)
    for r in got:
        data = (big if r["page_id"] is None else html[r["page_id"]] or "").encode()
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha1(data).hexdigest()
        assert (r["url"] is None) == (r["page_id"] is not None and r["page_id"] % 2 == 0)
        revisit = r["page_id"] in (1, 2, None)
        assert r["record_type"] == ("revisit" if revisit else "response") and r["refers_to"] == (9 if revisit else None)
        assert (r["payload"] is None) if revisit else (bytes(r["payload"]) == data)
    for path in manifest.collect():
        with zipfile.ZipFile(path["path"].removeprefix("file:")) as z:
            assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
    empty = wacz.write_archives(df.limit(0), f"file://{tmp_path}/none")
    assert empty.count() == 0 and wacz.read_archives(empty).count() == 0


def test_zip64_directory():
    data, name = b"payload", b"archive/a"
    local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(data), len(data))
    pad = b"j" * 37
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), len(pad))
    central = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(pad) + len(local) + len(data)
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, at + len(central), 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 3) + b"end"
    raw = pad + local + data + central + end64 + locator + end
    member = wacz.read_directory(io.BytesIO(raw), len(raw))["archive/a"]
    assert member["stored"] and raw[member["offset"] : member["offset"] + member["size"]] == data
    with pytest.raises(ValueError):
        wacz.read_directory(io.BytesIO(b"nothing"), 7)


# ---- packing


def test_units_agree_with_the_tokenizer():
    import random

    from tokenizers import Tokenizer

    rng = random.Random(2)
    letters = list("abzABZ019 .,'!#<|>\t\n\r_-éÉßñÑ×÷ÀÿŒ“–…İıΣσς漢字ªµº½² \x85\xa0̧e'sT're😀\x1c\x00") + ["'s", "'LL", "<|endoftext|>", "don't", "ＡＢ"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["", "x" * 5000]
    plain, units = Tokenizer.from_file(tokenizer_path()), pattern_pack._Units(tokenizer_path())
    for text, ids in zip(texts, units.encode(texts), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    said = json.loads(open(tokenizer_path(), encoding="utf-8").read())
    assert isinstance(pattern_pack._encoder(tokenizer_path()), pattern_pack._Units)
    said["normalizer"]["normalizers"].pop()  # keeps capitals
    other = tmp_path / "other.json"
    other.write_text(json.dumps(said), encoding="utf-8")
    encoder, plain = pattern_pack._encoder(str(other)), Tokenizer.from_file(str(other))
    assert isinstance(encoder, pattern_pack._Whole)
    assert [x.tolist() for x in encoder.encode(["Hello World's 12", ""])] == [plain.encode(t, add_special_tokens=False).ids for t in ("Hello World's 12", "")]


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, rng.integers(0, 4000)) if seed % 2 else np.minimum(64, rng.geometric(0.05, 3000))
    histogram = np.bincount(lengths, minlength=65)
    plan = pattern_pack.plan_packing(histogram, 64)
    used = Counter()
    for n, shape in plan:
        assert n > 0 and sum(length * each for length, each in shape) <= 64
        for length, each in shape:
            used[length] += n * each
    assert used == Counter(lengths.tolist())
    sequences, bound = sum(n for n, _ in plan), -(-int(lengths.sum()) // 64)
    assert sequences <= max(bound * 1.05 + 2, (lengths > 32).sum() * 1.05 + 2)


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = [None, "", "hello world", "a b c " * 3000, "tiny"] + [f"doc {k} " * (k % 90) for k in range(200)]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "x", 1), (2, "hello world", 1)], "doc_id long, text string, length int")
    got = pattern_pack.pack_documents(df, tokenizer_path(), capacity=256).collect()
    plain = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for k, t in [*enumerate(texts), (None, "x"), (2, "hello world")]:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for p, s in enumerate(range(0, len(ids), 256)):
            want[k, p, s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    rows = {}
    for r in got:
        rows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in rows.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(rows) <= -(-sum(r["length"] for r in got) // 256) + 3
    assert pattern_pack.pack_documents(df.limit(0), tokenizer_path()).count() == 0
