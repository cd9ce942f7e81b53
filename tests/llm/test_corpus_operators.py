"""Collocations, importance resampling and vector search against brute-force versions, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.llm import collocations, importance, vector_search

ENDS, BLANK = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[\x20\x09]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- 11: collocations


def plain_collocations(rows, least, top, percent=80, longest=4):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in ENDS.split((text or "").translate(LOWER)):
            words = [w for w in BLANK.split(piece) if w]
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, own in f.items():
        able = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in able.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        found = []
        for p, a in able.items():
            if inside[p] and 100 * inside[p] >= percent * a:
                continue
            score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def collocated(frame, **options):
    return sorted(map(tuple, collocations.collocations(frame, **options).collect()))


def phrases(seed, docs=60):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(25)] + ["New", "york", "CITY", "naïve", "日本"]
    some = lambda: r.choice(words[: r.randint(2, 30)])
    out = []
    for k in range(docs):
        text = "".join(some() + r.choice([" ", " ", " ", "\t ", ". ", ",", "\r\n", "  "]) for _ in range(r.randint(0, 120)))
        out.append((k, r.choice(["en", "en", "de", None, "und"]), text + " new york city hall" * r.randint(0, 2)))
    return out


ODD_LINES = [(None, None, None), (1, "en", ""), (1, "en", ""), (2, "en", " . ,\n"), (3, None, "a b"), (4, "", "x y. x y! x y"), (5, "de", "a a a a a a a a a"), (6, "de", "a b a b a b a a b b"), (7, "fr", "\x1c\x85 \x00 \x1c\x85 \x00"), (8, "en", "ab cd " * 20_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations(spark, seed):
    rows = phrases(seed) + ODD_LINES
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5).withColumn("phrase", F.lit("clash")).withColumn("n", F.lit(1))
    for least, top in ((2, 50), (5, 3)):
        want = plain_collocations([r[1:] for r in rows], least, top)
        assert collocated(frame, least=least, top=top) == want and want
    assert collocated(frame.limit(0)) == []


def test_collocations_of_split_pivots_and_small_tasks(spark, monkeypatch):
    rows = phrases(3) + ODD_LINES[:-1]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    want = plain_collocations([r[1:] for r in rows], 2, 1000)
    # every pivot of more than five occurrences is split; tasks pass on every few fragments, and mine every few
    for name, value in (("MOST", 5), ("HELD", 7), ("TOGETHER", 3), ("SHARES", 3)):
        monkeypatch.setattr(collocations, name, value)
    texts = collocations._texts(frame, "lang", "text")
    words = collocations.word_counts(texts)
    found = collocations.fragments(texts, collocations.rarity(words, 2))
    assert found.agg(F.max("parts")).first()[0] > 5
    assert collocated(frame, least=2, top=1000) == want
    # one cell for all words: the order of rarity tells nothing, and results are the same
    monkeypatch.setattr(collocations, "CELLS", 1)
    assert collocated(frame, least=2, top=1000) == want


def test_each_ngram_has_one_fragment():
    # of equal words the left one owns what holds both
    order = np.array([3, 1, 2, 1, 0, 2, 2], dtype=np.uint64)
    at, begin, end = collocations.spans(order, 4)
    assert list(zip(at.tolist(), begin.tolist(), end.tolist(), strict=True)) == [(1, 0, 4), (3, 2, 4), (5, 5, 7)]
    assert collocations.spans(np.zeros(3, dtype=np.uint64), 4)[0].size == 0


def test_collocation_scores_beyond_64_bits(spark):
    a = 10**15
    grams = spark.createDataFrame([("en", "a b", 2, a), ("en", "a b c", 3, a // 2)], "lang string, phrase string, m long, f long")
    words = spark.createDataFrame([("en", "a", a), ("en", "b", a + 1), ("en", "c", a)], "lang string, word string, n long")
    grams = grams.unionByName(spark.createDataFrame([("en", "b c", 2, a // 2 + 1)], grams.schema))
    got = {r.phrase: r.score for r in collocations.scored(grams, words).collect()}
    # the longer phrase has half of `a b` and nearly all of `b c`
    assert got == {"a b": 2_000_000 * a // (2 * a + 1), "a b c": 2_000_000 * (a // 2) // (2 * a)}
    with pytest.raises(ValueError, match="longest"):
        collocations.collocations(grams, longest=1)


# ---- 12: importance resampling


def plain_resample(docs, target, percent=25, least=20):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        w = word.findall((text or "").translate(LOWER).encode())
        return len(w), [zlib.crc32(x) % 10000 for x in w + [a + b" " + b for a, b in zip(w, w[1:])]]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    rows = []
    for i, text in docs:
        n, f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], -r[2]))
    rank = defaultdict(list)
    for k, r in enumerate(able, 1):
        rank[r].append(k if k <= percent * len(able) // 100 else None)
    return Counter((r[0], r[2], r[3], r[4], rank[r].pop(0) if r[1] >= least else None) for r in rows)


def resampled(docs, target, **options):
    return Counter(map(tuple, importance.resample(docs, target, **options).select("doc_id", "n_features", "weight", "score", "rank").collect()))


def test_resampling(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(40)] + ["Ünï", "日本", "a1"]
    text = lambda: " ".join(r.choice(words) + r.choice(["", ".", "-x"]) for _ in range(r.randint(0, 60)))
    docs = [(k, text()) for k in range(120)] + [(None, "w1 " * 30), (None, "w1 " * 30), (500, "w2 " * 25), (500, "w2 " * 25), (500, "w3 " * 25), (501, None), (502, ""), (503, "word " * 70_000)]
    docs += [(600, "w4 w5 " * 12)] * 40
    target = [text() for _ in range(5)] + [None, ""]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("rank", F.lit("clash")).withColumn("bucket", F.lit(0))
    wanted = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    assert resampled(frame, wanted) == plain_resample(docs, target)
    assert resampled(frame, wanted, percent=90) == plain_resample(docs, target, percent=90)
    assert resampled(frame, wanted.limit(0)) == plain_resample(docs, [])
    assert resampled(frame.limit(0), wanted) == Counter()


def test_ring_of_states(monkeypatch):
    words = [b"a", b"bc", "é".encode(), b"a", b"d"]
    got = Counter(np.concatenate(list(importance.feature_buckets(words, 3, 10**9))).tolist())
    assert got == Counter(zlib.crc32(b" ".join(words[i : i + m])) % 10**9 for m in (1, 2, 3) for i in range(len(words) - m + 1))
    monkeypatch.setattr(importance, "_SLICE", 2)
    assert Counter(np.concatenate(list(importance.feature_buckets(words, 3, 10**9))).tolist()) == got
    assert importance.words_of(b"A-b_C9 \xc3\xa9!") == [b"a", b"b", b"c9", b"\xc3\xa9"]


# ---- 13: vector search


def plain_search(rows, every, k):
    able = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    least = {}
    for i, v in able:
        if i % every == 0:
            least[i] = min(least.get(i, v), v)
    out = []
    for q, v in least.items():
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in able if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def searched(frame, **options):
    return sorted(map(tuple, vector_search.search(frame, **options).collect()))


def test_search_is_exact(spark, monkeypatch):
    r = random.Random(5)
    vector = lambda: [r.gauss(0, 1) / 4 for _ in range(8)]
    rows = [(k, vector()) for k in range(400)]
    # equal vectors of many ids, so ties decide; repeated rows; vectors that take no part; short, empty and long ones
    rows += [(400 + k, [0.5] * 8) for k in range(150)] + [(7, [0.25] * 8)] * 3 + [(20, [9.0] * 8), (-40, vector()), (-41, vector())]
    rows += [(1000, None), (1020, [1.0, None]), (1001, [float("nan")] * 8), (1040, [float("inf")] * 8), (None, vector()), (1060, []), (1061, []), (1080, [1.0]), (1081, [0.1] * 12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4).withColumn("score", F.lit("clash")).withColumn("block", F.lit(1))
    for page, part in ((3, 5), (1024, 4096)):
        monkeypatch.setattr(vector_search, "PAGE", page)
        monkeypatch.setattr(vector_search, "PART", part)
        assert searched(frame, every=20, k=5, block=16, waves=(1, 3)) == plain_search(rows, 20, 5)
    assert searched(frame, every=20, k=2000, waves=(2,)) == plain_search(rows, 20, 2000)
    assert searched(frame.limit(0)) == []
    assert searched(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")) == []


def test_search_beyond_64_bits(spark):
    rows = [(0, [1e17, 1.0]), (1, [1e17, 0.0]), (2, [-1e17, 0.0]), (3, [2.0, 3.5]), (4, [3.0**30, 1.0]), (20, [-(3.0**30), 5.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = searched(frame)
    cut = [(i, [max(-(2**63), min(2**63 - 1, math.floor(64 * x))) / 64 for x in v]) for i, v in rows]
    assert [x[:3] for x in got] == [x[:3] for x in plain_search(cut, 20, 20)]


def test_blocks_prune(spark):
    r = np.random.default_rng(6)
    centres = r.normal(size=(12, 16))
    rows = [(k, (centres[k % 12] + r.normal(size=16) / 20).tolist()) for k in range(1200)]
    vectors = vector_search.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    index = vector_search.blocks(vectors, 32)
    assert index.agg(F.sum("n")).first()[0] == 1200
    found = index.select("block", "n", "least_id", "low_high_kind", "low_high").withColumn("page", F.lit(0).cast("long"))
    best = {q: s for q, k, _, s in plain_search(rows, 20, 20) if k == 20}
    kth = spark.createDataFrame([(q, s, 10**9) for q, s in best.items()], "query_id long, kth_score long, kth_id long")
    state = vectors.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id").join(kth, "query_id").withColumn("visited", F.array().cast("array<bigint>"))
    assert vector_search.routed(state, found, 1, None).count() < 0.5 * 60 * index.count()
