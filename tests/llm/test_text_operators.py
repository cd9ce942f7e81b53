"""Text operators against brute-force versions, and on odd rows: nulls, empty and long texts, ties, extra columns."""

import hashlib
import json
import math
import os
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfare.llm import bpe, chat_format, common, exact_dedup, fingerprints, language_id, license_scan, mixing, near_dedup, token_counts, toxicity
from wayfare.llm.common import bounded_sample

DATA = "/root/testdata/sf0.001"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
SPACE = re.compile(r"[\x20\x09-\x0D]+")

ODD = [
    (1, "The MIT License, and the Apache License  version 2.0", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \t\n ", "de"),
    (5, "word " * 30_000, "en"),
    (6, "same text here now ok", "en"),
    (7, "same text here now ok", "en"),
    (8, "Same  text\nhere now OK", "en"),
    (9, "naïve 日本語 \U0001f600 \x85 a<|endoftext|>b", "fr"),
    (10, "x", None),
    (None, "no id at all", "en"),
    (None, None, None),
    (11, "repeated row", "en"),
    (11, "repeated row", "en"),
]


@pytest.fixture
def odd(spark):
    frame = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return frame.withColumn("node", F.lit("clash")).withColumn("p", F.lit(1)).withColumn("n_chars", F.lit(None).cast("long"))


@pytest.fixture
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def documents(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, documents):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def texts_of(frame):
    return {r.doc_id: r.text or "" for r in frame.select("doc_id", "text").collect()}


# ---- 1: license scans


def test_template_parts():
    t = license_scan.Template("x", 'One two<<beginOptional>> maybe<<endOptional>> three <<var;name="n";match=".{1,2}">> end')
    a = license_scan.Automaton(t)
    accepts = lambda s: a.accepts_at(license_scan.words_of(s.encode()), 0)
    assert accepts("one two three X end") and accepts("One, two; MAYBE three x y end.")
    assert not accepts("one two three end") and not accepts("one two three x y z end") and not accepts("one two or three x end")
    for bad in ("<<beginOptional>>a", "a<<endOptional>>", "", '<<var;name="n";match=".{1,2}">> a'):
        with pytest.raises(ValueError):
            license_scan.Automaton(license_scan.Template("x", bad))


def test_whole_license_bodies(spark):
    def filled(parts, rng, r):
        for part in parts:
            if part[0] == "word":
                yield part[1].decode()
            elif part[0] == "any":
                yield from (f"holder{k}" for k in range(rng(part[1], part[2])))
            elif r.random() < 0.5:
                yield from filled(part[1], rng, r)

    r = random.Random(31)
    rows, want = [], []
    for t in license_scan.BODY_TEMPLATES:
        parts = license_scan.parse(t.markup)
        assert license_scan.mandatory(parts) > 90
        for broken in (False, False, True):
            words = list(filled(parts, r.randint, r))
            if broken:
                # one word that every copy must have, near the end
                words[-3] += "x"
            rows.append((len(rows), f"Copyright 2020 X, {' '.join(words).upper()} and so on"))
            want.append(not broken)
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id: set(r.labels.split(",")) for r in got}
    assert [license_scan.BODY_TEMPLATES[k // 3].label in found[k] for k in range(len(rows))] == want
    assert all(r.score > 0.98 for r in got if want[r.doc_id])


def test_license_places(spark, odd, empty, documents):
    phrases = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for frame in (odd, documents):
        want = Counter()
        for r in frame.select("doc_id", "text").collect():
            words = [w.decode() for w in word.findall((r.text or "").encode().lower())]
            at, found = [], set()
            for label, phrase in phrases.items():
                p = phrase.split()
                hits = [k for k in range(len(words)) if words[k : k + len(p)] == p]
                at += hits
                found |= {label} if hits else set()
            want[r.doc_id, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(found))] += 1
        rows = license_scan.scan_licenses(frame).collect()
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == want
        assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)
    assert license_scan.scan_licenses(empty).count() == 0


# ---- 2: byte-pair encoding


def test_bpe_against_the_library(odd, empty, documents):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(BYTE_BPE)
    for frame in (odd, documents):
        got = Counter(tuple(r) for r in bpe.encode_decode(frame, BYTE_BPE).collect())
        want = Counter()
        for r in frame.select("doc_id", "text").collect():
            ids = reference.encode(r.text or "", add_special_tokens=False).ids
            text = reference.decode(ids, skip_special_tokens=False)
            want[r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
        assert got == want
    assert bpe.encode_decode(empty, BYTE_BPE).count() == 0
    assert {r.doc_id: len(r.ids) for r in bpe.encode_documents(odd, BYTE_BPE).collect()}[2] == 0


def test_cuts_are_certain():
    vocab = bpe.load(BYTE_BPE)
    rng = random.Random(3)
    for _ in range(200):
        piece = "".join(rng.choice("aeéèst 日xQz\t0") for _ in range(rng.randint(1, 90))).encode()
        parts = vocab.fragments(piece)
        assert b"".join(parts) == piece
        whole = vocab._merged(piece)
        assert [i for p in parts for i in vocab._merged(p)] == whole == [i for p in parts for i in vocab._merged_short(p)]
    assert len(vocab.fragments("日本".encode())) > 1


# ---- 3: mixing


def soft_rows(seed, n=300, k=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        p = [rng.random() ** (1 + 2 * a) + 1e-3 for a in range(k)]
        rows.append((i, rng.randint(0, 50), [x / sum(p) for x in p]))
    return rows


def plain_least_squares(rows, goal, least, rounds=40_000):
    """Nonnegative least squares by plain projected gradient with the safe step: how far from the goal the best rates stay."""
    n, p = np.array([float(r[1]) for r in rows]), np.array([r[2] for r in rows])
    step = 1 / np.linalg.eigvalsh((p * n[:, None]).T @ p)[-1]
    rate, velocity, t = np.ones(len(rows)), np.ones(len(rows)), 1.0
    for _ in range(rounds):
        new = np.maximum(least, velocity - step * p @ ((n * velocity) @ p - goal))
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        velocity, rate, t = new + (t - 1) / after * (new - rate), new, after
    return float(np.linalg.norm((n * rate) @ p - goal))


@pytest.mark.parametrize(("shares", "least"), [((0.6, 0.3, 0.1), 0.0), ((0.0, 1.0, 0.0), 0.0), ((0.2, 0.1, 0.7), 1.0)])
def test_rates_are_the_least_squares(spark, shares, least):
    rows = soft_rows(1)
    frame = spark.createDataFrame(rows, "id long, n_tokens long, p array<double>")
    n, p = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    goal = n.sum() * np.array(shares)
    fit = mixing.fit_rates(frame, list(goal), least)
    rate = fit.rows.withColumn("r", fit.rate).orderBy("id").toPandas()["r"].to_numpy()
    assert fit.converged and (rate >= least).all() and np.allclose((n * rate) @ p, fit.totals, rtol=1e-9)
    # the distance never rises, and ends where plain projected gradient ends
    assert all(b <= a for a, b in zip(fit.residuals, fit.residuals[1:], strict=False))
    assert np.linalg.norm(np.array(fit.totals) - goal) == pytest.approx(fit.residuals[-1], abs=1e-6 * n.sum())
    assert fit.residuals[-1] <= plain_least_squares(rows, goal, least) * 1.01 + 2e-6 * n.sum()


def test_rates_that_have_not_converged_say_so(spark):
    frame = spark.createDataFrame(soft_rows(2), "id long, n_tokens long, p array<double>")
    with pytest.warns(UserWarning, match="not converged"):
        assert not mixing.fit_rates(frame, [0.0, 9000.0, 0.0], 0.0, rounds=2).converged
    none = mixing.fit_rates(frame.limit(0), [1.0, 1.0, 1.0], 0.0)
    assert none.converged and none.totals == [0.0, 0.0, 0.0]


def test_domains_held_out(spark):
    # learned without the documents of even id; null and repeated labels change little
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs, marks = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    case = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    held = docs.join(marks.filter("doc_id % 2 = 0").select("doc_id", case.alias("is")), "doc_id")
    odd_ones = marks.filter("doc_id % 2 = 1")

    def right(model):
        rows = mixing.shaped(held, "text").select("is", model.posterior().alias("p")).collect()
        return np.mean([model.domains[int(np.argmax(r.p))] == r["is"] for r in rows])

    assert right(mixing.train(docs, odd_ones)) > 0.9
    strange = [(None, 1, 0), (2, None, None)]
    noisy = odd_ones.unionByName(odd_ones.limit(3)).unionByName(spark.createDataFrame(strange, "doc_id long, quality int, toxic int").select(*[F.col(c).cast(odd_ones.schema[c].dataType) for c in odd_ones.columns]))
    assert right(mixing.train(docs, noisy)) > 0.85


def plain_tokens(text):
    """The tokens of a text that the domain classifier may know, worked out in plain Python."""
    text = (text or "").lower()
    pieces = re.split(r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
    words, n, chars = list(dict.fromkeys(pieces)), sum(1 for w in pieces if w), len(text)
    symbols = sum(1 for c in text if ord(c) < 128 and not c.isalnum() and c not in " \t\n\x0b\f\r")
    form = {"symbols": min(40 * symbols // (chars + 1), 20), "length": math.floor(math.log(chars + 1.0) / math.log(2.0)), "letters": chars // (n + 1), "distinct": 10 * len(words) // (n + 1)}
    return {*words, *(w[:6] + "*" for w in words), *(f"#{k}={v}" for k, v in form.items())}


def plain_posteriors(learned, domains, tokens, texts):
    """Bernoulli naive Bayes of learned (domain, text) on the `tokens` best tokens, and the posteriors of texts."""
    bags, k = [(d, plain_tokens(x)) for d, x in learned], len(domains)
    size = [sum(1 for d, _ in bags if d == a) for a in domains]
    count = {a: Counter(t for d, bag in bags if d == a for t in bag) for a in domains}
    gain = {}
    for t in set().union(*count.values()):
        own = [count[a][t] for a in domains]
        if sum(own) >= 5:
            gain[t] = sum((o - sum(own) / sum(size) * s) ** 2 / (sum(own) / sum(size) * s + 1) for o, s in zip(own, size, strict=True))
    best = sorted(gain, key=lambda t: (-gain[t], t.encode()))[:tokens]
    share = {t: [(count[a][t] + 0.5) / (s + 1) for a, s in zip(domains, size, strict=True)] for t in best}
    found = []
    for text in texts:
        bag = plain_tokens(text)
        odds = [math.log((s + 1) / (sum(size) + k)) + sum(math.log(share[t][a] if t in bag else 1 - share[t][a]) for t in best) for a, s in enumerate(size)]
        odds = [math.exp(max(o - max(odds), -30)) for o in odds]
        found.append([o / sum(odds) for o in odds])
    return best, found


@pytest.mark.parametrize("tokens", [7, 40])
def test_posteriors_against_plain_naive_bayes(spark, odd, documents, labels, tokens):
    model = mixing.train(documents, labels, tokens=tokens)
    texts, marks = texts_of(documents), labels.collect()
    domain = lambda r: "toxic" if r.toxic == 1 else "good" if r.quality == 1 else "poor"
    asked = [*texts.values(), *(r[1] for r in ODD)]
    best, want = plain_posteriors([(domain(r), texts[r.doc_id]) for r in marks if r.doc_id in texts], model.domains, tokens, asked)
    assert set(best) == set(model.weights)
    frame = spark.createDataFrame(list(enumerate(asked)), "n long, text string")
    got = [r.p for r in mixing.shaped(frame, "text").select("n", model.posterior().alias("p")).orderBy("n").collect()]
    assert np.allclose(np.array(got), np.array(want), atol=1e-9)


def test_rates_written_down_are_those_of_all_steps(spark):
    rows = spark.createDataFrame(soft_rows(1), "id long, n_tokens long, p array<double>").withColumn("text", F.lit("stays out"))
    goal = [9000.0, 10.0, 10.0]
    with pytest.warns(UserWarning, match="not converged"):
        often, once = (mixing.fit_rates(rows, goal, 0.0, rounds=5, cut_every=k) for k in (1, 1000))
    assert len(often.residuals) == 6 and often.rows.columns == rows.columns
    rate = lambda fit: fit.rows.withColumn("r", fit.rate).orderBy("id").toPandas()["r"].to_numpy()
    assert np.allclose(rate(often), rate(once), rtol=1e-6, atol=1e-9)
    n, p = np.array([r.n_tokens for r in rows.orderBy("id").collect()]), np.array([r.p for r in rows.orderBy("id").collect()])
    assert np.allclose((n * rate(often)) @ p, often.totals, rtol=1e-9)


def test_mixing_documents(spark, odd, empty, documents, labels):
    model = mixing.train(documents, labels)
    found = mixing.mixed(documents, model, {"good": 0.8, "poor": 0.15, "toxic": 0.05}).toPandas()
    p = np.array(found["p"].tolist())
    assert len(found) == documents.count() and np.allclose(p.sum(axis=1), 1)
    totals = (found["n_tokens"].to_numpy() * found["rate"].to_numpy()) @ p
    share = {d: t / found["n_tokens"].sum() for d, t in zip(model.domains, totals, strict=True)}
    assert share == pytest.approx({"good": 0.8, "poor": 0.15, "toxic": 0.05}, abs=0.01)
    assert ((found["copies"] - found["rate"]).abs() < 1).all()
    assert set(mixing.mix(documents, model, {"good": 0.8, "poor": 0.2}, least=1.0).select("doc_id").distinct().toPandas()["doc_id"]) == set(texts_of(documents))
    # odd rows: each stays, with a rate; null texts have no tokens
    some = mixing.mixed(odd, model, {"good": 1.0}).collect()
    assert Counter(r.doc_id for r in some) == Counter(r[0] for r in ODD) and all(r.rate >= 0 and r.copies >= 0 for r in some)
    assert all(r.n_tokens == 0 for r in some if r.text is None) and "node" in some[0]
    assert mixing.mixed(empty, model, {"good": 1.0}).count() == 0
    clash = odd.withColumn("__text", F.lit("clash")).withColumn("__words", F.lit(1)).withColumn("rate", F.lit("x")).withColumn("__c0", F.lit(2))
    assert {(r["__text"], r["__words"], r["__c0"]) for r in mixing.mixed(clash, model, {"good": 1.0}).collect()} == {("clash", 1, 2)}
    assert mixing.mix(clash, model, {"good": 1.0}, least=1.0).columns == clash.columns
    again = mixing.mix(odd, model, {"good": 1.0}, least=1.0)
    assert again.columns == odd.columns and {(r.node, r.p) for r in again.collect()} == {("clash", 1)}
    assert mixing.mixed(odd, mixing.train(empty, labels.limit(0)), {"good": 1.0}).count() == len(ODD)


# ---- 4: fingerprints


def similarity(a, b):
    a, b = (Counter(x for x in SPACE.split(t) if x) for t in (a, b))
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_fingerprints(documents):
    rows = {r.doc_id: r for r in fingerprints.fingerprints(documents, buckets=5).collect()}
    docs = sorted(texts_of(documents).items())
    by_text, off = {}, []
    for k, (i, text) in enumerate(docs):
        after, half, r = docs[(k + 1) % len(docs)][1], len(text) // 2, rows[i]
        edited = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert r.near_next == pytest.approx(sum(r.fingerprint[x : x + 8] == rows[docs[(k + 1) % len(docs)][0]].fingerprint[x : x + 8] for x in range(0, len(r.fingerprint), 8)) / max(1, len(r.fingerprint) // 8), abs=1e-9) or not text.strip()
        off.append((r.near_edited - similarity(text, edited), r.near_next - similarity(text, after)))
    off = np.array(off)
    assert np.abs(off.mean(axis=0)).max() < 0.03 and np.sqrt((off**2).mean(axis=0)).max() < 0.14
    assert len(rows) == len(docs)


def test_collision_rate_with_weights(spark):
    a, b = {"x": 8, "y": 1, "z": 3}, {"x": 2, "y": 4, "q": 1}
    texts = [(0, " ".join(w for w, n in a.items() for _ in range(n))), (1, " ".join(w for w, n in b.items() for _ in range(n)))]
    sigs = {r.k: r.sig for r in fingerprints.signatures(spark.createDataFrame(texts, "k long, t string"), ["k"], "t", 200).collect()}
    rate = np.mean([x == y for x, y in zip(sigs[0], sigs[1], strict=True)])
    want = similarity(texts[0][1], texts[1][1])
    assert abs(rate - want) < 4 * math.sqrt(want * (1 - want) / 200)


def test_fingerprints_of_hot_ids(spark):
    # an id and null that hold most rows are divided, and every row still has its next
    rows = [(7, f"text {k % 40} of one id") for k in range(120)] + [(None, f"no id {k}") for k in range(80)] + [(k, f"other {k}") for k in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    placed = fingerprints.with_next(frame, 16, "doc_id", "text").collect()
    sizes = Counter(r.bucket for r in placed if not r.tail)
    assert max(sizes.values()) < 50 and len(sizes) > 10 and sum(sizes.values()) == len(rows)
    hashed = {r.text: r.h for r in frame.select("text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
    want = Counter((i, x, order[(k + 1) % len(order)][1]) for k, (i, x) in enumerate(order))
    assert Counter((r.doc_id, r.text, r.next) for r in placed if not r.tail) == want


def test_fingerprints_of_odd_rows(odd, empty, spark):
    rows = fingerprints.fingerprints(odd, buckets=3).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ODD)
    by = {r.doc_id: r for r in rows}
    assert by[2].fingerprint == by[3].fingerprint == by[4].fingerprint == "" and by[2].near_next == 1.0 and by[4].near_next == 0.0
    assert by[6].fingerprint == by[7].fingerprint and by[6].near_next == 1.0
    assert fingerprints.fingerprints(empty).count() == 0
    one = fingerprints.fingerprints(spark.createDataFrame([(5, "a b c")], "doc_id long, text string")).first()
    assert one.n_chars == 5 and one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a ba ").hexdigest()[:0] + hashlib.sha256(("a b c"[:3] + "a ").encode()).hexdigest()


@pytest.mark.parametrize("kind", ["string", "binary", "date", "int", "double", "decimal(10,2)"])
def test_fingerprints_with_ids_of_other_kinds(spark, kind):
    rows = [(f"doc-{k:03d}", f"some words {k % 5} of text number {k}") for k in range(40)] + [("doc-0071", "a b c"), (None, "no id"), ("doc-003", "again 3")]
    frame = spark.createDataFrame(rows, "name string, text string")
    number = F.substring("name", 5, 3).cast("int")
    made = {"date": F.date_add(F.lit("2024-01-01").cast("date"), number)}.get(kind, F.col("name").cast(kind) if kind in ("string", "binary") else number.cast(kind))
    frame = frame.withColumn("doc_id", made)
    ids = [(r.doc_id, r.text) for r in frame.orderBy(F.col("doc_id").asc_nulls_first(), F.shiftrightunsigned(F.xxhash64("text"), 1), "text").collect()]
    want = Counter()
    for k, (i, text) in enumerate(ids):
        after = ids[(k + 1) % len(ids)][1]
        half = len(text) // 2
        want[str(i), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    for buckets in (1, 6, 30):
        got = Counter((str(r.doc_id), r.edited_sha256) for r in fingerprints.fingerprints(frame, samples=2, buckets=buckets).collect())
        assert got == want
    with pytest.raises(TypeError, match="ids must be"):
        fingerprints.fingerprints(frame.withColumn("doc_id", F.array("doc_id")))


# ---- 5: near duplicates


def plain_groups(docs, words, percent):
    sets = {}
    for i, text in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    parent = {i: i for i in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in docs}


def test_near_groups_refuses_what_the_trees_are_not_made_for(documents):
    for f in (near_dedup.near_groups, near_dedup.keep_one):
        with pytest.raises(ValueError, match="at least 80"):
            f(documents, 4, 50)


@pytest.mark.parametrize(("words", "percent"), [(4, 80), (5, 80)])
def test_near_groups_against_all_pairs(documents, words, percent):
    rows = near_dedup.near_groups(documents, words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain_groups(texts_of(documents), words, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_groups_around_one_text(spark, monkeypatch):
    # a text and many that are near it, but not near each other, in crowded regions
    monkeypatch.setattr(near_dedup, "CROWD", 4)
    monkeypatch.setattr(near_dedup, "PARTNERS", 20)
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(200)]
    docs = {100: " ".join(base)}
    for k in range(80):
        at = rng.randint(0, 180)
        own = base[:at] + [f"v{rng.randint(0, 99999)}" for _ in range(18)] + base[at + 18 :]
        docs[k if k < 50 else k + 100] = " ".join(own)
    docs |= {900 + k: " ".join(f"u{rng.randint(0, 9999)}" for _ in range(rng.randint(1, 50))) for k in range(40)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(frame, 4, 80).collect()}
    assert got == plain_groups(docs, 4, 80)


def test_near_groups_along_a_chain(spark):
    # each text is near the one before it alone, so no middle holds the group together
    rng = random.Random(8)
    words = [f"w{rng.randint(0, 9999)}" for _ in range(150)]
    docs = {}
    for k in range(60):
        docs[1000 - k] = " ".join(words)
        at = (k * 12) % 138
        words = words[:at] + [f"v{rng.randint(0, 99999)}" for _ in range(10)] + words[at + 10 :]
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = plain_groups(docs, 4, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(frame, 4, 80).collect()}
    links = sum(want[k][1] != k for k in docs)
    assert links > 50 and sum(got[k][1] == want[k][1] for k in docs) >= 0.9 * len(docs)


def test_forest_is_sorted_into_regions(spark):
    # LSH forest by hand: which rows have mates, how deep, and who stands beside whom, over several partitions
    rng = random.Random(9)
    nodes = []
    for k in range(60):
        sig = np.array([rng.choice((1, 2)) if rng.random() < 0.3 else 7 for _ in range(near_dedup.HASHES)], dtype=np.uint32)
        nodes.append((k.to_bytes(2), 10, sig.tobytes()))
    keys = near_dedup.order_keys(spark.createDataFrame(nodes, "node binary, n long, sig binary"))
    found = near_dedup.members(keys).collect()
    order = sorted((bytes(r.place), bytes(r.node)) for r in keys.collect())

    def shared(a, b):
        d = 0
        while d < near_dedup.DEEPEST and a[: 3 + 2 * d] == b[: 3 + 2 * d]:
            d += 1
        return d

    beside = {(n, p): (order[k - 1] if k else None, order[k + 1] if k + 1 < len(order) else None) for k, (p, n) in enumerate(order)}
    ends = {(bytes(r.node), bytes(r.place)) for r in found if r.end}
    for r in found:
        before, after = beside[bytes(r.node), bytes(r.place)]
        deep = max(shared(bytes(r.place), x[0]) if x else 0 for x in (before, after))
        assert r.end or r.deep == deep or (bytes(r.node), bytes(r.place)) in ends
        assert r.mate is None or bytes(r.mate) == before[1]
    want = {(n, p) for (n, p), xs in beside.items() if any(x and shared(p, x[0]) >= near_dedup.PREFIX for x in xs)}
    assert want <= {(bytes(r.node), bytes(r.place)) for r in found} <= want | ends


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(500, k) for k in range(501, 560)] + [(k, k + 1) for k in range(700, 760)]
    parent = {x: x for ab in links for x in ab}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_near_groups_of_odd_rows(odd, empty):
    rows = near_dedup.near_groups(odd, 4, 80).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ODD)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[6].component_id == by[7].component_id == by[8].component_id == 6 and not by[8].kept
    assert all(by[k].component_id == k and by[k].kept and by[k].n_shingles == 0 for k in (2, 3, 4))
    assert by[5].n_shingles == 1 and by[11].component_id == 11
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert near_dedup.near_groups(empty, 4, 80).count() == 0
    assert {r.doc_id for r in near_dedup.keep_one(odd, 4, 80).collect()} == {r[0] for r in ODD} - {7, 8}
    # ids and texts under other names, beside columns of the names that the operator uses
    other = odd.withColumnRenamed("doc_id", "id").withColumnRenamed("text", "body")
    for k in ("doc_id", "text", "text_hash", "__gone", "set_id"):
        other = other.withColumn(k, F.lit("clash"))
    assert Counter(map(tuple, near_dedup.near_groups(other, 4, 80, "id", "body").collect())) == Counter(map(tuple, rows))
    kept = near_dedup.keep_one(other, 4, 80, "id", "body")
    assert kept.columns == other.columns and {r.id for r in kept.collect()} == {r[0] for r in ODD} - {7, 8}


def test_near_groups_of_repeated_ids(spark):
    # an id of two texts links what is near either
    texts = {"a": "one two three four five six seven eight", "b": "red green blue grey pink teal gold lime"}
    rows = [(5, texts["a"]), (5, texts["b"]), (3, texts["a"] + "  "), (4, texts["b"].upper()), (9, "something else entirely")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in near_dedup.near_groups(frame, 4, 80).collect())
    assert got == Counter({(5, 3): 2, (3, 3): 1, (4, 3): 1, (9, 9): 1})


# ---- 6: language identification


def test_languages_held_out(documents):
    model = language_id.train(documents)
    rows = language_id.identify(documents, model).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_word_first_then_shorter_n_grams():
    counts = {0: {"a": Counter(zebra=9), "b": Counter(apfel=9)}, 2: {"a": Counter({"<q": 5}), "b": Counter({"ü>": 5})}, 1: {"b": Counter(k=4)}}
    model = language_id.LanguageModel.of_counts(["a", "b"], counts)
    assert model.predict(b"zebra zebra apfel")[0] == "a" and model.predict(b"quuu")[0] == "a" and model.predict("tü".encode())[0] == "b" and model.predict(b"k")[0] == "b"
    assert model.predict(None) == model.predict(b"12 --") == ("und", 0.0)
    assert model.predict(b"zebra " * 150_000)[0] == "a"


def plain_languages(rows):
    """What (id, text, lang) teach, in dictionaries; a function from text to language and posterior."""
    word, lengths = re.compile(r"[^\W\d_]+"), (5, 4, 3, 2, 1)
    grams = lambda w, n: list(w) if n == 1 else [f"<{w}>"[k : k + n] for k in range(len(w) + 3 - n)]
    counts = {k: {} for k in (0, *lengths)}
    for i, text, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            for w in word.findall((text or "").lower()):
                for k in counts:
                    for g in [w] if k == 0 else grams(w, k):
                        counts[k].setdefault(g, Counter())[lang] += 1
    langs = sorted({x for c in counts[0].values() for x in c})
    whole = {k: {x: sum(c[x] for c in found.values()) + 0.5 * (len(found) + 1) for x in langs} for k, found in counts.items()}
    logs = lambda k, g, x: math.log((counts[k][g][x] + 0.5) / whole[k][x])

    def score(w, x):
        if w in counts[0]:
            return logs(0, w, x)
        for n in lengths:
            if known := [g for g in grams(w, n) if g in counts[n]]:
                return sum(logs(n, g, x) for g in known) / len(known)
        return 0.0

    def predict(text):
        words = word.findall((text or "").lower())
        if not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        total = {x: sum(score(w, x) for w in words) for x in langs}
        most = max(total.values())
        return min((-v, x) for x, v in total.items())[1], 1 / sum(math.exp(v - most) for v in total.values())

    return predict


def test_languages_against_dictionaries(documents, odd):
    # every second text unknown to the model, so that words fall back to n-grams
    model = language_id.train(documents.filter("doc_id % 2 = 0"))
    predict = plain_languages([r for r in documents.select("doc_id", "text", "lang").collect() if r.doc_id % 2 == 0])
    for frame in (documents, odd):
        texts = Counter((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect())
        want = sorted((repr(i), *predict(x)) for (i, x), n in texts.items() for _ in range(n))
        got = sorted((repr(r.doc_id), r.lang_pred, r.score) for r in language_id.identify(frame, model).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-9)
    # an id that repeats teaches nothing
    one = next(r.doc_id for r in documents.filter("lang is not null").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.text)
    twice = documents.unionByName(documents.filter(F.col("doc_id") == one))
    assert language_id.train(twice).tables[0].n.sum() < language_id.train(documents).tables[0].n.sum()


def test_languages_of_odd_rows(odd, empty, documents):
    model = language_id.train(documents)
    rows = language_id.identify(odd, model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ODD)
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {2, 3, 4, None}
    assert language_id.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, language_id.train(empty)).collect()} == {"und"}


# ---- 7: exact duplicates


def test_exact_groups(odd, documents):
    for frame in (documents, odd.filter("doc_id <> 11")):
        docs = texts_of(frame)
        groups = {}
        for i, t in docs.items():
            groups.setdefault(SPACE.sub("", t), []).append(i)
        want = {}
        for bare, ids in groups.items():
            keep = min(ids, key=lambda i: (-len(docs[i]), i))
            want |= {i: (keep, len(ids), i == keep, hashlib.sha256(bare.encode()).hexdigest()) for i in ids}
        rows = exact_dedup.exact_groups(frame, common=2).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows} == want and len(rows) == len(want)


def test_runs_go_up_a_binomial_tree(spark):
    rng = random.Random(3)
    rows = [(k, rng.randint(1, 9), rng.randint(0, 5), bytes([rng.randint(0, 2)]), 4) for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, n_chars long, digest long, sha binary, length long")
    runs = exact_dedup.first_runs(frame, 8).collect()
    assert len({(r.run, r.digest, bytes(r.sha)) for r in runs}) == len(runs) and {r.run for r in runs} == set(range(8))
    # by hand: run r goes to r & (r - 1) once all that come to r have arrived
    held = {}
    for r in runs:
        held.setdefault(r.run, {})[r.digest, bytes(r.sha)] = (r.minus, r.keep_id, r.group_size)
    for k in (3, 2, 1):
        for r in [x for x in held if bin(x).count("1") == k]:
            for key, (minus, keep, size) in held.pop(r).items():
                old = held[r & (r - 1)].get(key)
                best = min((minus, keep), old[:2]) if old else (minus, keep)
                held[r & (r - 1)][key] = (*best, size + (old[2] if old else 0))
    got = {(r.digest, bytes(r.sha)): (r.minus, r.keep_id, r.group_size) for r in exact_dedup.tree_merge(frame, 3).collect()}
    assert list(held) == [0] and got == held[0]


def test_a_digest_that_clashes_is_verified(odd, documents):
    for frame in (documents, odd):
        fair = Counter(map(tuple, exact_dedup.exact_groups(frame).collect()))
        assert Counter(map(tuple, exact_dedup.exact_groups(frame, digest=lambda bare: F.length(bare) % 3).collect())) == fair


def test_exact_groups_of_odd_rows(odd, empty):
    rows = exact_dedup.exact_groups(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ODD)
    assert sorted(r.kept for r in rows if r.doc_id == 11) == [False, True]
    # the empty texts: 2, 3, 4 and one without id; the longest original stays
    assert {r.keep_id for r in rows if r.group_size == 4} == {4}
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.keep_first(odd)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 5, 6, 8, 9, 10, 11] and kept.columns == odd.columns
    other = odd.withColumnRenamed("doc_id", "id").withColumn("__id", F.lit("clash")).withColumn("__sha", F.lit(0)).withColumn("doc_id", F.lit(1)).withColumn("digest", F.lit(1))
    again = exact_dedup.keep_first(other, "id")
    assert Counter(r.id for r in again.collect()) == Counter(r.doc_id for r in kept.collect()) and again.columns == other.columns


def test_a_row_many_times_over(spark):
    docs = spark.range(150_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("again and again").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(6, "againandagain"), (7, "else")], "doc_id long, text string"))
    found = exact_dedup.exact_groups(docs).groupBy("doc_id", "keep_id", "group_size", "kept").count().collect()
    assert sorted(map(tuple, found)) == [(5, 5, 150_001, False, 149_999), (5, 5, 150_001, True, 1), (6, 5, 150_001, False, 1), (7, 7, 1, True, 1)]


# ---- 8: chat formatting


def test_chat_round_trip(spark):
    rng = random.Random(4)
    parts = ["</s>", "[INST]", "[/INST]", "<|im_end|>", "<|im_start|>", "\\", "\\\\", "n", "\n", "<", "|", "é日", " ok ", "<|endoftext|>", ""]
    rows = []
    for c in range(40):
        rows += [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole<s>"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for t in range(rng.randint(1, 6))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_conversations(frame, BYTE_BPE)
    for r in chat_format.read_back(formatted).collect():
        own = sorted(x[1:] for x in rows if x[0] == r.conv_id)
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in formatted.collect():
        assert len(r.ids) == len(r.loss_mask) and r.formatted.count("<|im_start|>") == r.n_turns


def test_masks_by_binary_search():
    mask, parts = chat_format.masked([(0, 2), (2, 5), (5, 5), (5, 9)], [(3, 6), (6, 6)])
    assert mask == [False, True, False, True] and parts == [[(3, 6)], []]


def test_chat_of_odd_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "hi"), (None, 0, "assistant", "x"), (2, 0, "assistant", "b"), (2, 0, "assistant", "b"), (3, 0, "user", "long " * 50_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("ids", F.lit("clash"))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(frame, BYTE_BPE)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[2].loss_chars, got[None].loss_chars, got[3].loss_chars) == (2, 0, 2, 1, 0)
    # rows without conv_id are conversations of their own
    nameless = frame.filter("conv_id is null").unionByName(frame.filter("conv_id = 2").withColumn("conv_id", F.lit(None).cast("long")))
    assert [(r.conv_id, r.n_turns) for r in chat_format.read_back(chat_format.format_conversations(nameless, BYTE_BPE)).collect()] == [(None, 1)] * 3
    assert chat_format.format_conversations(frame.limit(0), BYTE_BPE).count() == 0


# ---- 9: token counts


def plain_pieces(word, tokens):
    n = 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in tokens), 0)
        if not k:
            return 1
        word, n = word[k:], n + 1
    return n


def test_longest_match_on_small_vocabularies():
    rng = random.Random(11)
    for _ in range(300):
        tokens = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        automaton = token_counts.LongestMatch(tokens)
        for _ in range(20):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 14)))
            assert automaton.count(word) == plain_pieces(word, tokens)


def test_token_counts(odd, empty, documents):
    tokens = set(token_counts.byte_tokens(BYTE_BPE))
    pieces = {}
    for frame in (odd, documents):
        frame = frame.select("doc_id", "text").persist()
        want = Counter()
        for r in frame.collect():
            words = (r.text or "").encode().split()
            for w in set(words) - pieces.keys():
                pieces[w] = plain_pieces(b" " + w, tokens)
            want[r.doc_id, len(words), sum(map(pieces.get, words))] += 1
        assert Counter(tuple(r) for r in token_counts.count_tokens(frame, BYTE_BPE).collect()) == want
    assert token_counts.count_tokens(empty, BYTE_BPE).count() == 0


# ---- 10: toxicity


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu") for b in ("ren", "sat", "vik", "dom", "pel")]
    rows, marks = [], []
    for k in range(900):
        words = [rng.choice(plain) for _ in range(40)]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(3):
                words[rng.randint(0, 39)] = rng.choice(["grobble", "snarfle", "zukfoo", "zukbar", "zukbaz"])
        rows.append((k, " ".join(words)))
        marks.append((k, int(bad) if rng.random() > 0.03 else 1 - int(bad), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([m[:2] for m in marks], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    truth = {k: t for k, _, t in marks}
    scored = toxicity.score_documents(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and (r.predicted == 1) == (r.score >= 0.5) for r in scored)
    held = [r for r in scored if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert {r.doc_id for r in toxicity.keep_clean(docs, model).collect()} == {r.doc_id for r in scored if not r.predicted}


def test_label_model_discounts_copies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    vote = lambda hit, false: np.where(y, rng.random(4000) < hit, rng.random(4000) < false).astype(float)
    one, other = vote(0.6, 0.02), vote(0.6, 0.02)
    labels = np.where(rng.random(4000) < 0.05, ~y, y).astype(float)
    post, rate, own, share = toxicity.label_posteriors(np.column_stack([one, one, one, other]), labels)
    # three copies of one voter share what one of them would have; accuracies come out in the right order
    assert own[0] == own[1] == own[2] and own[0] < 0.65 * own[3]
    assert (rate[1, :4] > 10 * rate[0, :4]).all() and ((post > 0.5) == y).mean() > 0.93
    # of independent voters, the class share and the label's accuracy are estimated, also where a quarter of labels are wrong
    voters = np.column_stack([one, other, vote(0.7, 0.02), vote(0.8, 0.05)])
    for wrong in (0.05, 0.25):
        labels = np.where(rng.random(4000) < wrong, ~y, y).astype(float)
        post, rate, own, share = toxicity.label_posteriors(voters, labels)
        assert abs(share - y.mean()) < 0.02 and abs(rate[1, -1] - (1 - wrong)) < 0.04 and abs(rate[0, -1] - wrong) < 0.04
        assert own.min() > 0.9 and ((post > 0.5) == y).mean() > 0.95


def plain_label_model(votes, labels, noise=0.05, trust=50.0):
    """The label model in loops."""
    rows = [[*map(float, v), float(x)] for v, x in zip(votes, labels, strict=True)]
    m, n = len(rows[0]), len(rows)
    post = [1 - noise if x else noise for x in labels]
    for _ in range(200):
        size = [n - sum(post), sum(post)]
        share = (size[1] + 0.5) / (n + 1)
        rate = [[(sum((q if c else 1 - q) * r[j] for q, r in zip(post, rows, strict=True)) + 0.5) / (size[c] + 1) for j in range(m)] for c in (0, 1)]
        for c, expected in ((0, min(noise, noise * share / (1 - share))), (1, 1 - noise)):
            rate[c][-1] = (sum((q if c else 1 - q) * r[-1] for q, r in zip(post, rows, strict=True)) + trust * expected) / (size[c] + trust)
        within = [[sum(r[a] * r[b] for r in rows) - sum(size[c] * rate[c][a] * rate[c][b] for c in (0, 1)) for b in range(m)] for a in range(m)]
        own = []
        for a in range(m):
            shared = [min(1.0, within[a][b] / math.sqrt(max(within[a][a], 1e-9) * max(within[b][b], 1e-9))) for b in range(m - 1) if b != a]
            own.append(1 / (1 + sum(x for x in shared if x >= 3 / math.sqrt(n)) * (a < m - 1)))
        new = []
        for r in rows:
            z = math.log(share / (1 - share))
            for j in range(m):
                p, q = (rate[1][j], rate[0][j]) if r[j] else (1 - rate[1][j], 1 - rate[0][j])
                z += own[j] * math.log(p / q)
            new.append(min(1 - 1e-6, max(1e-6, 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))))
        moved, post = max(abs(a - b) for a, b in zip(new, post, strict=True)), new
        if moved < 1e-6:
            break
    return post


def test_label_model_and_fit_against_loops():
    rng = np.random.default_rng(5)
    y = rng.random(150) < 0.25
    votes = np.stack([np.where(y, rng.random(150) < 0.5 + 0.1 * k, rng.random(150) < 0.03 * (k + 1)) for k in range(4)], axis=1).astype(float)
    labels = np.where(rng.random(150) < 0.06, ~y, y).astype(float)
    post, *_ = toxicity.label_posteriors(votes, labels)
    assert post == pytest.approx(plain_label_model(votes.astype(int).tolist(), labels.astype(int).tolist()), abs=1e-6)
    # the linear classifier is where the penalised likelihood is flat
    w = toxicity.fit_linear(votes, post)
    p = 1 / (1 + np.exp(-(votes @ w[:-1] + w[-1])))
    assert votes.T @ (post - p) == pytest.approx(w[:-1], abs=1e-5) and (post - p).sum() == pytest.approx(0, abs=1e-5)


def test_lexicon_and_votes_against_counting(documents, labels):
    sample = documents.join(labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")), "doc_id").select("text", "toxic")
    rows = [(r.text or "", r.toxic) for r in sample.collect()]
    seen = {0: Counter(), 1: Counter()}
    for text, toxic in rows:
        words = set(re.findall(r"[^\W\d_]+", text.lower()))
        seen[toxic].update({w for w in words} | {w[:n] + "*" for w in words for n in range(4, 9) if n < len(w)})
    n0, n1 = (sum(x == k for _, x in rows) for k in (0, 1))
    scored = []
    for f, b in seen[1].items():
        a = seen[0][f]
        p0, p1, p = (a + 0.5) / (n0 + 1), (b + 0.5) / (n1 + 1), (a + b) / (n0 + n1)
        if b >= 3 and p1 > 5 * p0:
            scored.append((-2 * (b * math.log(p1 / p) + a * math.log(p0 / p)), f))
    found = toxicity.induce(sample, 30, 3)
    gain = {f: g for g, f in scored}
    assert [round(gain[f], 6) for f in found] == [round(g, 6) for g, _ in sorted(scored)[:30]]
    voters = toxicity.Voters(found)
    for text, _ in rows[:40]:
        words = re.findall(r"[^\W\d_]+", text.lower())
        hit = lambda w, f: w == f or f[-1] == "*" and w.startswith(f[:-1]) and len(w) > len(f) - 1
        want = [float(any(hit(w, f) for w in words)) for f in found] + [float(re.search(x, text) is not None) for x in toxicity.PATTERNS.values()]
        hits = sum(any(hit(w, f) for f in found) for w in words)
        assert voters.features(text.encode()).tolist() == pytest.approx([*want, math.log1p(hits), hits / (len(words) + 20.0)])


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_toxic_documents_held_out(spark, folder):
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs, marks = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    # null labels teach nothing, of two labels of one id the greater counts
    strange = spark.createDataFrame([(None, 1), (7, None)], "doc_id long, toxic int").select(*[F.col(c).cast(marks.schema[c].dataType) for c in ("doc_id", "toxic")])
    model = toxicity.train(docs, marks.select("doc_id", "toxic").unionByName(strange))
    rows = toxicity.score_documents(docs, model).filter("held_out").join(marks, "doc_id").collect()
    clean, toxic = ([r.predicted for r in rows if r.toxic == k] for k in (0, 1))
    assert len(toxic) >= 5 and np.mean(clean) < 0.02 and np.mean(toxic) > 0.7


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_clean_documents_stay(spark, folder):
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs, marks = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.score_documents(docs, toxicity.train(docs, marks)).join(marks, "doc_id").collect()
    clean, toxic = ([r.predicted for r in rows if r.toxic == k] for k in (0, 1))
    assert np.mean(clean) < 0.01 and np.mean(toxic) > 0.5


def test_toxicity_learns_one_text_of_a_repeated_id(spark, documents, labels, monkeypatch):
    seen, plain = [], toxicity.label_posteriors
    monkeypatch.setattr(toxicity, "label_posteriors", lambda votes, own: seen.append(len(own)) or plain(votes, own))
    model = toxicity.train(documents, labels)
    one = labels.filter(toxicity.id_fold(F.col("doc_id"), 5) != 0).join(documents.select("doc_id"), "doc_id").first().doc_id
    own = documents.filter(F.col("doc_id") == one)
    often = documents.unionByName(own.crossJoin(spark.range(500)).select(documents.columns))
    again = toxicity.train(often, labels)
    assert seen[0] == seen[1] and model.voters.lexicon == again.voters.lexicon
    # which of an id's different texts is taken doesn't depend on their order
    texts = [(1, "b", 0), (1, "a", 0), (1, "c", 0), (2, None, 1)]
    found = [sorted(map(tuple, toxicity.one_text(spark.createDataFrame(x, "doc_id long, text string, toxic int")).collect())) for x in (texts, texts[::-1])]
    assert found[0] == found[1] and [r[0] for r in found[0]] == [1, 2]


def test_toxicity_of_odd_rows(odd, empty, documents, labels):
    model = toxicity.train(documents, labels)
    rows = toxicity.score_documents(odd, model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_documents(empty, model).count() == 0
    none = toxicity.train(empty, labels)
    assert all(r.predicted == 0 for r in toxicity.score_documents(odd, none).collect())
    assert toxicity.keep_clean(odd, none).count() == len(ODD)


def test_bounded_sample(spark):
    rows = spark.range(1000).withColumnRenamed("id", "doc_id")
    some = bounded_sample(rows, 50)
    assert some.count() == 50 and bounded_sample(rows, 5000).count() == 1000
    assert {r.doc_id for r in some.collect()} == {r.doc_id for r in bounded_sample(rows.repartition(7), 50).collect()}


def test_vocabulary_is_read_in_place():
    assert json.load(open(BYTE_BPE, encoding="utf-8"))["model"]["type"] == "BPE"


def test_texts_go_to_python_some_megabytes_at_a_time(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    sized = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
    texts = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('x', 5000) AS text")
    said = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        assert [r.n for r in common.batched(texts).mapInArrow(sized, "n long").collect()] == [pytest.approx(4 << 20, rel=0.01)] * 3 + [pytest.approx(3000 * 5012 - 3 * (4 << 20), rel=0.05)]
        # what the session says holds
        spark.conf.set(key, "1m")
        assert len(common.batched(texts).mapInArrow(sized, "n long").collect()) == 15
    finally:
        spark.conf.unset(key) if said is None else spark.conf.set(key, said)


def test_order_keys_are_made_of_some_nodes_at_a_time(spark):
    nodes = spark.range(0, 2500, 1, 1).selectExpr("cast(cast(id AS string) AS binary) AS node", "id AS n", "cast(repeat('abcd', 128) AS binary) AS sig")
    keys = near_dedup.order_keys(nodes)
    sized = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["rows"]) for b in batches)
    assert keys.count() == 2500 * near_dedup.TREES and keys.select("node", "n").distinct().count() == 2500
    assert max(near_dedup.KEYED, near_dedup.WordHashes.MOST) <= 1 << 16
    assert sum(r.rows for r in keys.mapInArrow(sized, "rows long").collect()) == 2500 * near_dedup.TREES


def test_a_task_takes_its_memory_of_tokens_with_it(spark, monkeypatch):
    made = []
    monkeypatch.setattr(bpe, "map_texts", lambda docs, keys, text, make, schema: made.append(make))
    bpe.encode_decode(None, BYTE_BPE)
    bpe.encode_documents(None, BYTE_BPE)
    for make in made:
        first, second = make(), make()
        assert str(first(b"some words, some words")) == str(first(b"some words, some words")) == str(second(b"some words, some words"))
    # what stays in the process is the vocabulary alone
    assert not bpe._loaded[BYTE_BPE]._pieces and not bpe._loaded[BYTE_BPE]._fragments
    assert bpe.load(BYTE_BPE).rank_of is bpe.load(BYTE_BPE).rank_of and bpe.BytePairs.MEMORY <= 1 << 18
