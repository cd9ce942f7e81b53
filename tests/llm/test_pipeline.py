"""The pipeline and the registered text queries on the smallest tables."""

import glob
import hashlib
import math
import os
import re
import struct
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wayfare.llm import bpe, exact_dedup, near_dedup, queries, toxicity
from wayfare.llm.common import materialize, table

from .test_text_operators import plain_groups

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns, sizes = docs.columns, [docs.count()]
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    seen = [before]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), name)
        sizes.append(docs.count())
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "bpe":
            assert docs.columns == columns
    assert all(after <= earlier for earlier, after in zip(seen, seen[1:], strict=False))
    # few documents are toxic, and clean ones stay
    assert 0.8 * sizes[0] < sizes[1] < sizes[0]
    # copies go, one of each group stays
    toxic_free = seen[1]
    start = table(spark, DATA, "documents").filter(F.col("doc_id").isin(sorted(toxic_free)))
    exact = {r.doc_id for r in exact_dedup.exact_groups(start).filter("kept").collect()}
    assert seen[2] == exact
    near = {r.doc_id for r in near_dedup.near_groups(start.filter(F.col("doc_id").isin(sorted(exact))), 5, 80).filter("kept").collect()}
    assert seen[3] == near
    # mixing repeats documents and loses none; what is encoded are the documents left
    assert seen[3] == seen[4] == seen[5] and sizes[4] >= sizes[3] and sizes[5] == sizes[4]
    want = {tuple(r) for r in bpe.encode_decode(table(spark, DATA, "documents"), queries.BYTE_BPE).collect()}
    assert {tuple(r) for r in docs.collect()} <= want


def plain_features(text, lexicon):
    """What toxicity looks at, worked out with sets and regular expressions alone."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    known = {e for e in lexicon if not e.endswith("*")}
    begins = tuple(e[:-1] for e in lexicon if e.endswith("*"))
    speaks = lambda e, w: len(w) > len(e) - 1 and w.startswith(e[:-1]) if e.endswith("*") else w == e
    hits = [w for w in words if w in known or any(len(w) > len(b) and w.startswith(b) for b in begins)]
    votes = [float(any(speaks(e, w) for w in set(hits))) for e in lexicon]
    return [*votes, *(float(re.search(p, text) is not None) for p in toxicity.PATTERNS.values()), math.log1p(len(hits)), len(hits) / (len(words) + 20.0)]


def test_stages_against_brute_force(spark):
    """All stages on real documents and odd rows, with columns of clashing names, against plain Python."""
    from tokenizers import Tokenizer

    odd = [(9001, None), (9002, ""), (9003, " \n"), (9004, "one two three four five six seven"), (9005, "One  two three four five six seven"),
           (9006, "onetwo three four five six seven"), (9007, "again and again"), (9007, "again and again"), (None, "a row without id"), (9008, "long " * 30_000)]
    base = table(spark, DATA, "documents")
    rows = spark.createDataFrame(odd, "doc_id long, text string").select(*[(F.col(c) if c in ("doc_id", "text") else F.lit(None)).cast(base.schema[c].dataType).alias(c) for c in base.columns])
    docs = base.unionByName(rows)
    for k in ("__id", "__sha", "p", "rate", "digest", "node"):
        docs = docs.withColumn(k, F.lit("clash"))
    columns = docs.columns
    pairs = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    now = pairs(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), name)
        if name == "toxicity":
            model = toxicity.train(materialize(base.unionByName(rows), "same"), table(spark, DATA, "labels"))
            weights, bias = model.weights[:-1], model.weights[-1]
            features = lambda x: plain_features(x, model.voters.lexicon)
            want = Counter((i, x) for i, x in now if sum(w * f for w, f in zip(weights, features(x or ""), strict=True)) + bias < 0)
            assert 0.8 * len(now) < sum(want.values()) < len(now)
        elif name == "exact_dedup":
            groups = {}
            for i, x in now:
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", x or ""), []).append((-len(x or ""), i is None, i or 0, i, x))
            want = Counter((min(g)[3], min(g)[4]) for g in groups.values())
        elif name == "near_dedup":
            groups = plain_groups({i: x or "" for i, x in now if i is not None}, 5, 80)
            want = Counter((i, x) for i, x in now if i is None or groups[i][1] == i)
        elif name == "mixing":
            copies = Counter(pairs(docs))
            assert set(copies) == set(now) and min(copies.values()) >= 1
            want = copies
        else:
            library, want = Tokenizer.from_file(queries.BYTE_BPE), Counter()
            for i, x in now:
                ids = library.encode(x or "", add_special_tokens=False).ids
                text = library.decode(ids, skip_special_tokens=False)
                want[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
            assert Counter(map(tuple, docs.collect())) == want
            continue
        now = pairs(docs)
        assert docs.columns == columns and Counter(now) == want
        assert {tuple(r) for r in docs.select("__id", "__sha", "p", "rate", "digest", "node").distinct().collect()} == {("clash",) * 6}


def test_stages_of_an_empty_table(spark):
    docs = table(spark, DATA, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), name)
        assert docs.count() == 0


def test_oracles(spark):
    duck = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        duck.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    for name, text in queries.oracle_sql().items():
        want = duck.sql(text).to_arrow_table()
        names = sorted(want.column_names)
        got = queries.queries()[name](spark, DATA).toArrow()
        assert sorted(got.column_names) == names
        assert sorted(map(repr, zip(*[got[n].to_pylist() for n in names], strict=True))) == sorted(map(repr, zip(*[want[n].to_pylist() for n in names], strict=True)))
