"""Fingerprints by consistent weighted sampling.

The terms of a text are its words, weighted by how often they occur.  For each of k samples, every term draws, from a
hash of term and sample, two Gamma(2, 1) numbers r and c and a uniform number b.  With t = floor(ln(weight) / r + b)
the term's value is c * exp(-r * (t - b + 1)); the least value over all terms is the sample's.  Two texts agree in a
sample with a chance equal to the generalised Jaccard similarity of their weights: the sum of the smaller weights
over that of the larger ones.  As a value depends on term, sample and t alone, and no two of these give the same, the
least value itself serves as the sample.
"""

from __future__ import annotations

import os
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs of other characters than white space are words.
SPACE = r"[\x20\x09-\x0D]+"


def uniform(h: Column, shift: int, bits: int) -> Column:
    """A number in (0, 1) from some bits of a hash."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(0.5)) / F.lit(float(1 << bits))


def sample_value(term: Column, log_weight: Column, k: int) -> Column:
    """The logarithm of a term's value in sample k."""
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    r = -F.log(uniform(one, 0, 32) * uniform(one, 32, 32))
    c = -F.log(uniform(two, 0, 21) * uniform(two, 21, 21))
    b = uniform(two, 42, 22)
    return F.log(c) - r * (F.floor(log_weight / r + b) - b + F.lit(1.0))


def signatures(texts: DataFrame, keys: list[str], text_col: str, samples: int) -> DataFrame:
    """For each row of texts, whose keys are distinct: keys and sig, the array of its samples; null without words.

    If texts are partitioned by some of the keys, nothing is shuffled.
    """
    word = F.explode_outer(F.split(F.col(text_col), SPACE))
    terms = texts.select(*keys, word.alias("__word")).select(*keys, F.when(F.col("__word") != "", F.xxhash64("__word")).alias("__term"))
    weighted = terms.groupBy(*keys, "__term").agg(F.log(F.count("*").cast("double")).alias("__w"))
    least = [F.min(F.when(F.col("__term").isNotNull(), sample_value(F.col("__term"), F.col("__w"), k))).alias(f"__s{k}") for k in range(samples)]
    sig = F.when(F.col("__s0").isNotNull(), F.array(*[f"__s{k}" for k in range(samples)]))
    return weighted.groupBy(*keys).agg(*least).select(*keys, sig.alias("sig"))


def fingerprint(sig: Column) -> Column:
    """A signature as text: eight hexadecimal digits for each sample; empty without words."""
    digits = F.transform(sig, lambda x: F.substring(F.lpad(F.lower(F.hex(F.xxhash64(x))), 16, "0"), 1, 8))
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def likeness(a: Column, b: Column, samples: int) -> Column:
    """The share of samples that agree; 1 for two texts without words, 0 if one alone has words."""
    agree = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(samples))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(agree)


def measure(docs: DataFrame, id_col: str) -> Column:
    """A number that does not fall as the ids rise: the id itself, a time's seconds, or the bytes of a text behind what all have in common."""
    kind, key = docs.schema[id_col].dataType, F.col(f"`{id_col}`")
    if isinstance(kind, T.NumericType):
        return key
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return key.cast("timestamp").cast("double")
    if not isinstance(kind, (T.StringType, T.BinaryType)):
        raise TypeError(f"ids must be numbers, times, texts or bytes, not {kind.simpleString()}")
    ends = docs.agg(F.hex(F.min(key.cast("binary"))).alias("lo"), F.hex(F.max(key.cast("binary"))).alias("hi")).first()
    same = len(os.path.commonprefix([ends.lo or "", ends.hi or ""])) // 2
    following = F.rpad(F.hex(F.substring(key.cast("binary"), same + 1, 7)), 14, "0")
    return F.conv(following, 16, 10).cast("long")


def with_next(docs: DataFrame, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """docs in buckets of neighbouring rows: bucket, seq, doc_id, text, tail, next (the next row's text).

    Rows are in order of id, null ids first, then of a hash of the text, then of the text.  Buckets begin at quantiles
    of the ids' measure; a number (or null) that fills several of them is divided by ranges of the hash, so that only
    rows equal in both stay together.  In each bucket, rows are numbered by seq.  The row that follows a bucket's last one is in it
    too, as its tail; after the last row of all comes the first.  Null texts become empty.
    """
    measured = measure(docs, id_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), measured.alias("at"))
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1))
    shares = [k / buckets for k in range(1, buckets)]
    ends = docs.agg(
        F.count("*").alias("n"), F.count_if(F.col(f"`{id_col}`").isNull()).alias("nulls"),
        F.percentile_approx(measured, shares, 10_000).alias("at") if shares else F.array().alias("at"),
    ).first()
    times = Counter(x for x in (ends.at or []) if x is not None)
    starts, null = sorted(times), F.col("doc_id").isNull()
    # null ids, ids below the first start, and from each start on: the start itself, in parts, then the ids behind it
    which, parts = F.when(null, F.lit(0)), F.when(null, F.lit(max(1, round(buckets * ends.nulls / max(1, ends.n)))))
    if starts:
        which = which.otherwise(F.lit(1) + F.size(F.filter(F.array(*map(F.lit, starts)), lambda x: x <= F.col("at"))))
        # other ids than numbers may share a measure, and then only their order tells them apart
        times = times if isinstance(docs.schema[id_col].dataType, T.NumericType) else dict.fromkeys(times, 1)
        several = F.create_map(*[F.lit(y) for x in starts for y in (x, times[x])])
        parts = parts.otherwise(several[F.col("at")])
    which = F.coalesce(which, F.lit(1))
    part = F.least(F.floor(F.col("h") / F.lit(float(1 << 63)) * parts), parts - 1)
    placed = rows.withColumn("bucket", (which * F.lit(buckets + 2) + F.coalesce(part, F.lit(buckets + 1))).cast("int"))
    # the first row of each bucket is the tail of the one before; there are few buckets, so this is a small table
    first = placed.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "h")).alias("first")).orderBy("bucket").collect()
    before = [(r.first["doc_id"], r.first["h"], first[k - 1].bucket) for k, r in enumerate(first)]
    schema = T.StructType([rows.schema["doc_id"], T.StructField("h", T.LongType()), T.StructField("before", T.IntegerType())])
    tails = docs.sparkSession.createDataFrame(before, schema).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "before")
    placed = placed.join(F.broadcast(tails), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")), "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("tail"))
    twice = F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(True).alias("tail")))
    placed = placed.withColumn("place", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(twice))).select("place.bucket", "place.tail", "doc_id", "h", "text")
    order = W.partitionBy("bucket").orderBy("tail", F.col("doc_id").asc_nulls_first(), "h", "text")
    return placed.select("bucket", F.row_number().over(order).alias("seq"), "doc_id", "text", "tail", F.coalesce(F.lead("text").over(order), F.lit("")).alias("next"))


def fingerprints(docs: DataFrame, samples: int = 32, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next greater id, for the last one the first; rows of one id follow each
    other in order of a hash of their texts, null ids come first.  The edited text is the text with its last
    floor(n_chars / 2) code points replaced by the first as many of the next one.  Null texts count as empty; texts
    without words have an empty fingerprint, like each other (1) and unlike all others (0); texts of any length are read
    whole.  Ids are numbers, dates, times, texts or bytes, in their own order; others are refused.  Repeated rows are
    rows of their own, each other's next.  An empty table gives no rows; other columns of docs are not read.

    Documents are shuffled once, into buckets of neighbouring ids (as many as four times the shuffle partitions);
    neighbours meet by a window in each bucket, and everything else stays in place.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = with_next(docs, buckets, id_col, text_col)
    order = W.partitionBy("bucket").orderBy("seq")
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    both = placed.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half)))
    keys = ["bucket", "seq"]
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.when(~F.col("tail"), F.col("edited")).alias("text"))))
    texts = both.select(*keys, kinds.alias("__k")).select(*keys, "__k.kind", "__k.text")
    sigs = signatures(texts, [*keys, "kind"], "text", samples)
    paired = sigs.groupBy(*keys).agg(F.max(F.when(F.col("kind") == 0, F.col("sig"))).alias("own"), F.max(F.when(F.col("kind") == 1, F.col("sig"))).alias("changed"))
    paired = paired.withColumn("after", F.lead("own").over(order))
    about = both.filter(~F.col("tail")).select(*keys, "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    found = about.join(paired, keys)
    return found.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed"), samples).alias("near_edited"), likeness(F.col("own"), F.col("after"), samples).alias("near_next"),
    )
