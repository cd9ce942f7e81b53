"""Importance resampling towards a target text, by hashed word n-grams.

A document's features are its runs of one to `longest` words.  A ring of running CRC states, one for each of the last
`longest` starts, is extended word by word: each state takes a space and the word, a new one begins with the word, and
what the states are after a word are the hashes of all features that end there.  So a document is read once and no
feature is ever built.

Bucket counts of the documents and of the target texts give each bucket a gain, the log ratio of its frequencies; a
document's weight is the mean of its features' gains.  Adding Gumbel noise, a hash of its id, and taking the greatest
scores draws without replacement in proportion to exp(weight / 1000).
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import map_texts, materialize
from wayfare.plans.ordered import in_ranges, running, spread

BUCKETS, LONGEST = 10000, 2
#: Documents of fewer words are never drawn; of the others so many percent are.
LEAST_WORDS, PERCENT = 20, 25
SALT = "7"
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words between two additions to the counts, so that a long text's features are never all held at once.
_SLICE = 1 << 16


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and all that is not ASCII; A-Z in lower case."""
    return _WORD.findall((text or b"").lower())


def feature_buckets(words: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """The buckets of all runs of 1 to `longest` words, a slice of the text at a time."""
    crc, ring = zlib.crc32, []
    for begin in range(0, len(words), _SLICE):
        found: list[int] = []
        for word in words[begin : begin + _SLICE]:
            if len(ring) == longest:
                ring.pop(0)
            spaced = b" " + word
            ring = [crc(spaced, state) for state in ring]
            ring.append(crc(word))
            found += ring
        yield np.array(found, dtype=np.int64) % buckets


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """bucket, n: how many features of all texts of docs fall into each bucket that has any.

    Each task adds up its own texts and passes on one row a bucket at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                for found in feature_buckets(words_of(text.as_py()), longest, buckets):
                    total += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    texts = docs.select(F.col(f"`{text_col}`").cast("string").cast("binary"))
    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain: 1000 times the log ratio of its smoothed frequencies in target and source, floored."""
    whole_s, whole_t = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = lambda s, t: ((t + 1) * whole_s) / ((s + 1) * whole_t)
    return np.array([math.floor(1000 * math.log(ratio(source.get(b, 0), target.get(b, 0)))) for b in range(buckets)], dtype=np.int64)


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """gains_of the features of docs and target; what comes to the driver is two numbers a bucket, however many texts there are."""
    source, wanted = ({r.bucket: r.n for r in bucket_counts(x, longest, buckets).collect()} for x in (docs, target))
    return gains_of(source, wanted, buckets)


def weighted(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: its id, n_words, n_features and weight, the floored mean gain of its features (0 without any)."""

    def make() -> Callable[[bytes | None], tuple]:
        def of_text(text: bytes | None) -> tuple:
            words, n, total = words_of(text), 0, 0
            for found in feature_buckets(words, longest, len(gain)):
                n, total = n + len(found), total + int(gain[found].sum())
            return len(words), n, total // n if n else 0

        return of_text

    return map_texts(docs, [id_col], text_col, make, "n_words long, n_features long, weight long")


def noise(doc_id: Column, salt: str = SALT) -> Column:
    """Gumbel noise in thousandths, floored; a missing id is hashed as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
    percent: int = PERCENT, salt: str = SALT, id_col: str = "doc_id",
) -> DataFrame:
    """One row for each row of docs: its id, n_features, weight, score and rank, null where the row is not drawn.

    Drawn are floor(percent * N / 100) of the N rows with least_words words or more, those of the greatest scores, ties
    to smaller ids; a row without id comes last among ties.  Null and empty texts have no features and weigh 0; texts
    of any length are read whole.  Rows that repeat an id are rows of their own: of equal scores they take ranks that
    follow each other, the heavier texts first.  An empty table gives no rows, an empty target only its smoothing;
    other columns of docs are not read, whatever they are called.

    Ranks are counted in ranges of the order and carried from range to range.  What is ranked are the different rows
    with how often they occur, so a repeated row is one, wherever its copies lie.
    """
    gain = gains(docs, target, longest, buckets)
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col("`text`").alias("text"))
    scored = weighted(named, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), salt))
    scored = materialize(scored, "scored")
    able = scored.filter(F.col("n_words") >= least_words)
    most = able.count() * percent // 100
    once = able.groupBy("doc_id", "n_features", "weight", "score").agg(F.count("*").alias("times"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")]
    placed = running(in_ranges(once, order, "ranges"), [], F.col("__range"), order, {"last": F.col("times")})
    drawn = spread(placed.filter(F.col("last") - F.col("times") < most), F.col("last") - F.col("times") + 1, F.least(F.col("last"), F.lit(most)), "rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    # copies of a row that are not drawn: those beyond `most`, and all rows that are not able
    beyond = placed.filter(F.col("last") > most)
    rest = spread(beyond, F.greatest(F.col("last") - F.col("times"), F.lit(most)) + 1, F.col("last"), "__n")
    short = scored.filter(F.col("n_words") < least_words)
    undrawn = rest.select(*columns).unionByName(short.select(*columns)).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*columns, "rank").unionByName(undrawn)


def importance_sql() -> str:
    """DuckDB SQL for resample over documents and benchmark, its CRC worked out byte by byte with a table that SQL makes."""
    text = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH lookup AS (
  SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256)))),
texts AS (
  SELECT 'd' AS side, CAST(row_number() OVER () AS BIGINT) AS row, doc_id, {text} AS text FROM documents
  UNION ALL SELECT 'b', CAST(row_number() OVER () AS BIGINT), NULL, {text} FROM benchmark),
words AS (SELECT side, row, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (
  SELECT side, row, unnest(w) AS f FROM words
  UNION ALL SELECT side, row, w[i] || ' ' || w[i + 1] FROM (SELECT side, row, w, unnest(range(1, len(w))) AS i FROM words)),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM features)), lookup),
filled AS (SELECT side, row, bucket FROM features JOIN hashed USING (f)),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM filled GROUP BY bucket),
wholes AS (SELECT count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM filled),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((c.t + 1) * (w.s + {BUCKETS}) AS DOUBLE) / CAST((c.s + 1) * (w.t + {BUCKETS}) AS DOUBLE))) AS BIGINT) AS gain FROM counts c, wholes w),
weighed AS (SELECT row, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM filled JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SALT}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS noise
  FROM words LEFT JOIN weighed USING (row) WHERE side = 'd'),
ranked AS (
  SELECT *, weight + noise AS score, CASE WHEN n_words >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY weight + noise DESC, doc_id NULLS LAST) END AS r FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
  CASE WHEN r <= (SELECT count(*) * {PERCENT} // 100 FROM scored WHERE n_words >= {LEAST_WORDS}) THEN r END AS rank
FROM ranked"""
