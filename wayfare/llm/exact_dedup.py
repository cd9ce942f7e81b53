"""Exact duplicates by a tree-merge of sorted digest runs.

Every row is reduced to a digest of its text without white space.  The rows are dealt into 2**k runs by a hash of their
id; a run holds one entry for each text in it, and is sorted by digest, in ranges over the partitions, by the merge
that it first takes part in.  The runs
are the nodes of a binomial tree, in which the parent of a run is its number without the lowest bit: in round k, k - 1,
..., 1 the runs of so many bits go to their parents, and each parent merges all that arrives with its own run.  In a
merge, entries of one digest become neighbours; each is verified against the one before it by SHA-256 and length, and
of verified ones the better identifier stays.  Entries that only share the digest stay apart.  Run 0 is left at last.

A text with any number of copies has one entry in a run, so a merge meets at most k + 1 of them, and no task ever holds
a whole group of copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfare.llm.common import coded, join_groups, materialize
from wayfare.plans.ordered import spread

#: White space that does not count when texts are compared.
SPACE = r"[\x20\x09-\x0D]+"


def stripped(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row for each row of docs: doc_id, n_chars of the original text, and what identifies the stripped text.

    digest is what runs are sorted by; sha (SHA-256) and length (in code points) are what equal digests are verified by.
    """
    text = F.col(f"`{text_col}`")
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.length(F.coalesce(text.cast("string"), F.lit(""))).cast("long").alias("n_chars"),
        stripped(text).alias("__bare"),
    ).select(
        "doc_id", "n_chars",
        digest(F.col("__bare")).cast("long").alias("digest"),
        F.unhex(F.sha2(F.col("__bare").cast("binary"), 256)).alias("sha"),
        F.length("__bare").cast("long").alias("length"),
    )


#: What must agree for two texts to be equal: the digest, and what verifies it.
IDENTITY = ["digest", "sha", "length"]
#: An entry's order among those of its text: as -n_chars, a smaller (minus, keep_id) is better; null ids come last.
BETTER = ["minus", "none", "keep_id"]


def first_runs(rows: DataFrame, runs: int) -> DataFrame:
    """The entries of all runs: run, IDENTITY, BETTER and group_size, one for each text of a run."""
    best = F.min(F.struct((-F.col("n_chars")).alias("minus"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("keep_id"))).alias("best")
    run = F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int").alias("run")
    return rows.groupBy(run, *IDENTITY).agg(best, F.count("*").alias("group_size")).select("run", *IDENTITY, *[f"best.{c}" for c in BETTER], "group_size")


def merge(entries: DataFrame) -> DataFrame:
    """Merge the entries of each run: sorted ranges of (run, digest), in which each entry is compared with the one before.

    Of entries that are verified to be equal the best stays, with the sum of their sizes.
    """
    order = [*IDENTITY, *BETTER]
    before = W.partitionBy("run", "digest").orderBy(*order[1:])
    verified = F.col("sha").eqNullSafe(F.lag("sha").over(before)) & F.col("length").eqNullSafe(F.lag("length").over(before))
    size = F.sum("group_size").over(W.partitionBy("run", *IDENTITY))
    ranges = entries.repartitionByRange("run", "digest").sortWithinPartitions("run", *order)
    return ranges.withColumn("__again", verified).withColumn("group_size", size).filter("not __again").drop("__again")


def tree_merge(rows: DataFrame, bits: int = 4) -> DataFrame:
    """One entry for each distinct text of rows (from digests), after `bits` rounds over 2**bits runs: IDENTITY, BETTER, group_size."""
    entries = materialize(first_runs(rows, 1 << bits), "runs")
    waiting = [entries.filter(F.bit_count("run") == k) for k in range(bits + 1)]
    arrived = waiting[bits]
    for k in range(bits, 0, -1):
        parent = F.col("run").bitwiseAND(F.col("run") - 1)
        arrived = merge(arrived.withColumn("run", parent).unionByName(waiting[k - 1]))
    return arrived.drop("run")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: int = 1000, digest: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chars (of the original text).

    Texts are equal when they are identical without white space; null counts as empty.  Of equal texts the one with
    the most code points stays, then the one of the smallest id; null ids come last.  kept is true for the row
    that stays; of rows that repeat both id and text, exactly one.  Texts of any length are read whole.  An empty table
    gives no rows; other columns of docs are not read, whatever they are called.

    Rows of the `common` largest groups are not shuffled, so however many copies a text has, they stay where they are.
    """
    rows = materialize(digests(docs, id_col, text_col, digest), "digests")
    groups = materialize(tree_merge(rows), "digest-groups").select(*IDENTITY, "keep_id", "group_size", (-F.col("minus")).alias("most"))
    both = join_groups(rows, groups, IDENTITY, "group_size", common=common).withColumn("text_sha256", F.lower(F.hex("sha")))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("most"))
    # only rows that may stay are numbered, so that a group's many copies never meet
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_chars"]
    kept = both.filter(stays).groupBy("doc_id", "keep_id", "group_size", "text_sha256", "n_chars").agg(F.count("*").alias("times"))
    kept = spread(kept, F.lit(1).cast("long"), F.col("times"), "k")
    return kept.withColumn("kept", F.col("k") == 1).select(names).unionByName(both.filter(~stays).withColumn("kept", F.lit(False)).select(names))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_groups keeps, all columns, whatever they are called; of rows that repeat both id and text, one.

    Null and empty texts are equal, so one row of them stays; rows without id go where an equal text has one.  Texts
    are compared whole.  Of rows that repeat id and text but differ in other columns any one stays.  An empty table
    gives no rows.
    """
    plain, restore = coded(docs)
    key, text = plain[f"__c{docs.columns.index(id_col)}"], plain[f"__c{docs.columns.index(text_col)}"]
    groups = exact_groups(docs, id_col, text_col)
    kept = groups.filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), F.col("n_chars").alias("__n"))
    sha, chars = F.sha2(stripped(text).cast("binary"), 256), F.length(F.coalesce(text.cast("string"), F.lit(""))).cast("long")
    chosen = plain.join(kept, key.eqNullSafe(F.col("__id")) & (sha == F.col("__sha")) & (chars == F.col("__n")), "left_semi")
    # rows that repeat are rare, and only then are texts compared for them
    repeats = groups.filter("kept = false and doc_id <=> keep_id").limit(1).count()
    if repeats:
        chosen = chosen.withColumn("__sha", sha).dropDuplicates([f"__c{docs.columns.index(id_col)}", "__sha"]).drop("__sha")
    return restore(chosen)


def exact_sql() -> str:
    """DuckDB SQL for exact_groups over documents of distinct ids."""
    return r"""
WITH a AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
b AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
    CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size
  FROM a)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256, CAST(n AS BIGINT) AS n_chars FROM b"""
