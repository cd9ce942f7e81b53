"""Running totals and neighbours over a global order without moving all rows to one task.

Rows are dealt into buckets that follow the order.  Within a bucket a window does the work; across buckets a second
window runs over one row for each bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfare.plans.storage import materialize, tasks


def running_total(df: DataFrame, bucket: Column, order: str, value: str, name: str) -> DataFrame:
    """df with the sum of value over all rows up to and including each one, in the order of the distinct column `order`.

    bucket must not fall as order rises.
    """
    marked = df.withColumn("__bucket", bucket)
    sums = marked.groupBy("__bucket").agg(F.sum(value).alias("__sum"))
    before = W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    inside = W.partitionBy("__bucket").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return marked.withColumn("__inside", F.sum(value).over(inside)).join(offsets, "__bucket").withColumn(name, F.col("__inside") + F.col("__offset")).drop("__bucket", "__inside", "__offset")


def with_next(df: DataFrame, bucket: Column, order: list[str], value: str, name: str) -> DataFrame:
    """df with the value of the row that follows in the total order by `order`; null for the last row.

    bucket must not fall along the order.
    """
    marked = df.withColumn("__bucket", bucket)
    first = marked.groupBy("__bucket").agg(F.min(F.struct(*order, value)).alias("__first"))
    following = first.select("__bucket", F.lead(F.col(f"__first.{value}")).over(W.orderBy("__bucket")).alias("__after"))
    inside = W.partitionBy("__bucket").orderBy(*order)
    numbered = marked.withColumn("__next", F.lead(value).over(inside)).withColumn("__last", F.lead(F.lit(True)).over(inside).isNull())
    return numbered.join(following, "__bucket").withColumn(name, F.when(F.col("__last"), F.col("__after")).otherwise(F.col("__next"))).drop("__bucket", "__next", "__last", "__after")


def in_ranges(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """df written down in ranges of the order, with the number of each row's range as __range, which does not fall along it."""
    return materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), label)


def running(
    df: DataFrame, keys: list[str], fine: Column, order: list[str | Column], sums: dict[str, Column],
    wholes: dict[str, str] | None = None, least: dict[str, Column] | None = None, earlier: dict[str, Column] | None = None,
) -> DataFrame:
    """df with running sums inside each group of keys, in the order by `order`, up to and including each row.

    sums gives what is added up, by the new columns' names, least what the least value so far is wanted of, earlier
    what the least value before the row is wanted of; wholes names, for some of sums, a column of the group's whole
    sum.  fine must not fall along the order: rows that agree in keys and fine are summed by one task, and a group by
    what its parts come to, so no task needs a whole group.
    """
    earlier = earlier or {}
    least = (least or {}) | earlier
    marked = df.withColumn("__fine", fine)
    totals = [F.sum(v).alias(f"__sum_{c}") for c, v in sums.items()] + [F.min(v).alias(f"__min_{c}") for c, v in least.items()]
    parts = marked.groupBy(*keys, "__fine").agg(*totals)
    group = W.partitionBy(*keys)
    before = group.orderBy("__fine").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        *keys, "__fine",
        *[F.coalesce(F.sum(f"__sum_{c}").over(before), F.lit(0)).alias(f"__before_{c}") for c in sums],
        *[F.min(f"__min_{c}").over(before).alias(f"__before_{c}") for c in least],
        *[F.sum(f"__sum_{c}").over(group).alias(whole) for c, whole in (wholes or {}).items()],
    )
    inside = W.partitionBy(*keys, "__fine").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    above = W.partitionBy(*keys, "__fine").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = [F.sum(v).over(inside).alias(f"__own_{c}") for c, v in sums.items()] + [F.min(v).over(above if c in earlier else inside).alias(f"__own_{c}") for c, v in least.items()]
    met = marked.select("*", *own).join(offsets, [*keys, "__fine"])
    added = [(F.col(f"__own_{c}") + F.col(f"__before_{c}")).alias(c) for c in sums] + [F.least(f"__own_{c}", f"__before_{c}").alias(c) for c in least]
    return met.select(*df.columns, *added, *(wholes or {}).values())


#: Rows of a group that a single task sorts, at most.
GROUP = 1 << 16
#: Rows of small groups that a task gets, about; of a build that sorts once.
DEALT = 1 << 19

#: Running values inside groups: (df, keys, order, sums, wholes, least, earlier), as in running.
Running = Callable[..., DataFrame]


def windowed(
    df: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, Column],
    wholes: dict[str, str] | None = None, least: dict[str, Column] | None = None, earlier: dict[str, Column] | None = None,
) -> DataFrame:
    """What running gives, by windows over whole groups, for groups that are small."""
    group = W.partitionBy(*keys)
    ordered = group.orderBy(*order)
    so_far, above = ordered.rowsBetween(W.unboundedPreceding, 0), ordered.rowsBetween(W.unboundedPreceding, -1)
    found = [F.sum(v).over(so_far).alias(c) for c, v in sums.items()]
    found += [F.min(v).over(so_far).alias(c) for c, v in (least or {}).items()] + [F.min(v).over(above).alias(c) for c, v in (earlier or {}).items()]
    return df.select("*", *found, *[F.sum(sums[c]).over(group).alias(whole) for c, whole in (wholes or {}).items()])


def ranged(df: DataFrame, keys: list[str], order: list[str | Column], *rest: object, **more: object) -> DataFrame:
    """What running gives, over ranges that are cut where the rows themselves lie, whatever their values; for large groups."""
    return running(in_ranges(df, [*keys, *order], "ranges"), keys, F.col("__range"), order, *rest, **more).drop("__range")


def by_size(df: DataFrame, keys: list[str], build: Callable[[DataFrame, Running], DataFrame], dealt: int = DEALT) -> DataFrame:
    """build of df's groups: with windows over whole groups of at most GROUP rows, with ranges for the larger ones.

    build takes rows and how it is to find running values in them; no group may depend on another.  The small groups are
    dealt among tasks of about `dealt` rows: with a number of tasks that rows don't raise, what a task sorts would grow
    with the input, once for each sort of a build.
    """
    groups = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    found = groups.agg(F.sum("__n").alias("rows"), F.max("__n").alias("most")).first()
    parts = tasks(df.sparkSession, found.rows or 0, dealt)
    if (found.most or 0) <= GROUP:
        return build(df.repartition(parts, *keys), windowed)
    large = materialize(groups.filter(F.col("__n") > GROUP).select(*keys), "large-groups")
    small = df.join(large, keys, "left_anti").repartition(parts, *keys)
    return build(small, windowed).unionByName(build(materialize(df.join(large, keys, "left_semi"), "large"), ranged))


def spread(df: DataFrame, first: Column, last: Column, name: str, block: int = 1 << 16) -> DataFrame:
    """df with a row for each number from first to last; made block by block, so no row holds a long array."""
    begun = df.withColumn("__last", last).withColumn("__begin", F.explode(F.sequence(first, last, F.lit(block).cast("long"))))
    return begun.withColumn(name, F.explode(F.sequence(F.col("__begin"), F.least(F.col("__begin") + F.lit(block - 1), F.col("__last"))))).drop("__begin", "__last")
