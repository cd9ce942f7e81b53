"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wayfare.plans.storage import materialize

__all__ = ["batched", "bounded_sample", "coded", "id_fold", "join_groups", "map_texts", "materialize", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a session says of the bytes that rows have on their way to Python at once, and what it says from here on if it says nothing.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def batched(df: DataFrame) -> DataFrame:
    """df, of whose texts a Python worker gets some megabytes at a time, or one text, however long the texts are.

    Spark's own bound is 10 000 rows and 64 MB, which the executor holds as often as it has cores, the worker twice.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH, None) is None:
        conf.set(BATCH, BATCH_BYTES)
    return df


def id_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus: the split into learning and held-out rows."""
    return F.crc32(doc_id.cast("string")) % F.lit(modulus)


def map_texts(
    df: DataFrame,
    keys: list[str],
    text: str,
    make: Callable[[], Callable[[bytes | None], tuple]],
    schema: str,
) -> DataFrame:
    """Rows of (keys, what a text gives), a batch of whole texts at a time.

    make() runs once in each Python worker task and returns the function of one text's UTF-8 bytes
    (None for a null).  schema names the columns of that function's tuple; they follow the keys.
    """
    chosen = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").cast("string").cast("binary").alias("__text"))
    key_part = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    full = f"{key_part}, {schema}" if key_part else schema
    fields = df.sparkSession.createDataFrame([], schema).schema.fields
    names, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_text = make()
        for batch in batches:
            rows = [of_text(t.as_py()) for t in batch.column(len(keys))]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keys))] + [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)],
                names=[*keys, *names],
            )

    return batched(chosen).mapInArrow(run, full)


def bounded_sample(rows: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most `most` of rows, those of the smallest hashes of their ids; rows whose id repeats are not taken.

    Only so many hashes are broadcast; the texts stay where they are.
    """
    hashed = F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.lit("sample"))
    once = rows.select(F.col(f"`{id_col}`").alias("__id"), hashed.alias("__h")).groupBy("__id", "__h").agg(F.count("*").alias("__n"))
    first = once.filter("__n = 1").orderBy("__h", "__id").limit(most).select("__id")
    return rows.join(F.broadcast(first), F.col(f"`{id_col}`") == F.col("__id"), "left_semi")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner", common: int = 1000) -> DataFrame:
    """rows joined (inner or left) with groups, which have one row for each of keys and, in column size, how many rows it meets.

    The `common` largest groups are broadcast, as their number is fixed; their rows need no shuffle, so however many
    rows a group has, they stay where they are.  rows is read twice and so should be a written table.  Null keys meet
    nothing.
    """
    hot = groups.orderBy(F.desc(size), *keys).limit(common).withColumn("__hot", F.lit(True))
    met = rows.join(F.broadcast(hot), keys, "left")
    rest = met.filter(F.col("__hot").isNull()).select(*rows.columns).join(groups, keys, how)
    return met.filter("__hot").select(*rest.columns).unionByName(rest)


def coded(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with its columns called __c0, __c1, ..., and what gives such a frame their names back.

    So columns that an operator adds on the way never clash with the user's.
    """
    names = docs.columns
    back = lambda df: df.select(*[F.col(f"__c{k}").alias(c) for k, c in enumerate(names)])
    return docs.select(*[F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(names)]), back
