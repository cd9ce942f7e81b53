"""Text and Parquet layouts of graphs, query lists, op-logs, answers and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfare.functions.columns import affinity_rescale


def numbered_lines(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    """file, line (from 0 in each file) and value of text files; with or without blank lines, which then do not count.

    Lines are numbered inside the blocks in which files are read, and blocks by what the ones before hold, so no task
    numbers more than a block.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value"
    )
    lines = lines if blank else lines.filter(F.trim("value") != "")
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = lines.withColumn("own", F.row_number().over(W.partitionBy("file", "block").orderBy("id")) - 1)
    return placed.join(sizes.select("file", "block", before.alias("before")), ["file", "block"]).select("file", (F.col("own") + F.col("before")).cast("long").alias("line"), "value")


def _fields(names: dict[str, str]) -> list[Column]:
    """White-space separated columns of a text line."""
    fields = F.split(F.trim(F.col("value")), r"\s+")
    return [fields[k].cast(kind).alias(name) for k, (name, kind) in enumerate(names.items())]


EDGE = {"src": "long", "dst": "long", "w": "double"}


def read_edges(spark: SparkSession, path: str, rescale: str = "none") -> DataFrame:
    """edges(src, dst, w) of a file of lines `from to weight`; rescale is none or affinity."""
    if rescale not in ("none", "affinity"):
        raise ValueError(f"unknown rescale {rescale}")
    edges = spark.read.text(path).filter(F.trim("value") != "").select(*_fields(EDGE))
    return edges.withColumn("w", affinity_rescale(F.col("w"))) if rescale == "affinity" else edges


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", "src", "dst", "w").alias("value")).write.text(path)


def read_attribute(spark: SparkSession, path: str) -> DataFrame:
    """(n, m) of a file of the two lines `n <n>` and `m <m>`."""
    pairs = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))
    pick = lambda key: F.max(F.when(F.col("f")[0] == key, F.col("f")[1].cast("long"))).alias(key)
    return pairs.agg(pick("n"), pick("m"))


def read_queries(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """queries(query_id, u) of a file with one node a line; blank lines don't count; the first `most` ones."""
    found = numbered_lines(spark, path).select(F.col("line").alias("query_id"), F.trim("value").cast("long").alias("u"))
    return found if most is None else found.filter(F.col("query_id") < most)


def write_queries(queries: DataFrame, path: str) -> None:
    queries.orderBy("query_id").select(F.col("u").cast("string").alias("value")).coalesce(1).write.text(path)


def read_ops(spark: SparkSession, path: str) -> DataFrame:
    """ops(seq, src, dst, w) of an op-log file; its edges are deleted first, in order of seq, and inserted again afterwards."""
    return numbered_lines(spark, path).select(F.col("line").alias("seq"), *_fields(EDGE))


def write_ops(ops: DataFrame, path: str) -> None:
    """An op-log of ops(seq, src, dst, w): one file, in order of seq."""
    ops.coalesce(1).sortWithinPartitions("seq").select(F.concat_ws(" ", "src", "dst", "w").alias("value")).write.text(path)


def write_answers(answers: DataFrame, path: str) -> None:
    """answers(algo, label, L, eps, u, node, p), one folder for each query; probabilities have fifteen decimals."""
    rounded = answers.withColumn("p", F.round("p", 15))
    rounded.write.mode("append").partitionBy("algo", "label", "L", "eps", "u").parquet(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """What write_answers wrote, positive probabilities only."""
    return spark.read.parquet(path).filter("p > 0")


def write_answer_text(answers: DataFrame, path: str) -> None:
    """answers(algo, label, L, eps, u, node, p) as lines `node prob` of fifteen decimals, one folder for each query."""
    line = F.concat_ws(" ", F.col("node").cast("string"), F.format_string("%.15f", "p")).alias("value")
    answers.select("algo", "label", "L", "eps", "u", line).write.mode("append").partitionBy("algo", "label", "L", "eps", "u").text(path)


def read_answer_text(spark: SparkSession, path: str) -> DataFrame:
    """What write_answer_text wrote, positive probabilities only; those that vanish in fifteen decimals are gone."""
    found = spark.read.text(path).select("algo", "label", "L", "eps", "u", *_fields({"node": "long", "p": "double"}))
    return found.filter("p > 0")


#: The dumps of an update report, and the column of update_overhead that each has.
DUMPS = {"time": "seconds", "time_overhead": "overhead", "memory": "memory", "memory_overhead": "memory_overhead"}


def write_dumps(overheads: DataFrame, path: str) -> None:
    """overheads (label, algo, seconds, overhead, memory, memory_overhead) as text, a folder measure=... for each dump of DUMPS.

    A line is `label:[v, v, ...]`, the values in order of the algorithms' names, with nine decimals; one that is
    missing is nan.
    """
    measures = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), F.col(c).alias("v")) for name, c in DUMPS.items()]))
    each = overheads.select("label", "algo", measures.alias("m")).select("label", "algo", "m.measure", F.when(F.col("m.v").isNotNull(), F.format_string("%.9f", "m.v")).otherwise("nan").alias("v"))
    lines = each.groupBy("measure", "label").agg(F.array_sort(F.collect_list(F.struct("algo", "v"))).alias("all"))
    line = F.concat(F.col("label"), F.lit(":["), F.array_join(F.transform("all", lambda x: x.v), ", "), F.lit("]")).alias("value")
    lines.select("measure", line).write.mode("append").partitionBy("measure").text(path)


def append_report(report: DataFrame, path: str) -> None:
    """Append rows of metrics or run times to a CSV folder."""
    report.write.mode("append").option("header", True).csv(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What append_report wrote."""
    return spark.read.schema(schema).option("header", True).csv(path)


#: What the lines of an update log say before the number of seconds of a deletion, of an insertion, or the GB.
LOG_LINES = {"delete": r" new del update time:\s*(\S+)", "insert": r" new add update time:\s*(\S+)", "memory": r"^Total \w+: peak memory:\s*(\S+)"}


def parse_log(spark: SparkSession, path: str) -> DataFrame:
    """file, line, kind (delete, insert or memory) and value (seconds or GB) of update logs; other lines are left out."""
    lines = numbered_lines(spark, path, blank=True)
    cases = [(kind, F.regexp_extract("value", pattern, 1)) for kind, pattern in LOG_LINES.items()]
    kind = F.coalesce(*[F.when(found != "", kind) for kind, found in cases])
    value = F.coalesce(*[F.when(found != "", found) for _, found in cases])
    return lines.select("file", "line", kind.alias("kind"), value.try_cast("double").alias("value")).filter("kind is not null and value is not null")
