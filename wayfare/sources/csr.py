"""Compressed sparse rows: as tables, and as a data source over raw binary files.

The binary layout is four files: `<label>.attribute` with the lines `n <n>` and `m <m>`, `.outPtr` with n + 1 unsigned
32-bit numbers, `.outEdges` with m of them and `.outWEdges` with m doubles, all little-endian.  Each of the last three
may be a folder of parts instead, named by their first vertex; one after the other they are the file.  Parts are written
and read by tasks, so the folder must be one that all executors share.

A write is committed by `<label>.parts`, which lists the parts that count and takes its place at once when all tasks
have ended; only then do the parts of an earlier write go.  Files of tasks that failed or were tried again are in no
list, and a write that breaks off leaves what was there.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from wayfare.plans.ordered import by_size, running_total, spread

#: Vertices of one bucket of the running total.
BUCKET = 1 << 16


def out_ptr(edges: DataFrame, n: int) -> DataFrame:
    """ptr(src, ptr) for src from 0 to n: how many edges leave vertices below src."""
    degree = edges.groupBy("src").agg(F.count("*").alias("deg"))
    vertices = edges.sparkSession.range(-1, n).select((F.col("id") + 1).alias("src"), F.col("id").alias("prev"))
    counted = vertices.join(degree.withColumnRenamed("src", "prev"), "prev", "left").select("src", F.coalesce("deg", F.lit(0)).alias("deg"))
    return running_total(counted, F.floor(F.col("src") / BUCKET), "src", "deg", "ptr").select("src", F.col("ptr").cast("long").alias("ptr"))


def csr_edges(edges: DataFrame) -> DataFrame:
    """edges with pos, their place in the adjacency of src in order of dst."""
    placed = by_size(edges, ["src"], lambda rows, running: running(rows, ["src"], ["dst", "w"], {"pos": F.lit(1).cast("long")}))
    return placed.withColumn("pos", (F.col("pos") - 1).cast("int"))


def placed_edges(edges: DataFrame, n: int) -> DataFrame:
    """The flat edge arrays: idx (the global place), dst, w."""
    return csr_edges(edges).join(out_ptr(edges, n), "src").select((F.col("ptr") + F.col("pos")).alias("idx"), "dst", "w")


def from_flat(flat: DataFrame, ptr: DataFrame) -> DataFrame:
    """edges(src, pos, dst, w) of the flat arrays and pointers.

    A vertex owns the places from its pointer up to the next one.  These are spelled out, so that the join is an
    equi-join on the place.
    """
    # ptr has one row for each vertex and one more; the next pointer is that of src + 1
    upper = ptr.select((F.col("src") - 1).alias("src"), F.col("ptr").alias("upper"))
    owned = ptr.join(upper, "src").filter("upper > ptr")
    places = spread(owned.select("src", "ptr", "upper"), F.col("ptr"), F.col("upper") - 1, "idx").drop("upper")
    return flat.join(places, "idx").select("src", (F.col("idx") - F.col("ptr")).cast("int").alias("pos"), "dst", "w")


def local_path(folder: str) -> str:
    """The path of a folder that tasks can open: one without a scheme, or with file:."""
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError(f"{folder} is not a folder of a shared file system")
    return folder.removeprefix("file://").removeprefix("file:")


ENDINGS = ("outPtr", "outEdges", "outWEdges")


@dataclass
class Written(WriterCommitMessage):
    """The parts of a task, by first vertex and mark, and how many edges they have."""

    parts: list[tuple[int, str]]
    edges: int


class CsrWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.at, self.n = os.path.join(local_path(options["path"]), options["label"]), int(options["n"])
        if not overwrite and os.path.exists(f"{self.at}.attribute"):
            raise ValueError(f"{self.at} exists already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Write the parts of rows (first, kind, src, pos, ptr, dst, w), sorted by the first four.

        first is the part's first vertex; kind is 0 for a pointer, ptr of src, and 1 for an edge.
        """
        mark, out, first, files = uuid.uuid4().hex, Written([], 0), None, {}

        def close() -> None:
            for f in files.values():
                f.close()

        for ending in ENDINGS:
            os.makedirs(f"{self.at}.{ending}", exist_ok=True)
        for batch in iterator:
            column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            firsts, kinds = column["first"].to_numpy(), column["kind"].to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(firsts) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(firsts)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if firsts[lo] != first:
                    close()
                    first = int(firsts[lo])
                    out.parts.append((first, mark))
                    files = {ending: open(f"{self.at}.{ending}/{part_name(first, mark)}", "wb") for ending in ENDINGS}
                own = {name: c.slice(lo, hi - lo) for name, c in column.items()}
                if kinds[lo] == 0:
                    files["outPtr"].write(own["ptr"].to_numpy().astype("<u4").tobytes())
                else:
                    files["outEdges"].write(own["dst"].to_numpy().astype("<u4").tobytes())
                    files["outWEdges"].write(own["w"].to_numpy().astype("<f8").tobytes())
                    out.edges += hi - lo
        close()
        return out

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        parts = sorted(p for m in done for p in m.parts)
        replace(f"{self.at}.attribute", f"n {self.n}\nm {sum(m.edges for m in done)}\n")
        replace(f"{self.at}.parts", json.dumps({"n": self.n, "parts": parts}))
        self._remove(lambda name: name not in {part_name(*p) for p in parts})

    def abort(self, messages: list[Written | None]) -> None:
        own = {part_name(*p) for m in messages if m is not None for p in m.parts}
        self._remove(lambda name: name in own)

    def _remove(self, goes: Callable[[str], bool]) -> None:
        for ending in ENDINGS:
            for name in filter(goes, os.listdir(f"{self.at}.{ending}") if os.path.isdir(f"{self.at}.{ending}") else []):
                os.remove(f"{self.at}.{ending}/{name}")


def part_name(first: int, mark: str) -> str:
    return f"part-{first:012d}-{mark}"


def replace(path: str, text: str) -> None:
    """Write a small file so that it takes its place at once."""
    with open(f"{path}.{uuid.uuid4().hex}", "w", encoding="ascii") as f:
        f.write(text)
    os.replace(f.name, path)


def write_binary(edges: DataFrame, n: int, folder: str, label: str, vertices: int = 1 << 20) -> None:
    """Write the binary layout in parts of so many vertices, each by one task, in place of what the label had before.

    folder is one that all executors share.
    """
    spark = edges.sparkSession
    os.makedirs(local_path(folder), exist_ok=True)
    first = lambda c: (F.floor(c / F.lit(vertices)) * vertices).cast("long").alias("first")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    # the last of the n + 1 pointers goes to the last vertex's part
    pointers = out_ptr(edges, n).select(first(F.least(F.col("src"), F.lit(max(n - 1, 0)))), F.lit(0).alias("kind"), "src", F.lit(0).cast("long").alias("pos"), "ptr", *none("long", "dst"), *none("double", "w"))
    placed = csr_edges(edges).select(first(F.col("src")), F.lit(1).alias("kind"), "src", F.col("pos").cast("long").alias("pos"), *none("long", "ptr"), "dst", "w")
    rows = pointers.unionByName(placed).repartition("first").sortWithinPartitions("first", "kind", "src", "pos")
    spark.dataSource.register(CsrDataSource)
    rows.write.format("csr_graph").mode("overwrite").option("label", label).option("n", n).save(folder)


class CsrRange(InputPartition):
    """Vertices from begin to end; part is the part that they are, if there are parts."""

    def __init__(self, begin: int, end: int, part: str = ""):
        self.begin, self.end, self.part = begin, end, part


class CsrReader(DataSourceReader):
    def __init__(self, options: dict):
        self.at = os.path.join(local_path(options["path"]), options["label"])
        self.step = int(options.get("vertices", 1 << 20))

    def partitions(self) -> list[InputPartition]:
        with open(f"{self.at}.attribute", encoding="ascii") as f:
            n = int(dict(line.split() for line in f if line.strip())["n"])
        if os.path.exists(f"{self.at}.parts"):
            with open(f"{self.at}.parts", encoding="ascii") as f:
                written = json.load(f)
            parts, n = written["parts"], written["n"]
            ends = [p[0] for p in parts[1:]] + [n]
            return [CsrRange(first, end, part_name(first, mark)) for (first, mark), end in zip(parts, ends, strict=True)] or [CsrRange(0, 0)]
        return [CsrRange(k, min(k + self.step, n)) for k in range(0, n, self.step)] or [CsrRange(0, 0)]

    def read(self, partition: CsrRange) -> Iterator[pa.RecordBatch]:
        many = partition.end - partition.begin
        if many <= 0:
            return
        path = lambda ending: os.path.join(f"{self.at}.{ending}", partition.part) if partition.part else f"{self.at}.{ending}"
        with open(path("outPtr"), "rb") as f:
            f.seek(0 if partition.part else 4 * partition.begin)
            ptr = np.frombuffer(f.read(4 * (many + 1)), dtype="<u4").astype(np.int64)
        if len(ptr) == many:
            # a part ends where its edges end
            ptr = np.append(ptr, ptr[0] + os.path.getsize(path("outEdges")) // 4)
        skip = 0 if partition.part else int(ptr[0])
        with open(path("outEdges"), "rb") as f, open(path("outWEdges"), "rb") as g:
            f.seek(4 * skip)
            g.seek(8 * skip)
            for k in range(0, many, 4096):
                own = ptr[k : k + 4097]
                m = int(own[-1] - own[0])
                if not m:
                    continue
                dst = np.frombuffer(f.read(4 * m), dtype="<u4").astype(np.int64)
                w = np.frombuffer(g.read(8 * m), dtype="<f8")
                degree = np.diff(own)
                src = np.repeat(np.arange(partition.begin + k, partition.begin + k + len(degree)), degree)
                pos = np.arange(own[0], own[-1]) - np.repeat(own[:-1], degree)
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(pos.astype(np.int32)), pa.array(dst), pa.array(w)], names=["src", "pos", "dst", "w"])


class CsrDataSource(DataSource):
    """spark.read.format("csr_graph").option("label", ...).load(folder), after spark.dataSource.register(CsrDataSource)."""

    @classmethod
    def name(cls) -> str:
        return "csr_graph"

    def schema(self) -> str:
        return "src long, pos int, dst long, w double"

    def writer(self, schema: object, overwrite: bool) -> CsrWriter:
        return CsrWriter(dict(self.options), overwrite)

    def reader(self, schema: object) -> DataSourceReader:
        return CsrReader(dict(self.options))


def read_binary(spark: SparkSession, folder: str, label: str) -> DataFrame:
    """edges(src, pos, dst, w) of the binary layout; one task for each range of vertices."""
    spark.dataSource.register(CsrDataSource)
    return spark.read.format("csr_graph").option("label", label).load(folder)
