"""Tables written between the steps of a job, so that lineage stays short and lost executors cost little."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: What has been written, by application: paths of tables (none if they are to stay), and names of those in the catalog.
_written: dict[str, list[tuple[str | None, str | None]]] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where that is unset and Spark is local, as in tests, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='wayfare-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append((path, None))
    return path


def clear(spark: SparkSession) -> None:
    """Remove all that new_path, materialize and bucketed have written for this application.

    Frames that read it are of no use afterwards, so results must have been written elsewhere before.
    """
    context = spark.sparkContext
    for path, name in _written.pop(context.applicationId, []):
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        if not path:
            continue
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession, rows: int, each: int) -> int:
    """Among how many tasks rows are dealt, so that each gets about `each` of them at most, however many there are.

    Fewer are dealt among all cores, as long as these get some 16 000.
    """
    return max(-(-rows // each), min(spark.sparkContext.defaultParallelism, rows >> 14), 1)


def bucketed(df: DataFrame, keys: list[str], label: str, buckets: int | None = None) -> DataFrame:
    """Write df as a table dealt into buckets by keys and sorted by them within, and read it back.

    A join on exactly these keys then moves the other side only, however often it is repeated.  Unless their number is
    given there are as many buckets as shuffle partitions, so that the two fit each other.  What is dealt so already
    isn't moved.
    """
    path = new_path(df.sparkSession, label)
    return df.sparkSession.table(_write_buckets(df, keys, path, f"{label}-{path.rpartition('-')[2]}", buckets))


def _named(spark: SparkSession, name: str) -> str:
    """name as a table of the catalog, which clear will drop."""
    name = name.replace("-", "_")
    _written.setdefault(spark.sparkContext.applicationId, []).append((None, name))
    return name


def _write_buckets(df: DataFrame, keys: list[str], path: str, name: str, buckets: int | None = None) -> str:
    spark, name = df.sparkSession, _named(df.sparkSession, name)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one task for each bucket, so that a bucket is one file
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
    return name


def write_buckets(df: DataFrame, keys: list[str], path: str) -> int:
    """Write df at path, dealt into buckets by keys and sorted by them within; how many buckets there are."""
    _write_buckets(df, keys, path, f"written-{uuid.uuid4().hex}")
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def open_buckets(spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int) -> DataFrame:
    """What write_buckets wrote, in this session or another; nothing is read or written by opening it."""
    name, by = _named(spark, f"opened-{uuid.uuid4().hex}"), ", ".join(keys)
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
