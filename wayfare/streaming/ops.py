"""Apply a stream of edge insertions and deletions to a stored graph, batch by batch.

An extension: op-logs are finite files elsewhere.  Each micro-batch is one commit of the store and writes what it
touches; the store's manifest says which batch it has come to, so a batch that is tried again after a failure changes
nothing if it was committed, and is done anew if it was not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators import stored
from wayfare.sources.store import Store


def apply_batch(spark: SparkSession, folder: str, ops: DataFrame, epoch: int, share: float = 0.25) -> Store:
    """The store at folder after a batch of ops (op, src, dst, w): deletes, then inserts; compacted when its changes have grown."""
    store = Store.open(spark, folder)
    if store.facts.get("batch", -1) >= epoch:
        return store
    after = stored.update(store, ops.filter(F.col("op") == "delete"), ops.filter(F.col("op") == "insert"), {"batch": epoch})
    return stored.compact(after, share)


def apply_stream(spark: SparkSession, edges: DataFrame, ops: DataFrame, folder: str) -> DataFrame:
    """The graph after all of ops, a streaming frame of (op, src, dst, w) whose op is `delete` or `insert`.

    In a batch, deletes come before inserts; deletes of edges that don't exist fail the batch.  folder holds the store,
    made of edges if there is none yet, and the stream's checkpoint; a stream that is started again goes on from there.
    """
    at = f"{folder}/store"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/manifests/version=0/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        stored.create(edges, at)
    query = (
        ops.writeStream.foreachBatch(lambda batch, epoch: apply_batch(batch.sparkSession, at, batch, epoch) and None)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stored.edges_of(Store.open(spark, at))
