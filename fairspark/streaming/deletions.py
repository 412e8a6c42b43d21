"""A stream of client withdrawals over a compact state: an extension, applied in order and once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.training import Compact, delete_clients
from ..sources.states import load_compact, save_compact


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def apply_batch(spark: SparkSession, batch: DataFrame, batch_id: int, path: str) -> Compact:
    """State batch_id + 1 from state batch_id and the clients (client) of a batch, read in the order of request_id. Clients that
    are gone already are passed over, so a repeated batch or request changes nothing."""
    target = f"{path}/state={batch_id + 1}"
    if _exists(spark, f"{target}/state/_SUCCESS"):
        return load_compact(spark, target)
    state = load_compact(spark, f"{path}/state={batch_id}")
    wanted = [r["client"] for r in batch.groupBy("client").agg(F.min("request_id").alias("at")).orderBy("at").collect()]  # clients of one batch
    _, state = delete_clients(state, [c for c in wanted if c in state.counts])
    save_compact(state, target)
    return state


def follow(requests: DataFrame, start: Compact, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Applies a stream (request_id, client) batch by batch; the states stay under path, numbered by batch."""
    spark = requests.sparkSession
    if not _exists(spark, f"{path}/state=0/state/_SUCCESS"):
        save_compact(start, f"{path}/state=0")
    writer = requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, i: apply_batch(spark, batch, i, path) and None)
    return (writer.trigger(**trigger) if trigger else writer).start()
