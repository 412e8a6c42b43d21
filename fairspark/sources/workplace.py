"""The shared folder in which lineage is cut and intermediate tables stand."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: dict[str, object] = {}


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set from spark.checkpoint.dir where it is not yet. A temporary folder serves only
    a session that runs in one process; on a cluster a missing setting is an error."""
    context = spark.sparkContext
    scala = context._jsc.sc()
    if scala.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="fairspark-")
        context.setCheckpointDir(folder)
    return scala.getCheckpointDir().get()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new name below the shared folder; what is written there goes when the program ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def discard(path: str) -> None:
    """Deletes a work folder."""
    spark = _made.pop(path, None)
    if spark is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _discard_all() -> None:
    for path in list(_made):
        try:
            discard(path)
        except Exception:  # noqa: BLE001  the session may be gone
            _made.clear()
