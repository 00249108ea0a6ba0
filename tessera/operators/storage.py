"""Tables in the cluster's shared folder: lineage is cut by writing Parquet, which survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where a local session has none, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = at or _LOCAL.setdefault("at", "file://" + tempfile.mkdtemp(prefix="spark-tessera-", dir="/tmp"))
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/tessera/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and nothing needs any more."""
    jvm = df.sparkSession._jvm
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint if ``df`` has at most ``rows`` rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to as many tasks as shuffles have, before work that takes long a row: small files give few tasks. Their
    number is given, so that adaptive plans do not put them together again by their bytes."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n)


#: Rows of a task that gathers groups.
TASK_ROWS = 250_000


def tasks(df: DataFrame, rows: int) -> int:
    """Tasks for so many rows: their number grows with the rows, so that no task's groups do; at least those of shuffles."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS + 1)
