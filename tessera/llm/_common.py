"""Helpers shared by the training-data operators: shared-storage tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side up to which a broadcast hint is given (two longs a row: about 3 MB). Beyond it the join shuffles.
BROADCAST_ROWS = 100_000

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where a local session has none, as in tests."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _LOCAL.setdefault("at", "file://" + tempfile.mkdtemp(prefix="spark-tessera-", dir="/tmp"))
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it again (survives lost executors)."""
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
    """Broadcast hint if ``df`` (materialised, two or three numbers a row) has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the byte-wise path of ``lower``."""
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, up, up.lower()))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component): the smallest node reachable, for every node that is not itself the smallest.

    Each round hooks a node to its smallest smaller neighbour, jumps one pointer and contracts the edges; a
    component's smallest node never hooks, so it ends as the root. Per-node minima are combined before the
    shuffle, so a hub with a third of all edges costs no task more than its share.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    e = materialize(edges.select(low.alias("lo"), high.alias("hi")).where("lo < hi").distinct(), "edges")
    found: DataFrame | None = None
    while not e.isEmpty():
        hook = e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))
        up = hook.select(F.col("node").alias("root"), F.col("root").alias("root2"))
        hook = materialize(hook.join(up, "root", "left").select("node", F.coalesce("root2", "root").alias("root")), "hooks")
        x, y = hook.toDF("lo", "lo2"), hook.toDF("hi", "hi2")
        old_e, old_found = e, found
        moved = e.join(x, "lo", "left").join(y, "hi", "left").select(F.coalesce("lo2", "lo").alias("p"), F.coalesce("hi2", "hi").alias("q"))
        e = materialize(moved.select(F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")).where("lo < hi").distinct(), "edges")
        if found is not None:
            up = hook.toDF("component", "next")
            old = found.join(up, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
            # A node that was contracted onto one which hooked in the same round comes up again: it has its row.
            hook = old.unionByName(hook.join(found.select("node"), "node", "left_anti").toDF("node", "component"))
        found = materialize(hook.toDF("node", "component"), "components")
        discard(old_e)
        if old_found is not None:
            discard(old_found)
    return e.select(F.col("lo").alias("node"), F.col("hi").alias("component")) if found is None else found
