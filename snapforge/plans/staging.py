"""Tables between steps, in the folder that driver and executors share, and the package on the executors."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of the warehouse on a cluster and a temporary one in local mode."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        local = sc.master.startswith("local[") or sc.master == "local"
        found = "file://" + tempfile.mkdtemp(prefix="snapforge-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_staging"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """``df`` written and read again: plans of loops stay short, and lost executors cost no more than a read."""
    path = f"{folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables of staged() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_staged", None):
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let executors import this package even where the driver's folder is not on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        for where, _, names in os.walk(root):
            for n in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(where, n)
                z.write(full, os.path.join(os.path.basename(root), os.path.relpath(full, root)))
    path = os.path.join(tempfile.mkdtemp(prefix="snapforge-"), "snapforge.zip")  # code, which Spark sends on, not data
    with open(path, "wb") as f:
        f.write(body.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
