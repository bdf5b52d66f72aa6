"""What the operators share: scratch tables, code shipping, Arrow helpers, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from snapforge.plans.staging import ship

#: Text bytes that a Python worker handles at once; bounds its memory whatever the batch holds.
CHUNK_BYTES = 2_000_000
#: Rows of an Arrow batch; texts may be long, so that a batch of the default 10,000 may not fit.
BATCH_ROWS = 512

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.getCheckpointDir():
        if sc.master.startswith("local[") or sc.master == "local":
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="snapforge-ckpt-"))
        else:
            sc.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch")
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with its scheme, as Spark's default file system gives it where it has none."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(folder)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toString()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and lost executors cost no more than a read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")  # the plan's shuffle files go with its end, as nothing reads them any more
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame of written()."""
    path = getattr(df, "_scratch", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with small batches and the package at hand on the executors."""
    spark = df.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.mapInArrow(fn, schema)


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``limit`` bytes of one string or binary column, a row at least."""
    n = batch.num_rows
    if not n:
        return
    sizes = _lengths(batch.column(column))
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right"))
        to = max(at + 1, min(to, n))
        yield batch.slice(at, to - at)
        at = to


def _lengths(col: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)


def ragged_take(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenation of flat[s : s + n] for all s, n."""
    total = int(lens.sum(dtype=np.int64))
    if not total:
        return flat[:0]
    kind = np.int32 if max(total, len(flat)) < 1 << 30 else np.int64  # less memory to go through
    before = np.cumsum(lens, dtype=kind) - lens.astype(kind)
    return flat[np.repeat(starts.astype(kind) - before, lens) + np.arange(total, dtype=kind)]


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with edges a-b: the smallest node that each reaches."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b: longs), root being the smallest node of its component.

    Alternating large-star and small-star steps. Each round is written to the shared folder, so lineage stays short;
    the driver sees two numbers a round. A node with very many neighbours is a hot join key on the side of the edges only;
    the other side, a row for each node, is written first, so that both come straight from a shuffle and adaptive
    execution can split the hot one.
    """
    e = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    mark = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), name)
        large = written(both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), name)
        small_min = written(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(small_min, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").where("u <> v").distinct()
        new = written(small, name)
        for done in (e, m, large, small_min):
            discard(done)
        e = new
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components are not finished after {rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    return out
