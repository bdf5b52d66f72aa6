"""Partitions without a file system (boot code, BIOS boot, raw): a region is one blob, deduplicated like files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from snapforge.functions.scalars import sha256
from snapforge.operators import blobs

#: Bytes of boot code before the partition table of a disk; a fixed value.
BOOT_CODE_BYTES = 440


def boot_code(disks: DataFrame) -> DataFrame:
    """(image_id, partition_no 0, kind mbr, content): the first bytes of each disk (image_id, head)."""
    return disks.select("image_id", F.lit(0).alias("partition_no"), F.lit("mbr").alias("kind"), F.substring(F.col("head"), 1, BOOT_CODE_BYTES).alias("content"))


def compress(regions: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, new blobs) of regions (image_id, partition_no, kind, content).

    Records: image_id, partition_no, kind, blob_id, size, stored_bytes (0 where the blob was there). Empty regions have no blob.
    """
    rows = regions.select("image_id", "partition_no", "kind", "content", sha256("content").alias("sha256"), F.octet_length("content").cast("long").alias("size"))
    full = rows.where("size > 0")
    found = blobs.groups(full.select("sha256", F.concat_ws("/", "image_id", F.col("partition_no").cast("string")).alias("path"), "size"), existing)
    ids = found.select("sha256", "blob_id", "is_new")
    records = rows.drop("content").join(ids, "sha256", "left").select("image_id", "partition_no", "kind", "blob_id", "size", F.when(F.col("is_new"), F.col("size")).otherwise(0).alias("stored_bytes"))
    new = full.select("sha256", "content", "size").dropDuplicates(["sha256"]).join(ids.where("is_new"), "sha256").select("sha256", "blob_id", "size", "content")
    return records, new


def decompress(records: DataFrame, stored: DataFrame) -> DataFrame:
    """Regions with content; one without a blob writes nothing (null content)."""
    body = stored.dropDuplicates(["blob_id"]).select("blob_id", "content")
    return records.join(body, "blob_id", "left").select("image_id", "partition_no", "kind", "content")
