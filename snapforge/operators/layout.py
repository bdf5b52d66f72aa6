"""Disk layouts as data: partition tables, what a partition is, file system parameters, and image sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SECTOR = 512
#: Type GUIDs; fixed values.
BIOS_BOOT = "21686148-6449-6e6f-744e-656564454649"
EFI_SYSTEM = "c12a7328-f81f-11d2-ba4b-00a0c93ec93b"
LINUX_SWAP = "0657fd6d-a4ab-43c4-84e5-0933c84b4f4f"
_SFDISK = "struct<partitiontable: struct<label: string, id: string, device: string, sectorsize: long, partitions: array<struct<node: string, start: long, size: long, type: string, uuid: string, name: string>>>>"


def parse(layouts: DataFrame, column: str = "sfdisk") -> DataFrame:
    """(image_id, scheme, number, partition_guid, type_guid, name, start_lba, end_lba, size_bytes, flags) from the JSON of a
    partition tool. Only gpt and dos labels; others give no row."""
    table = layouts.withColumn("t", F.from_json(column, _SFDISK).getField("partitiontable")).where(F.col("t.label").isin("gpt", "dos"))
    rows = table.select("image_id", F.col("t.label").alias("label"), F.coalesce("t.sectorsize", F.lit(SECTOR)).alias("sector"), F.explode("t.partitions").alias("p"))
    number = F.coalesce(F.regexp_extract("p.node", r"(\d+)$", 1).try_cast("int"), F.lit(1))
    gpt = F.col("label") == "gpt"
    return rows.select("image_id", F.when(gpt, "gpt").otherwise("mbr").alias("scheme"), number.alias("number"), F.lower("p.uuid").alias("partition_guid"), F.when(gpt, F.lower("p.type")).alias("type_guid"), F.col("p.name").alias("name"), F.col("p.start").alias("start_lba"), (F.col("p.start") + F.col("p.size") - 1).alias("end_lba"), (F.col("p.size") * F.col("sector")).alias("size_bytes"), F.lit(0).cast("long").alias("flags"))


def classify(type_guid, probed_fs=None) -> Column:
    """bios_boot, raw, or fs:<type>; ``probed_fs`` is what a probe said of partitions of other types."""
    g = F.lower(F.col(type_guid))
    probe = F.col(probed_fs) if probed_fs else F.lit(None).cast("string")
    fs = F.when(probe.isin("", "swap"), None).otherwise(probe)
    return F.when(g == BIOS_BOOT, "bios_boot").when(g == LINUX_SWAP, "raw").when(g == EFI_SYSTEM, "fs:vfat").when(fs.isNotNull(), F.concat(F.lit("fs:"), fs)).otherwise("raw")


def image_size(partitions: DataFrame) -> DataFrame:
    """(image_id, image_bytes): up to the backup table behind the last partition, in whole MiB."""
    end = F.coalesce(F.max("end_lba"), F.lit(2047))
    mib = 1 << 20
    return partitions.groupBy("image_id").agg((F.ceil((end + 34) * SECTOR / F.lit(float(mib))) * mib).cast("long").alias("image_bytes"))


def fs_params(probes: DataFrame) -> DataFrame:
    """(image_id, params map) from (image_id, fs_type, output): what is needed to make a like file system."""
    out = F.col("output")

    def first(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(out, pattern, 1), F.lit(""))

    known = {
        "xfs": {"block_size": r"data\s+=\s*bsize=(\d+)", "inode_size": r"isize=(\d+)", "sector_size": r"sectsz=(\d+)", "crc": r"crc=(\d)", "reflink": r"reflink=(\d)"},
        "ext4": {"block_size": r"Block size:\s+(\d+)", "inode_size": r"Inode size:\s+(\d+)", "uuid": r"Filesystem UUID:\s+(\S+)", "label": r"Filesystem volume name:\s+(\S+)"},
        "vfat": {"fat_size": r"FAT \((\d+) bit\)|FAT(\d+)", "sector_size": r"(\d+) bytes per logical sector", "cluster_size": r"(\d+) bytes per cluster"},
    }
    params = None
    for kind, fields in known.items():
        m = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in fields]), F.array(*[first(p) for p in fields.values()])), lambda k, v: v.isNotNull())
        params = F.when(F.col("fs_type") == kind, m) if params is None else params.when(F.col("fs_type") == kind, m)
    return probes.select("image_id", "fs_type", params.alias("params"))


def paired_partitions(base: DataFrame, target: DataFrame) -> DataFrame:
    """(partition_no, in_base): the target's partitions; one without a base partition of its number differs from nothing."""
    t = target.select("partition_no").distinct()
    b = base.select("partition_no").distinct().withColumn("in_base", F.lit(True))
    return t.join(b, "partition_no", "left").select("partition_no", F.coalesce("in_base", F.lit(False)).alias("in_base"))
