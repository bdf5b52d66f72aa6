"""The target from the base and the records: (base without old paths) with additions, changes and renames.

Relational all through: content travels as its hash. ``with_content`` joins bytes back, by hash, where a real tree or a
decoded patch is wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from snapforge.functions.scalars import device

_ENTRY = ["partition_no", "path", "entry_type", "mode", "uid", "gid", "mtime", "size", "sha256", "link_target", "dev", "ino", "nlink", "rdev"]


def copied(base: DataFrame, records: DataFrame) -> DataFrame:
    """Entries of the base that no record touches."""
    old = records.where("old_path is not null").select("partition_no", F.col("old_path").alias("path"))
    return base.join(old, ["partition_no", "path"], "left_anti")


def rebuilt(base: DataFrame, records: DataFrame, contents: DataFrame) -> DataFrame:
    """Entries of the target.

    contents: (partition_no, path, sha256, size) that blobs and decoded patches give, for records that have any.
    A file with a link_target is a hard link to that path. A record without new content keeps its base's; a field without a value keeps the base's; a hard link takes size and
    hash of its canonical entry, be that new, renamed, touched in its metadata alone, or not at all.
    """
    live = records.where("new_path is not null").withColumn("path", F.col("new_path"))
    old = base.select("partition_no", F.col("path").alias("old_path"), F.struct(*[c for c in _ENTRY if c not in ("partition_no", "path")]).alias("o"))
    got = contents.select("partition_no", "path", F.col("sha256").alias("c_sha256"), F.col("size").alias("c_size"))
    full = live.join(old, ["partition_no", "old_path"], "left").join(got, ["partition_no", "path"], "left")
    # what a link's canonical file holds: new content, else that of the base file it stands for
    touched = live.where("entry_type = 'file'").select("partition_no", "path", "old_path").join(old.select("partition_no", "old_path", F.col("o.sha256").alias("o_sha256"), F.col("o.size").alias("o_size")), ["partition_no", "old_path"], "left").join(got, ["partition_no", "path"], "left")
    files = touched.select("partition_no", F.col("path").alias("link_to"), F.coalesce("c_sha256", "o_sha256").alias("h_sha256"), F.coalesce("c_size", "o_size").alias("h_size"))
    same = copied(base, records).where("entry_type = 'file'").select("partition_no", F.col("path").alias("link_to"), F.col("sha256").alias("h_sha256"), F.col("size").alias("h_size"))
    wanted = live.where("entry_type = 'hardlink'").select("partition_no", "link_to").distinct()
    hard = files.unionByName(same).join(wanted, ["partition_no", "link_to"], "left_semi")
    full = full.join(hard, ["partition_no", "link_to"], "left")
    kind = F.when(F.col("entry_type") == "hardlink", "file").otherwise(F.col("entry_type"))
    is_file = kind == "file"
    bits = F.when(kind == "file", 0o100000).when(kind == "directory", 0o040000).when(kind == "symlink", 0o120000).otherwise(F.coalesce("file_type_bits", F.col("o.mode").bitwiseAND(0o170000)))
    rdev = device("major", "minor")
    made = full.select(
        "partition_no",
        "path",
        kind.alias("entry_type"),
        F.coalesce("mode", F.col("o.mode").bitwiseAND(0o7777)).bitwiseAND(0o7777).bitwiseOR(bits).alias("mode"),
        *[F.coalesce(c, F.col(f"o.{c}")).alias(c) for c in ("uid", "gid", "mtime")],
        F.when(is_file, F.coalesce("c_size", "h_size", "o.size")).otherwise(0).cast("long").alias("size"),
        F.when(is_file, F.coalesce("c_sha256", "h_sha256", "o.sha256")).alias("sha256"),
        F.when(kind == "symlink", F.coalesce("link_to", "o.link_target")).when(F.col("entry_type") == "hardlink", F.col("link_to")).alias("link_target"),
        F.coalesce("o.dev", F.lit(0)).alias("dev"),
        F.coalesce("o.ino", F.lit(0)).alias("ino"),
        F.coalesce("o.nlink", F.lit(1)).alias("nlink"),
        F.when(kind == "special", F.coalesce(rdev, "o.rdev")).otherwise(0).cast("long").alias("rdev"),
    )
    return copied(base, records).select(*_ENTRY).unionByName(made)


def with_content(entries: DataFrame, blobs: DataFrame) -> DataFrame:
    return entries.join(blobs.select("sha256", "content"), "sha256", "left")


def decompression_stats(records: DataFrame, contents: DataFrame) -> DataFrame:
    live = records.where("new_path is not null and entry_type <> 'directory'").join(contents.select("partition_no", F.col("path").alias("new_path"), F.col("size").alias("c_size")), ["partition_no", "new_path"], "left")
    return live.agg(F.count("*").alias("files_written"), F.coalesce(F.sum("c_size"), F.lit(0)).alias("bytes_written"), F.count_if(F.col("patch_kind").isNotNull()).alias("patches_verified"))
