"""Differences between two snapshots: full outer joins on (partition_no, path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from snapforge.functions.scalars import major, minor, type_bits

KEY = ["partition_no", "path"]
#: Times may differ by this many seconds without counting as different.
SLACK = 1
_META = ("entry_type", "mode", "uid", "gid", "mtime", "size", "sha256", "link_target", "dev", "ino", "nlink", "rdev")


def paired(base: DataFrame, target: DataFrame) -> DataFrame:
    """(partition_no, path, b, t): the entries of both sides as structs, null where a side has none. Content stays out."""
    b = base.select(*KEY, F.struct(*_META).alias("b"))
    t = target.select(*KEY, F.struct(*_META).alias("t"))
    return b.join(t, KEY, "full_outer")


def _differ(c: str) -> Column:
    return ~F.col(f"b.{c}").eqNullSafe(F.col(f"t.{c}"))


def _later() -> Column:
    return F.abs(F.col("b.mtime") - F.col("t.mtime")) > SLACK


def kinds(base: DataFrame, target: DataFrame) -> DataFrame:
    """(partition_no, path, kind): added, removed, changed or metadata_only; equal entries give no row.

    Content hashes count only where times differ by more than SLACK; special files never differ in place.
    """
    owner = _differ("uid") | _differ("gid")
    meta = _differ("mode") | owner | _later()
    kind = F.col("b.entry_type")
    inside = (
        F.when(_differ("entry_type"), "changed")
        .when(kind == "symlink", F.when(_differ("link_target"), "changed").when(owner, "metadata_only"))
        .when(kind == "file", F.when(_later() & _differ("sha256"), "changed").when(meta, "metadata_only"))
        .when(kind == "directory", F.when(meta, "metadata_only"))
    )
    found = F.when(F.col("b").isNull(), "added").when(F.col("t").isNull(), "removed").otherwise(inside)
    return paired(base, target).select(*KEY, found.alias("kind")).where("kind is not null")


def counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("kind").agg(F.count("*").alias("n"))


def symmetry(base: DataFrame, target: DataFrame) -> DataFrame:
    """Rows on which the difference and its mirror image disagree: none, if added and removed change places."""
    swap = F.when(F.col("kind") == "added", "removed").when(F.col("kind") == "removed", "added").otherwise(F.col("kind"))
    forth = kinds(base, target)
    back = kinds(target, base).select(*KEY, swap.alias("mirrored"))
    return forth.join(back, KEY, "full_outer").where(~F.col("kind").eqNullSafe(F.col("mirrored")))


def tree_stats(entries: DataFrame) -> DataFrame:
    def n(kind: str) -> Column:
        return F.count_if(F.col("entry_type") == kind)

    return entries.agg(n("file").alias("files"), n("directory").alias("directories"), n("symlink").alias("symlinks"), F.coalesce(F.sum(F.when(F.col("entry_type") == "file", F.col("size"))), F.lit(0)).alias("total_bytes"))


def hardlinks(entries: DataFrame) -> DataFrame:
    """``entries`` with canonical: the least path of the file's hard links (null: the file has none)."""
    linked = entries.where("entry_type = 'file' and nlink > 1")
    group = linked.groupBy("partition_no", "dev", "ino").agg(F.min("path").alias("canonical"), F.count("*").alias("n")).where("n > 1").drop("n")
    # groups come from a combined aggregate; only files with several links can match, so others never meet in one group
    return entries.join(group.withColumnRenamed("partition_no", "p").withColumnRenamed("dev", "d").withColumnRenamed("ino", "i"), (F.col("partition_no") == F.col("p")) & (F.col("dev") == F.col("d")) & (F.col("ino") == F.col("i")) & (F.col("entry_type") == "file") & (F.col("nlink") > 1), "left").drop("p", "d", "i")


def sparse_metadata() -> Column:
    """Of paired(): the target's fields that differ, null if none does."""
    fields = [F.when(_differ(c), F.col(f"t.{c}")).alias(c) for c in ("mode", "uid", "gid")]
    fields.append(F.when(_later(), F.col("t.mtime")).alias("mtime"))
    any_ = _differ("mode") | _differ("uid") | _differ("gid") | _later()
    return F.when(any_, F.struct(*fields))


def metadata_diff(base: DataFrame, target: DataFrame) -> DataFrame:
    both = paired(base, target).where("b is not null and t is not null")
    return both.select(*KEY, sparse_metadata().alias("m")).where("m is not null").select(*KEY, "m.*")


def records(base: DataFrame, target: DataFrame) -> DataFrame:
    """One row for each change: (partition_no, old_path, new_path, entry_type, size, data_kind, link_to, file_type_bits,
    major, minor, patch_kind, mode, uid, gid, mtime).

    Content always counts, whatever the times. A change of type, or of a device's number, is a removal and an addition.
    data_kind of files is lazy_blob (content of the target side) or original_file (of the base side); patch_kind lazy says
    that a patch from the base content is to be made.
    """
    canonical = hardlinks(target).where("canonical is not null and canonical <> path").select(*KEY, "canonical")
    both = paired(base, target).join(canonical, KEY, "left")
    none = F.lit(None)

    def record(**kw) -> Column:
        names = {"old_path": "string", "new_path": "string", "entry_type": "string", "size": "long", "data_kind": "string", "link_to": "string", "file_type_bits": "long", "major": "long", "minor": "long", "patch_kind": "string", "mode": "long", "uid": "long", "gid": "long", "mtime": "long"}
        return F.struct(*[kw.get(k, none).cast(t).alias(k) for k, t in names.items()])

    path, tk = F.col("path"), F.col("t.entry_type")
    full = {c: F.col(f"t.{c}") for c in ("mode", "uid", "gid", "mtime")}
    special = {"file_type_bits": type_bits("t.mode"), "major": major("t.rdev"), "minor": minor("t.rdev")}
    removed = record(old_path=path, entry_type=F.col("b.entry_type"), size=F.col("b.size"), data_kind=F.when(F.col("b.entry_type") == "file", "original_file"))
    added = (
        F.when(tk == "symlink", record(new_path=path, entry_type=tk, size=F.lit(0), data_kind=F.lit("softlink_to"), link_to=F.col("t.link_target"), **full))
        .when(tk == "directory", record(new_path=path, entry_type=tk, size=F.lit(0), **full))
        .when((tk == "file") & F.col("canonical").isNotNull(), record(new_path=path, entry_type=F.lit("hardlink"), size=F.lit(0), data_kind=F.lit("hardlink_to"), link_to=F.col("canonical"), **full))
        .when(tk == "special", record(new_path=path, entry_type=tk, size=F.lit(0), data_kind=F.lit("special_device"), **special, **full))
        .otherwise(record(new_path=path, entry_type=tk, size=F.col("t.size"), data_kind=F.lit("lazy_blob"), **full))
    )
    sparse = sparse_metadata()
    meta = {c: sparse.getField(c) for c in ("mode", "uid", "gid", "mtime")}
    inside = {
        "directory": record(old_path=path, new_path=path, entry_type=tk, size=F.lit(0), **meta),
        "symlink": record(old_path=path, new_path=path, entry_type=tk, size=F.lit(0), data_kind=F.when(_differ("link_target"), "softlink_to"), link_to=F.when(_differ("link_target"), F.col("t.link_target")), **meta),
        "special": record(old_path=path, new_path=path, entry_type=tk, size=F.lit(0), **meta),
        "file": record(old_path=path, new_path=path, entry_type=tk, size=F.col("t.size"), patch_kind=F.when(_differ("sha256"), "lazy"), **meta),
    }
    device = (type_bits("b.mode") != type_bits("t.mode")) | _differ("rdev")
    any_meta = sparse.isNotNull()
    rows = (
        F.when(F.col("b").isNull(), F.array(added))
        .when(F.col("t").isNull(), F.array(removed))
        .when(_differ("entry_type"), F.array(removed, added))
        .when(tk == "directory", F.when(any_meta, F.array(inside["directory"])))
        .when(tk == "symlink", F.when(any_meta | _differ("link_target"), F.array(inside["symlink"])))
        .when(tk == "special", F.when(device, F.array(removed, added)).when(any_meta, F.array(inside["special"])))
        .otherwise(F.when(any_meta | _differ("sha256"), F.array(inside["file"])))
    )
    return both.select("partition_no", F.explode(rows).alias("r")).select("partition_no", "r.*")


def unique_hashes(one: DataFrame, other: DataFrame) -> DataFrame:
    """(partition_no, path, sha256) of files whose path only ``one`` has."""
    return one.where("entry_type = 'file'").select(*KEY, "sha256").join(other.select(*KEY), KEY, "left_anti")


def compare(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(partition_no, path, problem): what is missing, extra or different, a row for each; times within SLACK are equal."""
    rows = F.when(F.col("t").isNull(), F.array(F.lit("missing"))).when(F.col("b").isNull(), F.array(F.lit("extra"))).when(_differ("entry_type"), F.array(F.lit("entry_type"))).otherwise(
        F.filter(
            F.array(
                F.when((F.col("b.entry_type") != "symlink") & _differ("mode"), "mode"),
                F.when((F.col("b.entry_type") == "symlink") & _differ("link_target"), "link_target"),
                *[F.when((F.col("b.entry_type") == "file") & _differ(c), c) for c in ("sha256", "size", "uid", "gid")],
                F.when((F.col("b.entry_type") == "file") & _later(), "mtime"),
                F.when((F.col("b.entry_type") == "special") & _differ("rdev"), "rdev"),
            ),
            lambda p: p.isNotNull(),
        )
    )
    return paired(expected, found).select(*KEY, F.explode(rows).alias("problem"))
