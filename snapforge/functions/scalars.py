"""Column functions over paths, hashes, modes and sizes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_OID_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"  # the OID namespace of RFC 4122, a fixed value


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def file_name(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def first_component(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), 1)


def extension(path) -> Column:
    """What follows the last dot of the file name; empty for names that begin with their only dot."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def components(path) -> Column:
    return F.filter(F.split(_c(path), "/"), lambda p: p != "")


def header(content) -> Column:
    return F.substring(_c(content).cast("binary"), 1, 16)


def sha256(content) -> Column:
    return F.sha2(_c(content).cast("binary"), 256)


def uuid5_oid(name) -> Column:
    """UUID version 5 in the OID namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(_OID_NAMESPACE)), _c(name).cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def archive_entry(partition_no, ordinal) -> Column:
    return F.format_string("p%d/%06d.patch", _c(partition_no).cast("int"), _c(ordinal).cast("long"))


def type_bits(mode) -> Column:
    return _c(mode).bitwiseAND(0o170000)


def major(rdev) -> Column:
    r = _c(rdev)
    return F.shiftright(r, 8).bitwiseAND(0xFFF).bitwiseOR(F.shiftright(r, 32).bitwiseAND(~0xFFF))


def minor(rdev) -> Column:
    r = _c(rdev)
    return r.bitwiseAND(0xFF).bitwiseOR(F.shiftright(r, 12).bitwiseAND(~0xFF))


def device(major_, minor_) -> Column:
    """The device number with these parts, the inverse of major() and minor()."""
    a, b = _c(major_).cast("long"), _c(minor_).cast("long")
    low = F.shiftleft(a.bitwiseAND(0xFFF), 8).bitwiseOR(b.bitwiseAND(0xFF))
    return low.bitwiseOR(F.shiftleft(a.bitwiseAND(~0xFFF), 32)).bitwiseOR(F.shiftleft(b.bitwiseAND(~0xFF), 12))


def human_bytes(n) -> Column:
    n = _c(n)
    out = F.format_string("%d B", n.cast("long"))
    for unit, size in (("KiB", 1 << 10), ("MiB", 1 << 20), ("GiB", 1 << 30)):
        out = F.when(n >= size, F.format_string(f"%.1f {unit}", F.bround(n.cast("double") / size, 1))).otherwise(out)
    return out


def image_format(path) -> Column:
    return F.when(F.lower(extension(path)) == "qcow2", "qcow2").otherwise("directory")


def device_partition(device) -> Column:
    """The number behind the p of a partition's device node, or 1."""
    return F.coalesce(F.regexp_extract(_c(device), r"p(\d+)$", 1).try_cast("int"), F.lit(1))


def operation(old_path, new_path) -> Column:
    old, new = _c(old_path), _c(new_path)
    return F.when(old.isNull(), "add").when(new.isNull(), "remove").when(old == new, "change").otherwise("rename")
