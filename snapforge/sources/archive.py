"""Patch archives: tar files, gzipped where that is smaller, packed from and unpacked to rows."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from snapforge.plans.staging import ship

_GZIP = b"\x1f\x8b"


def smaller(data: bytes) -> tuple[bytes, bool]:
    """(data or its gzip form, whether the latter): the gzip form only if it is smaller."""
    packed = gzip.compress(data, mtime=0)
    return (packed, True) if len(packed) < len(data) else (data, False)


def _tar(members: Iterator[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def pack(patches: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, archive, compressed, stored_bytes): one archive for each key, members (archive_entry, patch) in order of name.

    An archive is built in one task, so it must fit there, as any single archive file must; a key without patches has no
    row, and reading what is missing gives no members.
    """

    ship(patches.sparkSession)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("archive_entry")
        data, packed = smaller(_tar((n, bytes(p)) for n, p in zip(rows["archive_entry"], rows["patch"])))
        return pd.DataFrame({key: [group[key].iloc[0]], "archive": [data], "compressed": [packed], "stored_bytes": [len(data)]})

    return patches.select(key, "archive_entry", "patch").groupBy(key).applyInPandas(build, f"{key} string, archive binary, compressed boolean, stored_bytes long")


def packed(patches: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """(first_entry, archive, compressed, stored_bytes, members): archives of about ``limit`` bytes of patches (partition_no,
    ordinal, archive_entry, patch) in that order. Tasks read ranges as a stream and hold one archive at a time, so neither an
    image nor a partition need fit one; a patch larger than the limit has an archive of its own."""

    def run(batches):
        names: list[tuple[str, bytes]] = []
        held = 0

        def done() -> pd.DataFrame:
            data, small = smaller(_tar(iter(names)))
            return pd.DataFrame({"first_entry": [names[0][0]], "archive": [data], "compressed": [small], "stored_bytes": [len(data)], "members": [len(names)]})

        for b in batches:
            for name, patch in zip(b["archive_entry"], b["patch"]):
                patch = bytes(patch or b"")
                if names and held + len(patch) > limit:
                    yield done()
                    names, held = [], 0
                names.append((name, patch))
                held += len(patch)
        if names:
            yield done()

    ship(patches.sparkSession)
    dealt = patches.repartitionByRange("partition_no", "ordinal").sortWithinPartitions("partition_no", "ordinal").select("archive_entry", "patch")
    return dealt.mapInPandas(run, "first_entry string, archive binary, compressed boolean, stored_bytes long, members long")


def members(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of a tar or tar.gz; ValueError on anything else."""
    try:
        raw = gzip.decompress(data) if data[:2] == _GZIP else data
        with tarfile.open(fileobj=io.BytesIO(raw), mode="r:") as t:
            for m in t:
                if m.isfile():
                    yield m.name, t.extractfile(m).read()
    except (tarfile.TarError, OSError, EOFError) as e:
        raise ValueError(f"not an archive: {e}") from e


def unpack(archives: DataFrame, column: str = "archive", key: str = "image_id") -> DataFrame:
    """(key, archive_entry, patch): a row for each member."""

    ship(archives.sparkSession)

    def run(batches):
        for b in batches:
            rows = [(k, name, data) for k, a in zip(b[key], b[column]) if a is not None for name, data in members(bytes(a))]
            yield pd.DataFrame(rows, columns=[key, "archive_entry", "patch"])

    return archives.select(key, column).mapInPandas(run, f"{key} string, archive_entry string, patch binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, archive_entry, patch) of all archives under a path."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("archive"))
    return unpack(files, key="path")
