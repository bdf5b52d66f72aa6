"""Real directory trees: a Python data source that lists a tree (``snapforge_tree``), and a writer that rebuilds one.

Only the root's first two levels are listed where the plan is made; each of these folders is a partition that a task
walks. Symlinks are not followed. Content and hashes are read only if those columns are asked for by ``content`` and
``hashes`` options, so a scan of metadata reads no file.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import stat
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from snapforge.sources.snapshots import SCHEMA

CHUNK = 64 * 1024


def entry_kind(mode: int) -> str:
    if stat.S_ISREG(mode):
        return "file"
    if stat.S_ISLNK(mode):
        return "symlink"
    return "directory" if stat.S_ISDIR(mode) else "special"


def file_sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(CHUNK):
            h.update(block)
    return h.hexdigest()


def describe(root: str, path: str, image_id: str, partition_no: int, hashes: bool, content: bool) -> tuple:
    full = os.path.join(root, path)
    st = os.lstat(full)
    kind = entry_kind(st.st_mode)
    is_file = kind == "file"
    data = None
    if is_file and content:
        with open(full, "rb") as f:
            data = f.read()
    return (
        image_id, partition_no, path, kind, st.st_mode, st.st_uid, st.st_gid, int(st.st_mtime), st.st_size if is_file else 0,
        file_sha256(full) if is_file and hashes else None, data, os.readlink(full) if kind == "symlink" else None,
        st.st_dev, st.st_ino, st.st_nlink, st.st_rdev if kind == "special" else 0,
    )


class _Part(InputPartition):
    def __init__(self, folder: str, deep: bool):
        super().__init__(folder)
        self.folder, self.deep = folder, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        if not os.path.isdir(self.root):
            raise NotADirectoryError(self.root)
        self.image, self.number = options.get("image_id", "image"), int(options.get("partition_no", 1))
        self.hashes, self.content = (options.get(k, "true").lower() == "true" for k in ("hashes", "content"))

    def partitions(self) -> list[InputPartition]:
        parts, level = [_Part("", False)], [""]
        for depth in range(2):
            level = [os.path.join(f, e.name) for f in level for e in os.scandir(os.path.join(self.root, f)) if e.is_dir(follow_symlinks=False)]
            parts += [_Part(f, depth == 1) for f in sorted(level)]
        return parts

    def read(self, partition: _Part) -> Iterator[tuple]:
        todo = [partition.folder]
        while todo:
            folder = todo.pop()
            for e in sorted(os.scandir(os.path.join(self.root, folder)), key=lambda e: e.name):
                path = os.path.join(folder, e.name)
                yield describe(self.root, path, self.image, self.number, self.hashes, self.content)
                if partition.deep and e.is_dir(follow_symlinks=False):
                    todo.append(path)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "snapforge_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, path: str, image_id: str = "image", partition_no: int = 1, hashes: bool = True, content: bool = True) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("snapforge_tree").options(path=path, image_id=image_id, partition_no=str(partition_no), hashes=str(hashes), content=str(content)).load()


def _links(entries: DataFrame) -> DataFrame:
    """(path, to): files that are hard links to another path of the tree: those that say so, and those that share their
    inode, content and metadata with an earlier one."""
    files = entries.where("entry_type = 'file'")
    said = files.where("link_target is not null").select("path", F.col("link_target").alias("to"))
    same = ["partition_no", "dev", "ino", "sha256", "mode", "uid", "gid", "mtime"]
    linked = files.where("link_target is null and nlink > 1 and ino <> 0 and sha256 is not null")
    first = linked.groupBy(*same).agg(F.min("path").alias("to"), F.count("*").alias("n")).where("n > 1")
    return said.unionByName(linked.join(first, same).where("path <> to").select("path", "to"))


def write_tree(entries: DataFrame, root: str, replace: bool = False) -> None:
    """Rebuilds a tree on a file system that the executors share, beside ``root``, and then moves it there.

    Folders come first, then files, hard links, devices and symlinks, so nothing is written through a link; modes and times
    of folders come last. Owners and devices need privileges and are skipped without them. Paths that lead out of the tree
    are refused before anything is written. An output that exists is an error, or replaced as a whole.
    """
    root = root.rstrip("/")
    if os.path.lexists(root) and not replace:
        raise FileExistsError(root)
    bad = entries.where(F.col("path").rlike(r"^/|(^|/)\.\.(/|$)|^$|\x00")).select("path").take(1)
    if bad:
        raise ValueError(f"the path {bad[0].path!r} leads out of the tree")
    made = f"{root}.{uuid.uuid4().hex}.partial"
    os.makedirs(made)

    def place(r) -> str:
        full = os.path.join(made, r.path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        if os.path.lexists(full):  # a task that runs again
            os.unlink(full)
        return full

    def meta(full, r):
        if r.uid is not None and os.geteuid() == 0:
            os.lchown(full, r.uid, r.gid)
        if r.entry_type != "symlink":
            os.chmod(full, r.mode & 0o7777)
            os.utime(full, (r.mtime, r.mtime))

    def folders(rows):
        for r in rows:
            os.makedirs(os.path.join(made, r.path), exist_ok=True)

    def files(rows):
        for r in rows:
            full = place(r)
            with open(full, "wb") as f:
                f.write(r.content or b"")
            meta(full, r)

    def hard(rows):
        for r in rows:
            os.link(os.path.join(made, r.to), place(r))

    def devices(rows):
        for r in rows:
            if os.geteuid() == 0:
                full = place(r)
                os.mknod(full, r.mode, r.rdev)
                meta(full, r)

    def soft(rows):
        for r in rows:
            full = place(r)
            os.symlink(r.link_target, full)
            meta(full, r)

    def finish(rows):
        for r in sorted(rows, key=lambda r: -r.path.count("/")):
            meta(os.path.join(made, r.path), r)

    directories = entries.where("entry_type = 'directory'").drop("content")
    links = _links(entries)
    directories.foreachPartition(folders)
    entries.where("entry_type = 'file'").join(links.select("path"), "path", "left_anti").foreachPartition(files)
    links.foreachPartition(hard)
    entries.where("entry_type = 'special'").drop("content").foreachPartition(devices)
    entries.where("entry_type = 'symlink'").drop("content").foreachPartition(soft)
    directories.foreachPartition(finish)
    if os.path.lexists(root):
        (os.unlink if os.path.islink(root) or not os.path.isdir(root) else shutil.rmtree)(root)
    os.rename(made, root)
