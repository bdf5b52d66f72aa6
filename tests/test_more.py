import json
import random

import pytest
from pyspark.sql import functions as F

from snapforge.__main__ import dump_records, main
from snapforge.operators import diff, regions
from snapforge.plans import engine
from snapforge.sources import archive
from tests.test_engine import ROUTER, entry, same, snap  # noqa: F401


def test_archives(spark, tmp_path):
    rows = [("i", "p1/000002.patch", b"b" * 5000), ("i", "p1/000001.patch", b""), ("j", "p1/000000.patch", b"\0\1")]
    packed = archive.pack(spark.createDataFrame(rows, "image_id string, archive_entry string, patch binary"))
    got = {r.image_id: r for r in packed.collect()}
    assert got["i"].compressed and got["i"].stored_bytes == len(got["i"].archive) < 5000
    assert [n for n, _ in archive.members(bytes(got["i"].archive))] == ["p1/000001.patch", "p1/000002.patch"]
    back = archive.unpack(packed).collect()
    assert sorted((r.image_id, r.archive_entry, bytes(r.patch)) for r in back) == sorted(rows)
    (tmp_path / "a.tar").write_bytes(bytes(got["j"].archive))
    assert [bytes(r.patch) for r in archive.read(spark, str(tmp_path)).collect()] == [b"\0\1"]
    assert archive.smaller(b"ab") == (b"ab", False)
    with pytest.raises(ValueError):
        list(archive.members(b"junk" * 300))


def test_regions(spark):
    rows = [("a", 1, "bios_boot", b"code"), ("a", 2, "raw", b"swap"), ("b", 1, "bios_boot", b"code"), ("b", 3, "raw", b"")]
    df = spark.createDataFrame(rows, "image_id string, partition_no int, kind string, content binary")
    records, new = regions.compress(df)
    assert new.count() == 2 and {r.blob_id for r in records.where("size = 0").collect()} == {None}
    back = {(r.image_id, r.partition_no): r.content for r in regions.decompress(records, new).collect()}
    assert bytes(back["b", 1]) == b"code" and back["b", 3] is None
    again, none = regions.compress(df, new.select("sha256", "blob_id"))
    assert none.count() == 0 and again.agg(F.sum("stored_bytes")).first()[0] == 0
    disk = spark.createDataFrame([("a", bytes(512))], "image_id string, head binary")
    assert len(regions.boot_code(disk).first().content) == 440


class Tree:
    """Seeded random trees and changes to them."""

    def __init__(self, seed):
        self.r, self.rows = random.Random(seed), {}
        for _ in range(14):
            self.add()

    def text(self):
        r = self.r
        return r.choice(["", "".join(r.choice("abc \n") for _ in range(r.randrange(8, 300))), "line\n" * r.randrange(400), "\0\1" + "".join(chr(r.randrange(1, 255)) for _ in range(200))])

    def add(self):
        r = self.r
        path = f"{r.choice(['bin', 'etc', 'lib'])}/{r.choice(['foo', 'bar', 'libz'])}-{r.randrange(9)}.{r.randrange(30)}.{r.choice(['so', 'txt', 'cfg'])}"
        kind = r.choice(["file"] * 7 + ["directory", "symlink"])
        self.rows[path] = dict(kind=kind, content=self.text() if kind == "file" else None, link="x" if kind == "symlink" else None, mtime=r.randrange(10**6), uid=r.randrange(3))

    def change(self):
        r = self.r
        for _ in range(r.randrange(3, 9)):
            path = r.choice(sorted(self.rows))
            row = dict(self.rows[path])
            what = r.choice(["delete", "add", "modify", "modify", "rename", "link", "meta"])
            if what == "delete" and len(self.rows) > 5:
                del self.rows[path]
            elif what == "add":
                self.add()
            elif what == "modify" and row["kind"] == "file":
                t = row["content"]
                k = r.randrange(len(t) + 1)
                self.rows[path] = row | {"content": t[:k] + r.choice(["more", "\n", ""]) + t[k:], "mtime": row["mtime"] + 100}
            elif what == "rename":
                self.rows[path.replace("-", f"-{r.randrange(9)}")] = self.rows.pop(path)
            elif what == "link" and row["kind"] == "symlink":
                self.rows[path] = row | {"link": "y"}
            elif what == "meta":
                self.rows[path] = row | {"uid": row["uid"] + 1}

    def entries(self):
        return [entry(p, **v) for p, v in sorted(self.rows.items())]


def test_random_chain(spark, snap, tmp_path):  # noqa: F811
    tree, store = Tree(11), engine.FolderStore(spark, f"file://{tmp_path}/s")
    before = snap(*tree.entries())
    engine.compress(store, "g0", before)
    for n in (1, 2):
        tree.change()
        now = snap(*tree.entries())
        assert diff.symmetry(before, now).count() == 0
        engine.compress(store, f"g{n}", now, before, f"g{n - 1}", ROUTER)
        assert same(now, engine.decompress(store, f"g{n}", before, ROUTER)) == []
        before = now


def test_command_line(spark, tmp_path):
    old, new, out, store = (tmp_path / n for n in ("old", "new", "out", "store"))
    for d, text in ((old, "one\n"), (new, "one\ntwo\n")):
        (d / "etc").mkdir(parents=True)
        (d / "etc/conf").write_text(text)
    (new / "etc/added").write_text("x")
    s = ["--store", f"file://{store}"]
    walk = main(["walk", str(old), str(new)], spark)
    assert json.loads(walk[0])["files"] == 1 and "added: 1" in walk
    main(["compress", *s, "--image-id", "a", "--image", str(old)], spark)
    stats = json.loads(main(["compress", *s, "--image-id", "b", "--image", str(new), "--base-image", str(old), "--base-image-id", "a"], spark)[0])
    assert stats["files_added"] == 1
    assert any(line.startswith("+ etc/added") for line in main(["inspect", *s, "--image-id", "b"], spark))
    assert main(["status", *s, "b"], spark) == ["compressed"] and len(main(["list", *s], spark)) == 2
    assert main(["diff", *s, "a", "b"], spark)
    main(["decompress", *s, "--image-id", "b", "--output", str(out), "--base-image", str(old)], spark)
    assert (out / "etc/conf").read_text() == "one\ntwo\n" and (out / "etc/added").read_text() == "x"
    with pytest.raises(engine.StoreError):
        main(["delete", *s, "a"], spark)
    main(["delete", *s, "b"], spark)
    dump_records(engine.FolderStore(spark, f"file://{store}").read("records", "a"), f"file://{tmp_path}/dump")
    assert spark.read.json(f"file://{tmp_path}/dump").count() == 2
