import os

import pytest
from pyspark.sql import functions as F

from snapforge.functions import textdiff, vcdiff
from snapforge.functions.scalars import archive_entry, device_partition, extension, human_bytes, image_format, major, minor, uuid5_oid
from snapforge.operators import codecs, diff, manifest, routing
from snapforge.plans import engine
from snapforge.sources.snapshots import SCHEMA
from snapforge.sources.tree import read_tree, write_tree

ENTRY = "partition_no int, path string, entry_type string, mode long, uid long, gid long, mtime long, size long, sha256 string, content binary, link_target string, dev long, ino long, nlink long, rdev long"


def entry(path, content=None, kind="file", mode=None, mtime=1000, uid=0, gid=0, link=None, ino=None, nlink=1, rdev=0, part=1):
    import hashlib

    data = content.encode() if isinstance(content, str) else content
    bits = {"file": 0o100644, "directory": 0o040755, "symlink": 0o120777, "special": 0o020666}[kind]
    file = kind == "file"
    data = (data or b"") if file else None
    return (part, path, kind, mode or bits, uid, gid, mtime, len(data) if file else 0, hashlib.sha256(data).hexdigest() if file else None, data, link, 1, ino if ino is not None else abs(hash(path)) % 10**9, nlink, rdev)


@pytest.fixture()
def snap(spark):
    return lambda *rows: spark.createDataFrame(list(rows), ENTRY)


def kinds(base, target):
    return {r.path: r.kind for r in diff.kinds(base, target).collect()}


def test_four_kinds_and_their_mirror(snap):
    a = snap(entry("same", "x"), entry("gone", "x"), entry("changed", "old"), entry("meta.sh", "x", mode=0o100644))
    b = snap(entry("same", "x"), entry("new", "x"), entry("changed", "new", mtime=2000), entry("meta.sh", "x", mode=0o100755))
    assert kinds(a, b) == {"gone": "removed", "new": "added", "changed": "changed", "meta.sh": "metadata_only"}
    assert kinds(b, a) == {"gone": "added", "new": "removed", "changed": "changed", "meta.sh": "metadata_only"}
    assert diff.symmetry(a, b).count() == 0


def test_times_and_links(snap):
    a = snap(entry("quiet", "a"), entry("second", "a"), entry("link", kind="symlink", link="x"), entry("flip", "a"), entry("dir", kind="directory"))
    b = snap(entry("quiet", "b"), entry("second", "a", mtime=1001), entry("link", kind="symlink", link="y"), entry("flip", kind="symlink", link="z"), entry("dir", kind="directory", mtime=5000))
    assert kinds(a, b) == {"link": "changed", "flip": "changed", "dir": "metadata_only"}
    rows = {(r.old_path, r.new_path): r for r in diff.records(a, b).collect()}
    assert rows["quiet", "quiet"].patch_kind == "lazy"  # records look at content whatever the times
    assert ("flip", None) in rows and (None, "flip") in rows
    assert rows["link", "link"].link_to == "y" and rows["dir", "dir"].mtime == 5000


def test_three_hard_links(snap):
    t = snap(*[entry(p, "data", ino=7, nlink=3) for p in ("b/second", "a/first", "c/third")])
    rows = {r.new_path: r for r in diff.records(t.limit(0), t).collect()}
    assert rows["a/first"].data_kind == "lazy_blob" and rows["b/second"].link_to == rows["c/third"].link_to == "a/first"
    assert rows["b/second"].entry_type == "hardlink"


def test_devices(snap):
    a, b = snap(entry("tty", kind="special", rdev=0x501)), snap(entry("tty", kind="special", rdev=0x502))
    rows = diff.records(a, b).collect()
    assert sorted((r.old_path, r.new_path) for r in rows if r.old_path is None) == [(None, "tty")] and len(rows) == 2
    add = next(r for r in rows if r.new_path)
    assert (add.file_type_bits, add.major, add.minor) == (0o020000, 5, 2)


# codecs

PAIRS = [(b"", b""), (b"", b"new text\n"), (b"old\n", b""), (b"a\nb\nc\n", b"a\nB\nc\n"), (b"no end", b"no end\n"), (b"x\n" * 300 + b"tail", b"x\n" * 150 + b"mid\n" + b"x\n" * 150 + b"tail"), ("é\n".encode() * 40, "è\n".encode() * 40), (bytes(range(256)) * 20, bytes(range(256)) * 9 + b"\0" * 500 + bytes(range(255, -1, -1)) * 3)]


@pytest.mark.parametrize("source,target", PAIRS)
def test_vcdiff_round_trip(source, target):
    delta = vcdiff.encode(source, target)
    assert vcdiff.decode(source, delta) == target
    if target:
        with pytest.raises(ValueError):
            vcdiff.decode(source, delta[:-1])


def test_vcdiff_is_small_and_checked():
    base = os.urandom(50_000)
    target = base[:20_000] + b"patch" + base[20_010:]
    assert len(vcdiff.encode(base, target)) < 100
    assert len(vcdiff.code_table()) == 256
    with pytest.raises(ValueError):
        vcdiff.decode(base, b"nonsense")
    with pytest.raises(ValueError):
        vcdiff.decode(base[:100], vcdiff.encode(base, target))


def test_vcdiff_of_the_standards_example():
    """Section 3: "abcdefghijklmnop" and "abcdwxyzefghefghefghefghzzzz", with a copy that overlaps what it writes."""
    source, target = b"abcdefghijklmnop", b"abcdwxyzefghefghefghefghzzzz"
    data, inst, addr = b"wxyz" + b"z", bytes([20, 5, 20, 19, 12, 0, 4]), bytes([0, 4, 24])
    body = bytes([len(target), 0, len(data), len(inst), len(addr)]) + data + inst + addr
    delta = vcdiff.MAGIC + b"\0" + b"\x01" + bytes([len(source), 0, len(body)]) + body
    assert vcdiff.decode(source, delta) == target


@pytest.mark.parametrize("source,target", PAIRS[:-1])
def test_text_round_trip(source, target):
    assert textdiff.decode(source, textdiff.encode(source, target)) == target


def test_text_errors():
    with pytest.raises(ValueError):
        textdiff.encode(b"\xff", b"a")
    with pytest.raises(ValueError):
        textdiff.encode(b"a", b"\xff")
    patch = textdiff.encode(b"a\nb\n", b"a\nc\n")
    for source, bad in ((b"z\nb\n", patch), (b"a\nb\n", b"\xff"), (b"a\nb\n", b"junk\n"), (b"a\nb\n", patch[:-5])):
        with pytest.raises(ValueError):
            textdiff.decode(source, bad)


def test_codec_columns(spark):
    rows = [(0, b"a", b"b" * 40), (1, b"x" * 100, b"x" * 101), (2, b"\xff", b"\xfe"), (255, b"s", b"t")]
    df = spark.createDataFrame(rows, "code int, s binary, t binary").withColumn("codec_id", F.lit("rev"))
    own = {"rev": (lambda s, t: t[::-1], lambda s, p: p[::-1])}
    out = df.withColumn("p", codecs.encoded("s", "t", "code", "codec_id", extended=own)).select("s", "t", "codec_id", "p.*")
    got = {bytes(r.t)[:1]: r for r in out.withColumn("back", codecs.decoded("s", "patch", "code", "codec_id", own)).collect()}
    assert all(bytes(r.back) == bytes(r.t) for r in got.values())
    assert got[b"\xfe"].codec_fallback and got[b"\xfe"].code == 0 and got[b"t"].code == 255
    with pytest.raises(Exception):
        df.withColumn("p", codecs.encoded("s", "t", "code", "codec_id", extended=own, strict=True)).collect()


# routing


@pytest.mark.parametrize("pattern,path,want", [("*.txt", "a/b.txt", True), ("**/*.txt", "b.txt", True), ("**/*.txt", "a/c/b.txt", True), ("a/**", "a/b/c", True), ("a?c", "a/c", True), ("[!a]x", "bx", True), ("[a-c]x", "dx", False), ("*.{gz,xz}", "a.gz", False), ("lib/*.so", "usr/lib/x.so", False), ("a.b", "axb", False)])
def test_globs(spark, pattern, path, want):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(routing.Glob(pattern, 1).accepts()).first()[0] == want
    if "{" in pattern:
        assert df.select(routing.Glob(pattern, 1, braces=True).accepts()).first()[0]


def test_router_from_a_file(spark, tmp_path):
    (tmp_path / "c.toml").write_text('[compressor]\ndefault_encoder = "xdelta3"\npassthrough_threshold = 0.9\n[[compressor.rules]]\ntype = "magic"\nmagic = "1f8b"\nencoder = "passthrough"\n[[compressor.rules]]\ntype = "size"\nmax_bytes = 10\nencoder = "text_diff"\n')
    router = routing.Router.from_file(str(tmp_path / "c.toml"))
    df = spark.createDataFrame([("a", 5, b"\x1f\x8b"), ("b", 10, b"zz"), ("c", 11, b"")], "path string, size long, header binary")
    assert [r[0] for r in df.orderBy("path").select(router.code()).collect()] == [0, 2, 1]
    for bad in ({"rules": [{"type": "moon", "encoder": "text"}]}, {"default_encoder": "zip"}, {"rules": [{"type": "magic", "magic": "xyz", "encoder": "text"}]}):
        with pytest.raises(ValueError):
            routing.Router.from_config(bad)


def test_scalars(spark):
    import uuid

    df = spark.createDataFrame([("dir/.bashrc", "a/b.tar.gz", "x.QCOW2", "/dev/nbd0p12", "abc")], "a string, b string, c string, d string, e string")
    got = df.select(extension("a"), extension("b"), image_format("c"), device_partition("d"), device_partition("e"), uuid5_oid("e"), human_bytes(F.lit(1536)), archive_entry(F.lit(2), F.lit(7)), major(F.lit(0x0801)), minor(F.lit(0x0801))).first()
    assert list(got) == ["", "gz", "qcow2", 12, 1, str(uuid.uuid5(uuid.NAMESPACE_OID, "abc")), "1.5 KiB", "p2/000007.patch", 8, 1]


# whole operations

ROUTER = routing.Router((routing.Glob("**/*.txt", routing.TEXT), routing.Size(3, routing.PASSTHROUGH)), routing.BINARY, 0.9)


def same(expected, found):
    return diff.compare(expected, found).collect()


def test_chain_of_images_comes_back(spark, snap, tmp_path):
    big = "".join(f"line {i}\n" for i in range(2000))
    v0 = snap(entry("etc/passwd.txt", "root\n" * 50), entry("lib/libc-2.31.so", big), entry("old", "gone"), entry("d", kind="directory"), entry("l", kind="symlink", link="a"), entry("a", "one", ino=5, nlink=2), entry("b", "one", ino=5, nlink=2))
    v1 = snap(entry("etc/passwd.txt", "root\n" * 50 + "new\n", mtime=2000), entry("lib/libc-2.35.so", big), entry("d", kind="directory", mode=0o040700), entry("l", kind="symlink", link="b", mtime=2000), entry("a", "one", ino=5, nlink=2), entry("b", "one", ino=5, nlink=2), entry("dev", kind="special", rdev=0x103), entry("copy", "one"))
    v2 = snap(entry("etc/passwd.txt", "other\n"), entry("lib/libc-2.35.so", big + "more", mtime=9000), entry("bin", "\0" * 100))
    store = engine.FolderStore(spark, f"file://{tmp_path}/store")
    engine.compress(store, "v0", v0)
    stats = engine.compress(store, "v1", v1, v0, "v0", ROUTER)
    engine.compress(store, "v2", v2, v1, "v1", ROUTER)
    # the new library got its base from the old one's blob, so it is no rename; without a store of origins it is one
    assert stats["files_renamed"] == 0 and stats["files_patched"] == 1 and stats["files_removed"] == 2
    alone = engine.FolderStore(spark, f"file://{tmp_path}/alone")
    assert engine.compress(alone, "v1", v1, v0, "v0", ROUTER)["files_renamed"] == 1
    assert same(v1, engine.decompress(alone, "v1", v0, ROUTER)) == []
    assert same(v0, engine.decompress(store, "v0")) == []
    back = engine.decompress(store, "v1", v0, ROUTER)
    assert same(v1, back) == []
    assert {r.path: bytes(r.content) for r in back.where("entry_type = 'file'").collect()}["lib/libc-2.35.so"] == big.encode()
    assert same(v2, engine.decompress(store, "v2", v1, ROUTER)) == []
    assert {r.image_id: r.status for r in engine.images(store).collect()} == {"v0": "compressed", "v1": "compressed", "v2": "compressed"}
    with pytest.raises(engine.StoreError):
        engine.compress(store, "v1", v1, v0, "v0")
    with pytest.raises(engine.StoreError):
        engine.delete_image(store, "v0")
    dry = engine.delete_image(store, "v2", dry_run=True)
    assert engine.delete_image(store, "v2") == dry and engine.status(store, "v2") is None
    with pytest.raises(engine.StoreError):
        engine.decompress(store, "v2")
    assert same(v1, engine.decompress(store, "v1", v0, ROUTER)) == []


def contents(df):
    return {r.path: bytes(r.content) for r in df.where("entry_type = 'file'").collect()}


def test_overwriting_an_image_leaves_shared_content(spark, snap, tmp_path):
    store = engine.FolderStore(spark, f"file://{tmp_path}/store")
    engine.compress(store, "a", snap(entry("f", "shared"), entry("only", "of a")))
    engine.compress(store, "b", snap(entry("g", "shared")))
    engine.compress(store, "a", snap(entry("f", "new")), overwrite=True)
    assert contents(engine.decompress(store, "b")) == {"g": b"shared"}
    assert contents(engine.decompress(store, "a")) == {"f": b"new"}
    assert engine.sweep(store) == 1 and store.blobs().count() == 2
    assert contents(engine.decompress(store, "b")) == {"g": b"shared"}


def test_delete_make_again_delete(spark, snap, tmp_path):
    store = engine.FolderStore(spark, f"file://{tmp_path}/store")
    a, b = snap(entry("f", "shared"), entry("x", "own")), snap(entry("g", "shared"))
    engine.compress(store, "a", a)
    engine.compress(store, "b", b)
    for _ in range(2):
        assert engine.delete_image(store, "a") == {"blobs_deleted": 1, "blobs_kept": 1}
        assert contents(engine.decompress(store, "b")) == {"g": b"shared"}
        engine.compress(store, "a", a)
    assert engine.delete_image(store, "b") == {"blobs_deleted": 0, "blobs_kept": 1}
    assert contents(engine.decompress(store, "a")) == {"f": b"shared", "x": b"own"}
    assert store.blobs().count() == 2


def test_missing_content_is_an_error(spark, snap, tmp_path):
    store = engine.FolderStore(spark, f"file://{tmp_path}/store")
    v0, v1 = snap(entry("f", "line\n" * 50)), snap(entry("f", "line\n" * 50 + "end", mtime=5000), entry("n", "new"))
    engine.compress(store, "v0", v0)
    engine.compress(store, "v1", v1, v0, "v0")
    assert contents(engine.decompress(store, "v1", v0)) == contents(v1)
    with pytest.raises(Exception, match="source of a patch is missing"):
        engine.decompress(store, "v1")
    with pytest.raises(Exception, match="not what its hash says|ValueError"):
        engine.decompress(store, "v1", snap(entry("f", "line\n" * 49 + "line?")))
    store.remove_blobs(store.blobs().where("size = 3").select("blob_id"))
    with pytest.raises(Exception, match="content of a file is missing"):
        engine.decompress(store, "v1", v0)


def test_links_to_files_that_do_not_change(spark, snap, tmp_path):
    """A new link to an unchanged file, to one whose metadata changes, and to one that is renamed; a large device."""
    base = snap(entry("a", "one", ino=1), entry("b", "two", ino=2), entry("c-1.0.so", "three" * 20, ino=3))
    target = snap(entry("a", "one", ino=1, nlink=2), entry("z", "one", ino=1, nlink=2), entry("b", "two", ino=2, nlink=2, uid=7), entry("y", "two", ino=2, nlink=2, uid=7),
                  entry("c-1.1.so", "three" * 20, ino=3, nlink=2), entry("x", "three" * 20, ino=3, nlink=2), entry("dev", kind="special", rdev=259 << 8 | 300 & 0xFF | (300 & ~0xFF) << 12))
    store = engine.FolderStore(spark, f"file://{tmp_path}/store")
    engine.compress(store, "v0", base)
    engine.compress(store, "v1", target, base, "v0")
    back = engine.decompress(store, "v1", base)
    assert same(target, back) == [] and contents(back) == contents(target)
    assert {r.path: r.rdev for r in back.collect()}["dev"] == os.makedev(259, 300)
    write_tree(back, str(tmp_path / "out"))
    ino = lambda p: os.stat(tmp_path / "out" / p).st_ino
    assert ino("a") == ino("z") and ino("b") == ino("y") and ino("c-1.1.so") == ino("x") and ino("a") != ino("b")


def test_failed_image_may_be_made_again(spark, snap, tmp_path):
    store = engine.FolderStore(spark, f"file://{tmp_path}/store")
    with pytest.raises(Exception):
        engine.compress(store, "x", snap(entry("a", "1")).drop("sha256"))
    assert engine.status(store, "x")[0] == "failed"
    engine.compress(store, "x", snap(entry("a", "1")))
    assert engine.status(store, "x") == ("compressed", None)


def test_manifest_difference_and_listing(snap):
    a, b, c = snap(entry("f", "1"), entry("g", "1")), snap(entry("f", "2", mtime=3000), entry("h", "1")), snap(entry("f", "3", mtime=4000))
    one, other = diff.records(a, b), diff.records(a, c)
    assert {r.path: r.status for r in manifest.difference(one, other).collect()} == {"f": "differs", "h": "only_first"}
    assert manifest.difference(one, one).count() == 0
    assert {r.path: r.op for r in manifest.listing(one).collect()} == {"f": "M", "g": "-", "h": "+"}


# real trees


def test_tree_source_and_writer(spark, tmp_path):
    root = tmp_path / "in"
    (root / "a/b/c/d").mkdir(parents=True)
    (root / "a/file").write_text("hello")
    (root / "a/b/c/d/deep").write_bytes(b"\0\1")
    (root / "link").symlink_to("a/file")
    os.link(root / "a/file", root / "hard")
    df = read_tree(spark, str(root), image_id="i")
    rows = {r.path: r for r in df.collect()}
    assert set(rows) == {"a", "a/b", "a/b/c", "a/b/c/d", "a/b/c/d/deep", "a/file", "link", "hard"}
    assert rows["link"].link_target == "a/file" and rows["link"].entry_type == "symlink" and rows["hard"].nlink == 2
    assert df.columns == [f.strip().split()[0] for f in SCHEMA.split(",")]
    write_tree(df, str(tmp_path / "out"))
    assert [p for p in same(df, read_tree(spark, str(tmp_path / "out"))) if p.problem != "uid"] == []
    light = read_tree(spark, str(root), hashes=False, content=False)
    assert light.where("sha256 is not null or content is not null").count() == 0
    with pytest.raises(Exception):
        read_tree(spark, str(tmp_path / "none")).count()


@pytest.mark.parametrize("path", ["../out", "/etc/x", "a/../../b", "a/..", ""])
def test_paths_out_of_the_tree_are_refused(snap, tmp_path, path):
    with pytest.raises(ValueError):
        write_tree(snap(entry("fine", "x"), entry(path, "x")), str(tmp_path / "t" / "out"))
    assert not (tmp_path / "t").exists()


def test_writer_replaces_whole_trees_and_makes_links_and_devices(spark, snap, tmp_path):
    out = tmp_path / "out"
    (out / "old").mkdir(parents=True)
    rows = snap(entry("a", "x", ino=9, nlink=2), entry("d/b", "x", ino=9, nlink=2), entry("l", kind="symlink", link="../.."), entry("pipe", kind="special", mode=0o010644))
    with pytest.raises(FileExistsError):
        write_tree(rows, str(out))
    write_tree(rows, str(out), replace=True)
    assert sorted(os.listdir(out)) == (["a", "d", "l", "pipe"] if os.geteuid() == 0 else ["a", "d", "l"])
    assert os.stat(out / "a").st_ino == os.stat(out / "d/b").st_ino and os.readlink(out / "l") == "../.."
    assert sorted(os.listdir(tmp_path)) == ["out"]


def test_numbers_go_on_over_ranges(spark, snap):
    rows = snap(*[entry(f"p{i:03d}", "x", part=1 + i % 2) for i in range(60)])
    recs = diff.records(rows.limit(0), rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = manifest.numbered(recs).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.partition_no, r.ordinal, r.new_path) for r in got) == [(p, n, f"p{2 * n + p - 1:03d}") for p in (1, 2) for n in range(30)]
