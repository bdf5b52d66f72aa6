import pytest
from pyspark.sql import functions as F

from snapforge.operators import codecs, diff, routing
from snapforge.plans import engine, stages
from snapforge.sources import synthetic
from snapforge.sources.tree import read_tree, write_tree
from tests.test_engine import entry, same, snap  # noqa: F401

ROUTER = routing.Router((routing.Glob("**/*.txt", routing.TEXT), routing.Size(30, routing.Router((), routing.PASSTHROUGH))), routing.BINARY, 0.9)


def test_trees_are_sound_and_the_same_again(spark):
    a = synthetic.tree(spark, 400, 7).cache()
    rows = a.collect()
    paths = [r.path for r in rows]
    assert len(paths) == len(set(paths)) > 400
    kinds = {r.entry_type for r in rows}
    assert kinds == {"file", "directory", "symlink", "special"} and any(r.nlink == 2 for r in rows)
    folders = {r.path for r in rows if r.entry_type == "directory"}
    assert all(p.rsplit("/", 1)[0] in folders for p in paths if "/" in p)
    assert a.exceptAll(synthetic.tree(spark, 400, 7).repartition(5)).count() == 0
    assert a.join(synthetic.tree(spark, 400, 8), "sha256", "left_anti").where("size > 0").count() > 100


def test_changes_are_found_and_undone(spark, tmp_path):
    before = synthetic.tree(spark, 200, 3).coalesce(2).cache()
    now = synthetic.changed(before, 4, 0.15).coalesce(2).cache()
    paths = [r.path for r in now.select("path").collect()]
    assert len(paths) == len(set(paths))
    found = {r.kind: r["count"] for r in diff.kinds(before, now).groupBy("kind").count().collect()}
    assert all(found.get(k, 0) > 3 for k in ("added", "removed", "changed", "metadata_only"))
    links = now.where("entry_type = 'file' and nlink > 1").groupBy("ino").agg(F.countDistinct("sha256", "mode", "uid", "mtime").alias("n"))
    assert links.where("n > 1").count() == 0 and links.count() > 5
    store = engine.FolderStore(spark, f"file://{tmp_path}/s")
    engine.compress(store, "a", before)
    stats = engine.compress(store, "b", now, before, "a", ROUTER, archives=True, dump=f"file://{tmp_path}/dump")
    assert same(now, engine.decompress(store, "b", before, ROUTER)) == []
    assert list(stats["seconds"]) == [s.name for s in stages.STAGES] and stats["files_renamed"] > 3
    assert stats["stored_bytes"] == store.read("archives", "b").agg(F.sum("stored_bytes")).first()[0]
    assert "patch" not in store.read("patches", "b").columns
    for n, s in enumerate(stages.STAGES):
        assert spark.read.json(f"file://{tmp_path}/dump/{n:02d}-{s.name}").count() > 60


@pytest.mark.parametrize("name", ["a.txt", "lib-9.so", ".hidden", "red", "x", "notes-2", "a.b.c", "é.txt", "v99999999999999999999"])
def test_names_change(spark, name):
    got = spark.range(1).select(*[synthetic.mutated_name(F.lit(name), s).alias(f"s{s}") for s in range(25)]).first()
    assert name not in got and all(got) and len(set(got)) > 3
    ext = name[name.rfind(".") :] if name.rfind(".") > 0 else ""
    assert all(g.endswith(ext) for g in got)


@pytest.mark.parametrize("data", [b"", b"ab", b"a longer text than the bytes that go into it"])
def test_content_changes(spark, data):
    got = spark.range(40).select(synthetic.mutated_content(F.lit(data), 1, F.col("id")).alias("c")).collect()
    assert all(bytes(r.c) != data and len(r.c) >= len(data) for r in got) and len({len(r.c) for r in got}) >= 2


def test_a_generated_tree_on_disk(spark, tmp_path):
    rows = synthetic.tree(spark, 60, 5).where("entry_type <> 'special'").cache()
    write_tree(rows, str(tmp_path / "t"))
    back = read_tree(spark, str(tmp_path / "t"))
    want = {(r.path, r.entry_type, r.sha256, r.link_target) for r in rows.collect()}
    assert {(r.path, r.entry_type, r.sha256, r.link_target) for r in back.collect()} == want


def test_routers_within_routers(spark):
    inner = routing.Router((routing.Size(10, routing.PASSTHROUGH), routing.Elf(routing.EXTENDED, "own")), routing.TEXT, 0.25, {"own": (None, None)})
    router = routing.Router((routing.Glob("a/*", inner),), routing.Router((), routing.BINARY, 0.5), 0.75)
    rows = [("a/x", 5, b"zz"), ("a/y", 50, b"\x7fELF"), ("a/z", 50, b"zz"), ("b", 5, b"zz")]
    df = spark.createDataFrame(rows, "path string, size long, header binary")
    got = df.select(router.code(), router.codec_id(), router.limit()).collect()
    assert [tuple(r) for r in got] == [(0, None, 0.25), (255, "own", 0.25), (2, None, 0.25), (1, None, 0.5)]
    assert list(router.decoders()) == ["own"]
    config = {"rules": [{"type": "glob", "pattern": "a/*", "encoder": {"rules": [{"type": "size", "max_bytes": 10, "encoder": "passthrough"}], "default_encoder": "text"}}]}
    assert [r[0] for r in df.select(routing.Router.from_config(config).code()).collect()] == [0, 2, 2, 1]
    pair = spark.createDataFrame([(b"abcdefgh" * 20, b"abcdefgh" * 20 + b"x", 1)], "s binary, t binary, c int")
    assert pair.select(codecs.encoded("s", "t", "c", threshold=F.lit(0.0)).alias("p")).first().p.code == 0


def test_regions_of_images(spark, snap, tmp_path):  # noqa: F811
    store = engine.FolderStore(spark, f"file://{tmp_path}/s")
    regions = lambda *r: spark.createDataFrame(r, "partition_no int, kind string, content binary")
    one = engine.compress(store, "a", snap(entry("f", "same bytes")), regions=regions((0, "mbr", b"boot"), (2, "raw", b"same bytes"), (3, "raw", b"")))
    assert (one["regions"], one["region_bytes"], one["region_stored_bytes"]) == (3, 14, 4)
    two = engine.compress(store, "b", snap(entry("f", "other")), regions=regions((0, "mbr", b"boot")))
    assert two["region_stored_bytes"] == 0
    got = {r.partition_no: r.content and bytes(r.content) for r in engine.decompress_regions(store, "a").collect()}
    assert got == {0: b"boot", 2: b"same bytes", 3: None}
    assert engine.delete_image(store, "a") == {"blobs_deleted": 1, "blobs_kept": 1}
    assert bytes(engine.decompress_regions(store, "b").first().content) == b"boot" and engine.sweep(store) == 0
    store.remove_blobs(store.blobs())
    with pytest.raises(Exception, match="region is missing"):
        engine.decompress_regions(store, "b").collect()
    assert engine.decompress_regions(store, "none").count() == 0


def test_a_stage_of_ones_own(spark, snap, tmp_path):  # noqa: F811
    class OnlyText(stages.Stage):
        name = "only_text"

        def run(self, ctx, draft):
            draft.records = draft.records.where("coalesce(new_path, old_path) like '%.txt'")
            return draft

    store = engine.FolderStore(spark, f"file://{tmp_path}/s")
    own = (stages.STAGES[0], OnlyText(), *stages.STAGES[1:])
    stats = engine.compress(store, "a", snap(entry("a.txt", "x"), entry("b.bin", "y")), stages=own)
    assert stats["files_added"] == 1 and "only_text" in stats["seconds"]
