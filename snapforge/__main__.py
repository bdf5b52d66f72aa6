"""Command line: python -m snapforge VERB ...

    compress --store DIR --image-id ID --image TREE [--base-image TREE --base-image-id ID] [--config TOML] [--overwrite] [--archives] [--debug DIR]
    decompress --store DIR --image-id ID --output TREE [--base-image TREE] [--config TOML] [--overwrite]
    inspect --store DIR --image-id ID [--files]        diff --store DIR ID OTHER
    list --store DIR        status --store DIR ID        delete --store DIR ID [--dry-run]        walk BASE TARGET
    sweep --store DIR (blobs that no image refers to go)
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession, functions as F

from snapforge.functions.scalars import human_bytes
from snapforge.operators import diff, manifest
from snapforge.operators.routing import Router
from snapforge.plans import engine
from snapforge.sources.tree import read_tree, write_tree

#: A listing is shown whole up to this many records, and beyond only if asked for.
SHOWN = 50


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="snapforge", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb, options in {
        "compress": ("--store", "--image-id", "--image", "--base-image?", "--base-image-id?", "--config?", "--overwrite!", "--archives!", "--debug?"),
        "decompress": ("--store", "--image-id", "--output", "--base-image?", "--config?", "--overwrite!"),
        "inspect": ("--store", "--image-id", "--files!"),
        "diff": ("--store", "one", "other"),
        "list": ("--store",),
        "status": ("--store", "one"),
        "delete": ("--store", "one", "--dry-run!"),
        "walk": ("base", "target"),
        "sweep": ("--store",),
    }.items():
        v = verbs.add_parser(verb)
        for o in options:
            name = o.rstrip("?!")
            if o.endswith("!"):
                v.add_argument(name, action="store_true")
            elif name.startswith("--"):
                v.add_argument(name, required=not o.endswith("?"))
            else:
                v.add_argument(name)
    return p


def main(args: list[str], spark: SparkSession | None = None) -> list[str]:
    """What is to be printed, a line each."""
    a = _parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("snapforge").getOrCreate()
    if a.verb == "walk":
        base, target = read_tree(spark, a.base, "base", content=False), read_tree(spark, a.target, "target", content=False)
        out = [json.dumps(diff.tree_stats(x).withColumn("human", human_bytes("total_bytes")).first().asDict()) for x in (base, target)]
        return out + [f"{r.kind}: {r.n}" for r in diff.counts(diff.kinds(base, target)).orderBy("kind").collect()]
    store = engine.FolderStore(spark, a.store)
    router = Router.from_file(a.config) if getattr(a, "config", None) else Router()
    if a.verb == "compress":
        base = read_tree(spark, a.base_image, a.base_image_id or "base") if a.base_image else None
        return [json.dumps(engine.compress(store, a.image_id, read_tree(spark, a.image, a.image_id), base, a.base_image_id, router, a.overwrite, archives=a.archives, dump=a.debug))]
    if a.verb == "decompress":
        base = read_tree(spark, a.base_image, "base") if a.base_image else None
        write_tree(engine.decompress(store, a.image_id, base, router), a.output, a.overwrite)
        return [a.output]
    if a.verb == "inspect":
        recs = store.read("records", a.image_id)
        if recs is None:
            raise engine.StoreError(f"image {a.image_id} has no manifest")
        out = [json.dumps(r.asDict()) for r in manifest.inspect(recs).orderBy("partition_no").collect()]
        if a.files or recs.count() <= SHOWN:
            out += [f"{r.op} {r.path} ({r.stored}, {r.size})" for r in manifest.listing(recs).orderBy("partition_no", "path").toLocalIterator()]
        return out
    if a.verb == "diff":
        both = [store.read("records", i) for i in (a.one, a.other)]
        return [f"{r.status} {r.path}" for r in manifest.difference(*both).orderBy("partition_no", "path").toLocalIterator()]
    if a.verb == "list":
        return [json.dumps(r.asDict()) for r in engine.images(store).orderBy("image_id").toLocalIterator()]
    if a.verb == "status":
        found = engine.status(store, a.one)
        return [f"{found[0]}{f': {found[1]}' if found[1] else ''}" if found else "unknown"]
    if a.verb == "sweep":
        return [json.dumps({"blobs_deleted": engine.sweep(store)})]
    return [json.dumps(engine.delete_image(store, a.one, a.dry_run))]


def dump_records(records, path: str) -> None:
    """Records as JSON lines, for looking at what a step did."""
    manifest.to_json(records).select(F.col("record").alias("value")).write.mode("overwrite").text(path)


if __name__ == "__main__":
    print("\n".join(main(sys.argv[1:])))
