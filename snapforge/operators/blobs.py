"""Content-addressed blobs: deduplication, accounting, provenance, and which blobs no image needs any more."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from snapforge.functions.scalars import uuid5_oid


def groups(files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(sha256, path, copies, size, blob_id, is_new): one row for each content; path is the least of its paths.

    ``existing`` has (sha256, blob_id); the id of new content follows from its hash.
    """
    out = files.groupBy("sha256").agg(F.min("path").alias("path"), F.count("*").alias("copies"), F.min("size").alias("size"))
    if existing is None:
        return out.withColumn("blob_id", uuid5_oid("sha256")).withColumn("is_new", F.lit(True))
    known = existing.groupBy("sha256").agg(F.min("blob_id").alias("known"))
    out = out.join(known, "sha256", "left")
    return out.withColumn("blob_id", F.coalesce("known", uuid5_oid("sha256"))).withColumn("is_new", F.col("known").isNull()).drop("known")


def accounting(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count_if("is_new").alias("uploaded"),
        (F.sum("copies") - F.count_if("is_new")).alias("deduped"),
        F.coalesce(F.sum(F.when(F.col("is_new"), F.col("size"))), F.lit(0)).alias("uploaded_bytes"),
    )


def patch_sources(records: DataFrame, blobs: DataFrame) -> DataFrame:
    """Lazy patches whose source is a blob, with that blob's hash and size; a blob is read once, however many need it."""
    return records.where("patch_kind = 'lazy' and source_blob_id is not null").join(blobs.select(F.col("blob_id").alias("source_blob_id"), F.col("sha256").alias("source_sha256"), F.col("size").alias("source_size")), "source_blob_id")


def fetch_set(blobs: DataFrame, records: DataFrame) -> DataFrame:
    """The blobs that file records refer to, each once."""
    wanted = records.where("entry_type = 'file' and blob_id is not null").select("blob_id")
    return blobs.join(wanted, "blob_id", "left_semi")


def children(images: DataFrame, image_id: str) -> DataFrame:
    return images.where(F.col("base_image_id") == image_id).select("image_id")


def collectable(references: DataFrame, image_id: str) -> DataFrame:
    """(blob_id, fate): the image's blobs, deleted where no other image refers to them, else kept."""
    own = references.where(F.col("image_id") == image_id).select("blob_id").distinct()
    others = references.where(F.col("image_id") != image_id).select("blob_id").distinct().withColumn("used", F.lit(True))
    return own.join(others, "blob_id", "left").select("blob_id", F.when(F.col("used"), "kept").otherwise("deleted").alias("fate"))


def lineage(images: DataFrame) -> DataFrame:
    """(image_id, ancestor, distance): each image with all its bases. Distances double each round, so chains of 2 ** n
    images take n rounds; rounds end when one adds nothing, which it must, as there are only so many pairs of images. On a
    cycle of bases each of its images is its own ancestor once."""
    from snapforge.plans.staging import dropped, staged

    known = staged(images.where("base_image_id is not null").select("image_id", F.col("base_image_id").alias("ancestor"), F.lit(1).alias("distance")))
    n, before = known.count(), -1
    while n > before:
        further = known.alias("a").join(known.alias("b"), F.col("a.ancestor") == F.col("b.image_id")).select("a.image_id", "b.ancestor", (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        new = staged(known.unionByName(further).groupBy("image_id", "ancestor").agg(F.min("distance").alias("distance")))
        dropped(known)
        known, before, n = new, n, new.count()
    return known


def unreferenced(blobs: DataFrame, references: DataFrame) -> DataFrame:
    """The blobs that no record of any image refers to."""
    return blobs.join(references.where("blob_id is not null").select("blob_id").distinct(), "blob_id", "left_anti")
