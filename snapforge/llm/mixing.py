"""Mixing sources to target weights with hash-random keys and distributed prefix sums. DataFrame operations only.

Each row gets a random key from a hash of its id; rows are sorted by source and key over range partitions, sizes are
summed within each partition, the sums of the partitions before it are added (a row for each partition and source), and
each source is cut where its budget ends. A budget above the source's size takes the whole source again, in the same
order, until it is used up (epochs). Texts are never shuffled: only ids, sources and sizes are.

Targets: the sources, in code point order with null last, get the weights in turn; ``share`` times all sizes is divided
by weight, no target exceeds ``cap`` times its source's size, and what is cut off goes to the others by weight until none
is above. That fixed point is found at once from the sources sorted by size over weight.

Nulls: a null text has size 0; null is a source of its own; a null id is hashed as the empty string. Rows with equal ids
are separate rows with equal keys. Empty texts are taken nought times or more but add nothing. An empty table gives an
empty result. Other columns are carried, whatever their names; those named like a result (source_size, target, copies,
taken) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from snapforge.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, rank, source_size, target) from (source, size): a row for each source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", w).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    per = per.withColumn("nth", F.row_number().over(by_ratio))
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct("nth", "level"))
    per = per.withColumn("found", F.min(fits).over(everything))
    target = F.when(F.col("found").isNull() | (F.col("nth") < F.col("found.nth")), F.col("most")).otherwise(F.col("found.level") * F.col("weight"))
    return per.select("source", "rank", "source_size", target.alias("target"))


def mix(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, cut: str = "words", seed: str = "mix") -> DataFrame:
    """``sized`` (source, size, doc_id and more) with source_size, target, copies and taken.

    cut="words": the row where the budget ends is taken in part, so each source's taken words are its target to the word;
    copies counts the times that a row is taken whole. cut="rows": rows are whole, and the last is taken if its middle
    lies within the budget.
    """
    columns = sized.columns  # as one struct, so that no name of theirs meets one of ours
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = written(sized.select(F.struct(*columns).alias("row"), "source", "size", key.alias("key")), "mix-sizes")
    per = targets(sized, weights, share, cap)
    rows = sized.join(per.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its"))).drop("its")
    dealt = written(rows.repartitionByRange("rank", "key", "size").withColumn("part", F.spark_partition_id()), "mix-dealt")
    sums = dealt.groupBy("rank", "part").agg(F.sum("size").alias("here"))
    carried = sums.select("rank", "part", F.coalesce(F.sum("here").over(Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carried"))
    within = Window.partitionBy("part", "rank").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("carried") + F.coalesce(F.sum("size").over(within), F.lit(0))
    budget = F.floor(F.col("target") + F.lit(0.5))
    out = dealt.join(carried, ["rank", "part"]).withColumn("before", before).withColumn("budget", budget)
    out = out.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
    out = out.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    if cut == "words":
        part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
        out = out.withColumn("taken", F.col("epochs") * F.col("size") + part).withColumn("copies", F.col("epochs") + F.when((part == F.col("size")) & (F.col("before") < F.col("rest")), 1).otherwise(0))
    else:
        out = out.withColumn("copies", F.col("epochs") + F.when(2 * F.col("before") + F.col("size") <= 2 * F.col("rest"), 1).otherwise(0))
        out = out.withColumn("taken", F.col("copies") * F.col("size"))
    results = ["source_size", "target", "copies", "taken"]
    return out.select(*[F.col("row").getField(c).alias(c) for c in columns if c.lower() not in results], *results)


def mix_documents(docs: DataFrame, **kw) -> DataFrame:
    """The rows of the mix: each row of ``docs`` (doc_id, text, source and more) as often as it is taken, whole.

    Rows equal in doc_id, source and text are taken together, as one unit with the sum of their sizes.
    """
    unit = docs.select("doc_id", "source", F.xxhash64("text").alias("print"), n_words(F.col("text")).alias("size"))
    units = unit.groupBy("doc_id", "source", "print").agg(F.sum("size").alias("size"))
    plan = mix(units, cut="rows", **kw).where("copies > 0").select(F.struct("doc_id", "source", "print").alias("u"), "copies")
    rows = docs.select(F.struct("doc_id", "source", F.xxhash64("text").alias("print")).alias("k"), F.struct(*docs.columns).alias("row"))
    taken = rows.join(plan, F.col("k").eqNullSafe(F.col("u")))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("epoch")).select("row.*")
