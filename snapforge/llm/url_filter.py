"""URL rules by a sorted sweep over reversed-host keys. DataFrame operations only.

A host's canonical key is its labels in reverse order, each closed by U+0001, so that a rule's host and all its
subdomains are one interval of keys, and intervals of two rules are nested or apart. The keys of the urls and the two
ends of every rule interval are sorted together; each end carries the stack of rules active behind it, and the sweep
hands each url the last stack at or before its key. The rules of that stack are then held against host and path; the
longest that fits wins (longer host, then the greater string, among rules of equal length).

Sort partitions are ranges of (key, row number), so a host with most of the rows is dealt over many of them; the stack
that is active where a partition begins comes from the partitions before it (one row each). Rules are never broadcast.

Nulls: a url that is null or has no ``://`` has an empty host and path and fits no rule. A null or empty rule is ignored,
as is one without a host; a rule without ``/`` has an empty path. Of rules stated twice with different verdicts the
greater verdict (block) holds. Repeated urls give a row each; empty tables give empty results (no rules: the default
verdict for all). Columns named host, path, rule or verdict are replaced, all others are carried as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from snapforge.llm.common import written

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _AZ, _az)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return host, path


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\u0001"), F.lit("\u0001"))


def _boundaries(rules: DataFrame) -> DataFrame:
    """(key, stack): the rules active from that key on, as structs (host, path, rule, verdict)."""
    parsed = rules.where("rule is not null").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    parsed = parsed.select(
        F.translate(F.regexp_extract("rule", r"^([^/]*)", 1), _AZ, _az).alias("host"),
        F.regexp_extract("rule", r"(?s)^[^/]*(/.*)?$", 1).alias("path"),
        "rule",
        "verdict",
    ).where("host <> ''")
    nodes = parsed.groupBy(host_key(F.col("host")).alias("key")).agg(F.collect_list(F.struct("host", "path", "rule", "verdict")).alias("own"))
    labels = F.split(F.col("key"), "\u0001")
    chain = nodes.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "\u0001"), F.lit("\u0001")))).alias("above"))
    found = chain.join(nodes.select(F.col("key").alias("above"), "own"), "above")
    stacks = found.groupBy("key").agg(
        F.flatten(F.collect_list("own")).alias("inside"),
        F.flatten(F.collect_list(F.when(F.col("above") != F.col("key"), F.col("own")))).alias("outside"),
    )
    closing = F.concat(F.expr("left(key, length(key) - 1)"), F.lit("\u0002"))
    return stacks.select(F.explode(F.array(F.struct("key", F.col("inside").alias("stack")), F.struct(closing.alias("key"), F.col("outside").alias("stack")))).alias("e")).select("e.*")


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with host, path, rule (null if none fits) and verdict; ``rules`` has rule and verdict."""
    names = [c for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    if not names:
        raise ValueError("no column is left to carry")
    host, path = host_and_path(F.col(url))
    points = urls.select(F.struct(*names).alias("row"), host.alias("host"), path.alias("path"))
    ends = _boundaries(rules)
    stack_type = ends.schema["stack"].dataType
    points = points.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), F.monotonically_increasing_id().alias("at"), F.lit(None).cast(stack_type).alias("stack"), "row", "host", "path")
    row_type = points.schema["row"].dataType
    ends = ends.select("key", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("at"), "stack", F.lit(None).cast(row_type).alias("row"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    dealt = written(points.unionByName(ends).repartitionByRange("key", "kind", "at").withColumn("part", F.spark_partition_id()), "url-sweep")
    lasts = dealt.where("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("stack"))
    parts = dealt.groupBy("part").agg(F.count("*").alias("n")).join(lasts, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    carried = parts.select("part", F.last("stack", ignorenulls=True).over(before).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", "kind", "at").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.join(carried, "part").withColumn("active", F.coalesce(F.last("stack", ignorenulls=True).over(sweep), "carried")).where("kind = 1")

    def fits(r: Column) -> Column:
        return F.startswith(F.col("path"), r["path"]) & ((F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"])))

    best = F.array_max(F.transform(F.filter("active", fits), lambda r: F.struct(F.length(r["rule"]).alias("n"), F.length(r["host"]).alias("h"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return swept.withColumn("best", best).select("row.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
