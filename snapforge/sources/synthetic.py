"""Seeded trees of any size and seeded changes to them, as tables of entries. Nothing is drawn at random: every choice is a
hash of the seed and of the entry, so the same seed gives the same rows however they are dealt to tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from snapforge.functions.scalars import file_name, sha256

SUFFIXES, PREFIXES = ("-orig", ".1", "-copy", "_saved"), ("my-", "x-", "the-")
WORDS = (("notes", "remarks"), ("alpha", "beta"), ("red", "green"), ("left", "right"))
_MODES = {"directory": 0o040755, "symlink": 0o120777, "special": 0o020666}
_SHARED = ["mode", "uid", "gid", "mtime", "content"]


def draw(seed: int, what: str, *of) -> Column:
    """A number from 0 to below 1 for ``of``, another one for each ``what``."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *of), F.lit(1_000_000)) / F.lit(1e6)


def _pick(of, share: Column) -> Column:
    """One of the strings by a number from 0 to below 1."""
    return F.element_at(F.array(*[F.lit(x) for x in of]), (F.floor(share * len(of)) + 1).cast("int"))


def _bound(value: Column, f) -> Column:
    """f(value) with ``value`` computed once, so that plans stay small however often f uses it."""
    return F.transform(F.array(value), f)[0]


def mutated_name(name: Column, seed: int) -> Column:
    """Another name like ``name``, never the same: a number at the end of its stem goes up by one, or the stem gets a suffix or
    prefix, gains or loses its last character, or has a word exchanged. What follows the last dot stays, and so does a dot that
    a name begins with."""

    def of(name: Column, stem: Column) -> Column:
        ext = F.substr(name, F.length(stem) + 1)
        how, which = F.floor(draw(seed, "how", name) * 5), draw(seed, "which", name)
        digits = F.regexp_extract(stem, r"(\d{1,18})$", 1)
        bumped = F.when(digits == "", F.concat(stem, F.lit("-2"))).otherwise(F.concat(F.substr(stem, F.lit(1), F.length(stem) - F.length(digits)), (digits.try_cast("long") + 1).cast("string")))
        shorter = F.substr(stem, F.lit(1), F.length(stem) - 1)
        ended = F.when((F.length(stem) > 3) & (which < 0.5), shorter).otherwise(F.concat(stem, F.char(F.lit(97) + F.floor(which * 26))))
        swap = reduce(lambda out, p: F.when(F.contains(stem, F.lit(p[0])), F.regexp_replace(stem, p[0], p[1])).when(F.contains(stem, F.lit(p[1])), F.regexp_replace(stem, p[1], p[0])).otherwise(out), WORDS, F.concat(stem, F.lit("-2")))
        new = F.when(how == 0, bumped).when(how == 1, F.concat(stem, _pick(SUFFIXES, which))).when(how == 2, F.concat(_pick(PREFIXES, which), stem)).when(how == 3, ended).otherwise(swap)
        return F.concat(F.when((new == stem) | (new == ""), F.concat(stem, F.lit("-new"))).otherwise(new), ext)

    return _bound(name, lambda n: _bound(F.regexp_replace(n, r"(?s)(?<=.)\.[^.]*$", ""), lambda stem: of(n, stem)))


def mutated_content(content: Column, seed: int, of: Column) -> Column:
    """Other bytes: some put before, behind, into the middle in place of others, or at both ends, by a hash of ``of``."""
    c, how = content.cast("binary"), F.floor(draw(seed, "edit", of) * 4)
    some = F.substring(F.unhex(F.sha2(F.concat_ws("/", F.lit(str(seed)), of.cast("string")), 256)), 1, 20)
    n = F.octet_length(c)
    at = F.lit(1) + F.floor(draw(seed, "at", of) * (n - 1)).cast("int")
    middle = F.concat(F.substr(c, F.lit(1), at), some, F.substr(c, at + F.octet_length(some) + 1))
    new = F.when(how == 0, F.concat(some, c)).when(how == 1, F.concat(c, some)).when((how == 2) & (n > 2), middle).otherwise(F.concat(F.substring(some, 1, 4), c, F.substring(some, 5, 4)))
    return F.when(new == c, F.concat(c, some)).otherwise(new)


def _content(seed: int, of: Column) -> Column:
    """Of five kinds: empty, a few words, many equal lines, bytes, and text around bytes."""
    kind, size = F.floor(draw(seed, "content", of) * 5), (F.floor(draw(seed, "size", of) * 200) + 1).cast("int")
    word = F.sha2(F.concat_ws("-", F.lit(str(seed)), of.cast("string")), 256)
    data = F.unhex(F.repeat(word, size))
    words = F.concat_ws(" ", word, F.reverse(word), F.lit("end")).cast("binary")
    return F.when(kind == 0, F.lit("").cast("binary")).when(kind == 1, words).when(kind == 2, F.repeat(F.concat(F.substring(word, 1, 8), F.lit("\n")), size).cast("binary")).when(kind == 3, data).otherwise(F.concat(words, data, words))


def _finished(rows: DataFrame) -> DataFrame:
    """Sizes, hashes and numbers of links as the rows' content and inodes have them."""
    file = F.col("entry_type") == "file"
    links = F.count(F.when(file, 1)).over(Window.partitionBy("partition_no", "ino"))
    out = rows.withColumn("content", F.when(file, F.col("content"))).withColumn("nlink", F.when(file, links).otherwise(1))
    return out.withColumns({"size": F.when(file, F.octet_length("content")).otherwise(0).cast("long"), "sha256": F.when(file, sha256("content")), "nlink": F.col("nlink").cast("long")})


def tree(spark: SparkSession, n: int, seed: int, image_id: str = "image", partition_no: int = 1) -> DataFrame:
    """``n`` entries and the folders they lie in: seven in ten are files, one in twenty a hard link to the file before it, the
    others folders, symlinks and devices."""
    link = (F.col("id") % 20 == 9) & (F.col("id") > 0)
    leader = F.when(link, F.col("id") - 1).otherwise(F.col("id"))
    share = draw(seed, "kind", "id")
    kind = F.when((F.col("id") % 20).isin(8, 9), "file").when(share < 0.7, "file").when(share < 0.82, "directory").when(share < 0.95, "symlink").otherwise("special")
    folder = F.concat(_pick(("etc", "lib", "share", "home"), draw(seed, "top", "id")), F.lit("/"), F.concat(_pick([w for p in WORDS for w in p], draw(seed, "sub", "id")), F.lit("-"), F.floor(F.col("id") / 200).cast("string")))
    name = F.concat(_pick([w for p in WORDS for w in p], draw(seed, "word", "id")), F.lit("-"), F.col("id").cast("string"), _pick((".txt", ".so", ".cfg", ""), draw(seed, "ext", "id")))
    rows = spark.range(n).withColumns({"leader": leader, "entry_type": kind, "folder": folder}).withColumn("path", F.concat("folder", F.lit("/"), name))
    draws = {"uid": F.floor(draw(seed, "uid", "leader") * 3), "gid": F.floor(draw(seed, "gid", "leader") * 2), "mtime": F.lit(1_600_000_000) + F.floor(draw(seed, "time", "leader") * 1e8)}
    rows = rows.withColumns(draws | {"content": _content(seed, F.col("leader")), "ino": F.col("leader") + 1000})
    rows = rows.withColumns({"link_target": F.when(kind == "symlink", F.concat(F.lit("../"), name)), "rdev": F.when(kind == "special", F.lit(256 * 5) + F.col("id") % 200).otherwise(0)})
    mode = F.when(kind == "file", F.when(draw(seed, "mode", "leader") < 0.2, 0o100755).otherwise(0o100644))
    for k, bits in _MODES.items():
        mode = mode.when(kind == k, bits)
    rows = rows.withColumn("mode", mode.cast("long"))
    folders = rows.select("folder").distinct().select(F.explode(F.array(F.col("folder"), F.substring_index("folder", "/", 1))).alias("path")).distinct()
    folders = folders.select("path", F.lit("directory").alias("entry_type"), F.lit(_MODES["directory"]).cast("long").alias("mode"), F.lit(0).alias("uid"), F.lit(0).alias("gid"), F.lit(1_600_000_000).alias("mtime"), F.lit(None).cast("binary").alias("content"), F.xxhash64("path").alias("ino"), F.lit(None).cast("string").alias("link_target"), F.lit(0).alias("rdev"))
    return _shaped(_finished(rows.select(*folders.columns).unionByName(folders).withColumn("partition_no", F.lit(partition_no))), image_id)


def _shaped(rows: DataFrame, image_id: str) -> DataFrame:
    longs = ["mode", "uid", "gid", "mtime", "size", "ino", "nlink", "rdev"]
    rows = rows.withColumns({c: F.col(c).cast("long") for c in longs} | {"image_id": F.lit(image_id), "dev": F.lit(1).cast("long")})
    return rows.select("image_id", "partition_no", "path", "entry_type", "mode", "uid", "gid", "mtime", "size", "sha256", "content", "link_target", "dev", "ino", "nlink", "rdev")


def changed(entries: DataFrame, seed: int, share: float = 0.05, image_id: str = "changed") -> DataFrame:
    """A tree like ``entries`` in which about ``share`` of the entries were deleted, as many renamed (or in a renamed folder),
    modified, redirected or given other metadata, and as many added, of all kinds.

    Hard links have one content and metadata, so these change by inode; folders that hold anything are not deleted, but all in
    one may be renamed with it. A new path that is taken, or that two entries would get, is left to neither.
    """
    place = ["partition_no", "path"]
    leaf = F.col("entry_type") != "directory"
    rows = entries.where(~(leaf & (draw(seed, "delete", *place) < share)))
    # content and metadata
    by = F.when(leaf, F.struct("ino").cast("string")).otherwise(F.col("path"))
    file, op = F.col("entry_type") == "file", draw(seed, "change", by)
    modified, meta = file & (op < share), (op >= share) & (op < 2 * share)
    rows = rows.withColumns({
        "content": F.when(modified, mutated_content(F.col("content"), seed, by)).otherwise(F.col("content")),
        "mtime": F.when(modified | (meta & (op < 1.5 * share)), F.col("mtime") + 100).otherwise(F.col("mtime")),
        "uid": F.when(meta, F.col("uid") + 1).otherwise(F.col("uid")),
        "mode": F.when(meta & file, F.col("mode").bitwiseXOR(0o111)).otherwise(F.col("mode")),
        "link_target": F.when((F.col("entry_type") == "symlink") & (op < share), F.concat("link_target", F.lit(".elsewhere"))).otherwise(F.col("link_target")),
    })
    # names of leaves, and of the folders that leaves lie in
    parent = F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1)
    renamed = F.when(leaf & (draw(seed, "rename", *place) < share), F.concat(parent, F.when(parent == "", "").otherwise("/"), mutated_name(file_name("path"), seed))).otherwise(F.col("path"))
    depth = 2
    top = F.substring_index("path", "/", depth)
    moves = (F.size(F.split("path", "/")) > depth) | ((F.size(F.split("path", "/")) == depth) & ~leaf)
    moved = F.concat(F.substring_index(top, "/", depth - 1), F.lit("/"), mutated_name(file_name(top), seed), F.substr(F.col("new"), F.length(top) + 1))
    rows = rows.withColumn("new", renamed).withColumn("new", F.when(moves & (draw(seed, "folder", "partition_no", top) < share / 2), moved).otherwise(F.col("new")))
    # additions: beside entries, of their kind; hard links to them
    near = entries.where(draw(seed, "add", *place) < share)
    as_link = (F.col("entry_type") == "file") & (draw(seed, "link", *place) < 0.3)
    kept = rows.select("partition_no", "path", *[F.col(c).alias(f"now_{c}") for c in _SHARED])
    added = near.join(kept, place).withColumn("new", F.concat(parent, F.when(parent == "", "").otherwise("/"), F.lit("added-"), F.lit(seed).cast("string"), F.lit("-"), file_name("path")))
    fresh = _content(seed, F.col("new"))
    added = added.withColumns({c: F.when(as_link, F.col(f"now_{c}")).otherwise(fresh if c == "content" else F.col(c)) for c in _SHARED} | {"ino": F.when(as_link, F.col("ino")).otherwise(F.xxhash64("partition_no", "new"))})
    both = rows.withColumn("was", F.lit(True)).unionByName(added.select(*entries.columns, "new").withColumn("was", F.lit(False)))
    # a path for each: what stays keeps its own; of those that want one path the first gets it, if nothing had it before
    taken = entries.select("partition_no", F.col("path").alias("new")).withColumn("taken", F.lit(True))
    moving = F.col("new") != F.col("path")
    nth = F.row_number().over(Window.partitionBy("partition_no", "new").orderBy(F.desc("was"), "path"))
    both = both.join(taken, ["partition_no", "new"], "left").withColumn("fails", moving & (F.col("taken").isNotNull() | (nth > 1)))
    both = both.where(F.col("was") | ~F.col("fails")).withColumn("path", F.when(F.col("fails"), F.col("path")).otherwise(F.col("new")))
    return _shaped(_finished(both.drop("new", "was", "taken", "fails")), image_id)
