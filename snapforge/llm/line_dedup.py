"""Near-duplicate lines by an exact set-similarity join. DataFrame operations only.

Lines are cut at U+000A; their words are runs of anything but space and U+0009-U+000D, and their tokens the distinct
shingles of 5 words (of all words where there are fewer). A line is removed if a line before it (smaller id, or further
up in the same document) has token sets with a Jaccard similarity of 0.8 or more; lines are judged on the input. Lines
without words stay.

Tokens are 64-bit numbers whose leading bits are the rarity class and the counter of the shingle's first word, from a table of
word counts over all texts in ``2 ** BUCKET_BITS`` counters, so plain order is rarest first. Equal lines are one set. Similar
sets share one of their first n - ceil(0.8 n) + 1 tokens (prefix filter). As that order goes by first words before all else, only
the shingles at the rarest words are hashed for it, and all shingles where words at the cut or shingles are repeated; tokens that
a single set has are dropped at once.
The sets that share a token stand in order of their first line, and each is compared with those before it: first with the
first, then with the next WIDER, the next WIDER squared and so on, until it is known as similar, so that a group of near copies
costs about a comparison each and never all pairs. Candidates must pass the length and positional filters (the latter holds
at the first token that two similar sets share) and a bound on differing tokens from 256-bit bitmaps, before whole token sets
are compared. Whole sets are made for the lines that share a token, from the texts, and for no others.

Nulls: a null text stays null and has no lines; a null id comes before all others, and ids are compared as longs. Rows of
one id with different texts are separate: lines in the same place come in the order of their text's hash, and equal rows
get the same result. Empty tables give empty results. Other columns are carried, the text is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from snapforge.llm.common import discard, written

SHINGLE, SIMILARITY = 5, 0.8
#: Counters of words, as a power of two.
BUCKET_BITS = 14
#: Bits of a token behind those of its class and bucket; a line has no more words than they can number.
REST_BITS = 43
#: Words of 64 bits of a set's bitmap.
BITMAPS = 4
#: How much more each look back covers than the one before.
WIDER = 16
#: Pairs that may be broadcast; more of them are joined by shuffles.
BROADCAST_PAIRS = 50_000
_SPACE = "\t\n\u000b\u000c\r"


def _spaced(text: Column) -> Column:
    """White space as spaces; translate() is slow, so only texts that hold any but spaces and line ends go through it."""
    rare = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\u000b")) | F.contains(text, F.lit("\u000c")) | F.contains(text, F.lit("\r"))
    return F.when(rare, F.translate(text, _SPACE, " " * len(_SPACE))).otherwise(F.replace(text, F.lit("\n"), F.lit(" ")))


def _words(line: Column) -> Column:
    return F.array_remove(F.split(_spaced(line), " "), "")


def _bucket(word_hash: Column) -> Column:
    return F.shiftrightunsigned(word_hash, 64 - BUCKET_BITS).cast("int")


def _rarity(docs: DataFrame) -> Column:
    """A constant array: for each bucket of words its class (bits of the count), counted over all texts, and its number, as the
    leading bits of a token. The driver holds one number for each bucket, whatever the input's size."""
    words = docs.select(F.explode(F.split(_spaced(F.col("text")), " ")).alias("w"))
    counts = words.groupBy(_bucket(F.xxhash64("w")).alias("b")).agg(F.count("*").alias("n"))
    classes = [b << REST_BITS for b in range(1 << BUCKET_BITS)]
    for b, n in counts.collect():
        classes[b] |= n.bit_length() << (BUCKET_BITS + REST_BITS)
    return F.split(F.lit(",".join(map(str, classes))), ",").cast("array<long>")  # folded into one literal


def _need(n: Column) -> Column:
    return F.ceil(n * F.lit(SIMILARITY) - F.lit(1e-9))


def _hashed(rows: DataFrame) -> DataFrame:
    """rows with ``line`` -> those with words, and their words' hashes h."""
    worded = F.col("line").rlike(r"[^ \t-\r]")  # not by the words' number: that filter would split lines once more
    return rows.where(worded).withColumn("h", F.transform(_words(F.col("line")), lambda w: F.xxhash64(w)))


def _firsts() -> Column:
    """The hashes of the words that begin a shingle."""
    return F.slice("h", F.lit(1), F.greatest(F.size("h") - (SHINGLE - 1), F.lit(1)))


def _shingle(i: Column) -> Column:
    return F.xxhash64(*[F.get("h", i + k if k else i) for k in range(SHINGLE)])


def _prefixes(rows: DataFrame, classes: Column) -> DataFrame:
    """rows (.., h) -> with ``prefix``: the first tokens of each line in ascending order, as many as the prefix filter asks for.

    Where ``places`` is sorted, the first of them hold the first tokens, unless they end within a bucket of words or repeat shingles."""
    rest = (1 << REST_BITS) - 1
    place = lambda first, i: F.coalesce(F.get(classes, _bucket(first)), F.lit(0).cast("long")).bitwiseOR(i.cast("long"))  # noqa: E731  never null, so sorted as plain numbers
    token = lambda x: x.bitwiseAND(F.lit(~rest)).bitwiseOR(F.shiftrightunsigned(_shingle(x.bitwiseAND(F.lit(rest)).cast("int")), 64 - REST_BITS))
    bucket = lambda x: F.shiftright(x, REST_BITS)
    most = (F.size("places") - _need(F.size("places")) + 1).cast("int")  # of n places: tokens are no more, and so neither is what their number asks for
    out = rows.withColumn("places", F.sort_array(F.transform(_firsts(), place))).withColumn("most", most)
    whole = F.col("most") >= F.size("places")
    last = F.get("places", F.col("most") - 1)
    apart = whole | (bucket(F.get("places", "most")) > bucket(last))
    chosen = F.when(apart, F.slice("places", F.lit(1), F.col("most"))).otherwise(F.filter("places", lambda x: bucket(x) <= bucket(last)))
    out = out.withColumn("chosen", chosen).withColumn("some", F.array_distinct(F.transform("chosen", token)))
    enough = (F.size("some") >= F.col("most")) | (F.size("chosen") == F.size("places"))
    tokens = F.when(enough, F.col("some")).otherwise(F.array_distinct(F.transform("places", token)))
    return out.withColumn("prefix", F.slice(F.sort_array(tokens), F.lit(1), F.col("most"))).drop("h", "places", "most", "chosen", "some")


def _overlap() -> Column:
    """The tokens that sets of n and m share at least if they are similar."""
    return F.ceil(F.lit(SIMILARITY / (1 + SIMILARITY)) * (F.col("n") + F.col("m")) - F.lit(1e-9))


def _with_both(pairs: DataFrame, table: DataFrame, value: str, other: str, small) -> DataFrame:
    """pairs with ``value`` of their line and, named ``other``, of the earlier one."""
    key, g = ["doc", "at", "print"], ["g_doc", "g_at", "g_print"]
    left = table.select(*key, value).join(small(pairs), key)
    right = table.select(*[F.col(k).alias(x) for k, x in zip(key, g)], F.col(value).alias(other)).join(small(pairs.select(*key, *g)), g)
    return left.join(right, [*key, *g])


def removed_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc, print, at): the lines to remove; doc is the id (null: the least long), print a hash of the text, at from 0."""
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.col(text).alias("text"))
    classes = _rarity(docs)
    split = docs.select("doc", F.xxhash64("text").alias("print"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    same_line = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(17), "line").alias("h2")]
    lines = written(_prefixes(_hashed(split.select("*", *same_line)).drop("line"), classes), "lines")
    place, key, g = F.struct("doc", "at", "print"), ["doc", "at", "print"], ["g_doc", "g_at", "g_print"]

    # prefix filter: the sets that share a token, in order of their first line
    sets = written(lines.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.count("*").alias("copies"), F.first("prefix").alias("prefix")), "line-sets")
    rows = sets.select("place.doc", "place.at", "place.print", F.posexplode("prefix").alias("i", "token"))
    # counted before they are put in order: a sort by one number is cheap, and few tokens are left for the other
    shared = rows.withColumn("of", F.count("*").over(Window.partitionBy("token"))).where("of > 1").drop("of")
    ranked = written(shared.withColumn("nth", F.row_number().over(Window.partitionBy("token").orderBy("doc", "at", "print"))), "line-tokens")

    # the whole token sets of the lines in question; of equal rows one will do
    by_doc = ranked.groupBy("doc", "print").agg(F.collect_set("at").alias("ats"))
    cut = F.expr("transform(array(split(text, '\n')), every -> transform(ats, a -> struct(a as at, get(every, a) as line)))[0]")  # split once, not for each line
    asked = docs.withColumn("print", F.xxhash64("text")).join(by_doc.hint("shuffle_hash"), ["doc", "print"]).select("doc", "print", F.explode(cut).alias("l"))
    asked = asked.select("doc", "print", "l.at", "l.line").dropDuplicates(key)
    whole = written(_hashed(asked).select(*key, F.array_distinct(F.transform(_firsts(), lambda _, i: _shingle(i))).alias("t")), "line-wholes")
    # each token turns one bit, so two sets differ in at least as many tokens as their bitmaps in bits
    bit = F.expr("shiftleft(1L, cast(token & 63 as int))")
    turned = [F.bit_xor(F.when(F.expr(f"pmod(shiftrightunsigned(token, 6), {BITMAPS}) = {k}"), bit).otherwise(F.lit(0).cast("long"))).alias(f"s{k}") for k in range(BITMAPS)]
    bitmaps = whole.select(*key, F.explode("t").alias("token")).groupBy(*key).agg(F.count("*").cast("int").alias("n"), *turned)
    signed = written(ranked.join(bitmaps, key), "line-signed")
    discard(ranked)
    ranked = signed

    # look back over the first, the next WIDER, the next WIDER squared, ... until a similar set is found
    matched, low, span, todo, tables = None, 1, 1, ranked, []
    most = ranked.agg(F.max("nth")).first()[0] or 0
    while low < most:
        before = ranked.where((F.col("nth") >= low) & (F.col("nth") < low + span)).select("token", *[F.col(k).alias(x) for k, x in zip(key, g)], F.col("n").alias("m"), F.col("i").alias("j"), F.col("nth").alias("earlier"), *[F.col(f"s{k}").alias(f"r{k}") for k in range(BITMAPS)])
        long_enough = (F.col("m") >= _need(F.col("n"))) & (F.col("n") >= _need(F.col("m")))
        in_place = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= _overlap()  # holds at the first shared token
        apart = sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"r{k}"))) for k in range(1, BITMAPS)), F.bit_count(F.col("s0").bitwiseXOR(F.col("r0"))))
        few_apart = apart <= F.col("n") + F.col("m") - 2 * _overlap()
        met = todo.join(before, (todo["token"] == before["token"]) & (F.col("nth") > F.col("earlier")) & long_enough & in_place & few_apart)
        pairs = written(met.select(*key, *g).distinct(), "line-pairs")
        small = F.broadcast if pairs.count() <= BROADCAST_PAIRS else (lambda df: df)  # a checked size of 48 bytes a pair
        same = F.size(F.array_intersect("t", "u"))
        alike = same >= F.lit(SIMILARITY) * (F.size("t") + F.size("u") - same) - F.lit(1e-9)
        found = written(_with_both(pairs, whole, "t", "u", small).where(alike).select(*key).distinct(), "line-matches")
        discard(pairs)
        tables.append(found)
        matched = found if matched is None else matched.unionByName(found)
        low, span = low + span, WIDER * span
        if low >= most:
            break
        left = written(todo.where(F.col("nth") > low).join(found, key, "left_anti"), "line-left")
        tables.append(left)
        todo = left
        most = todo.agg(F.max("nth")).first()[0] or 0
    # what goes: lines of a set that began before, and the first lines of sets that are similar to one before
    again = lines.select(*key, "h1", "h2").join(sets.where("copies > 1").select("h1", "h2", "place"), ["h1", "h2"]).where(place != F.col("place"))
    gone = again.select("doc", "print", "at")
    if matched is not None:
        gone = gone.unionByName(matched.select("doc", "print", "at")).distinct()
    out = written(gone, "lines-removed")
    for used in (lines, sets, ranked, whole, *tables):
        discard(used)
    return out


def _marked(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(row, gone): each row as a struct, and the numbers of its lines to remove (null: none)."""
    gone = removed_lines(docs, text, doc_id).groupBy(F.col("doc").alias("d"), F.col("print").alias("p")).agg(F.collect_set("at").alias("gone"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("print"))
    return rows.join(gone.hint("shuffle_hash"), (F.col("doc") == F.col("d")) & (F.col("print") == F.col("p")), "left").select("row", "gone")


def _kept(text: str) -> Column:
    left = F.expr(f"array_join(filter(split(row.`{text}`, '\\n'), (x, i) -> not array_contains(gone, i)), '\\n')")
    return F.when(F.col("gone").isNull(), F.col("row").getField(text)).otherwise(left)


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the removed lines in its texts; a text of which no line is left is empty."""
    marked = _marked(docs, text, doc_id)
    return marked.select(*[(_kept(text) if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])


def digest(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: its id, its lines, the lines removed, and SHA-256 of the text that is left (null: of the empty text)."""
    marked = _marked(docs, text, doc_id)
    n = F.coalesce(F.size(F.split(F.col("row").getField(text), "\n")), F.lit(0)).cast("long")
    n = F.when(F.col("row").getField(text).isNull(), F.lit(0).cast("long")).otherwise(n)
    return marked.select(F.col("row").getField(doc_id).alias(doc_id), n.alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"), F.sha2(F.coalesce(_kept(text), F.lit("")), 256).alias("kept_sha256"))
