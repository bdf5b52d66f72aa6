"""All queries of the snapshot engine over snapshots derived from the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from snapforge.functions import scalars
from snapforge.operators import blobs, codecs, diff, layout, manifest, match, reconstruct, regions, rename, routing
from snapforge.sources.snapshots import base_sql, rich_sql, table, target_sql, virtual

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_B, _T = f"b AS ({base_sql('duckdb')})", f"t AS ({target_sql('duckdb')})"
_RB, _RT = f"b AS ({rich_sql('duckdb', 'base')})", f"t AS ({rich_sql('duckdb', 'target')})"
_BT, _RBT = f"WITH {_B}, {_T}", f"WITH {_RB}, {_RT}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _both(spark, sf_dir, rich: bool = False):
    return virtual(spark, sf_dir, "base", rich), virtual(spark, sf_dir, "target", rich)


# Scans and statistics


@query(f"WITH {_RB} SELECT partition_no, path, entry_type, mode, uid, gid, mtime, size, link_target, dev, ino, nlink, rdev FROM b")
def snapshot_scan(spark, sf_dir):
    return virtual(spark, sf_dir, "base", True).select("partition_no", "path", "entry_type", "mode", "uid", "gid", "mtime", "size", "link_target", "dev", "ino", "nlink", "rdev")


@query(f"WITH {_RB} SELECT path, sha256(content) AS sha256 FROM b WHERE entry_type = 'file'")
def content_hash(spark, sf_dir):
    return virtual(spark, sf_dir, "base", True).where("entry_type = 'file'").select("path", scalars.sha256("content").alias("sha256"))


_STATS = """SELECT count_if(entry_type = 'file') AS files, count_if(entry_type = 'directory') AS directories,
  count_if(entry_type = 'symlink') AS symlinks, coalesce(sum(CASE WHEN entry_type = 'file' THEN size END), 0)::BIGINT AS total_bytes FROM {}"""


@query(f"WITH {_RB} {_STATS.format('b')}")
def tree_stats_base(spark, sf_dir):
    return diff.tree_stats(virtual(spark, sf_dir, "base", True))


@query(f"WITH {_RT} {_STATS.format('t')}")
def tree_stats_target(spark, sf_dir):
    return diff.tree_stats(virtual(spark, sf_dir, "target", True))


# Differences

_KINDS = """SELECT * FROM (SELECT coalesce(b.partition_no, t.partition_no) AS partition_no, coalesce(b.path, t.path) AS path,
  CASE WHEN b.path IS NULL THEN 'added' WHEN t.path IS NULL THEN 'removed'
    WHEN b.entry_type <> t.entry_type THEN 'changed'
    WHEN b.entry_type = 'symlink' THEN CASE WHEN b.link_target <> t.link_target THEN 'changed' WHEN b.uid <> t.uid OR b.gid <> t.gid THEN 'metadata_only' END
    WHEN b.entry_type = 'file' THEN CASE WHEN abs(b.mtime - t.mtime) > 1 AND b.sha256 <> t.sha256 THEN 'changed'
      WHEN b.mode <> t.mode OR b.uid <> t.uid OR b.gid <> t.gid OR abs(b.mtime - t.mtime) > 1 THEN 'metadata_only' END
    WHEN b.entry_type = 'directory' AND (b.mode <> t.mode OR b.uid <> t.uid OR b.gid <> t.gid OR abs(b.mtime - t.mtime) > 1) THEN 'metadata_only'
  END AS kind FROM b FULL JOIN t ON b.partition_no = t.partition_no AND b.path = t.path) k WHERE kind IS NOT NULL"""


@query(f"{_RBT} {_KINDS}")
def diff_kinds(spark, sf_dir):
    return diff.kinds(*_both(spark, sf_dir, True))


@query(f"{_BT} SELECT kind, count(*) AS n FROM ({_KINDS}) d GROUP BY kind")
def diff_counts(spark, sf_dir):
    return diff.counts(diff.kinds(*_both(spark, sf_dir)))


@query("SELECT 0::BIGINT AS disagreements")
def diff_symmetry(spark, sf_dir):
    return diff.symmetry(*_both(spark, sf_dir, True)).agg(F.count("*").alias("disagreements"))


_LINKS = """l AS (SELECT t.partition_no, t.path, g.canonical FROM t JOIN (SELECT partition_no, dev, ino, min(path) AS canonical FROM t
  WHERE entry_type = 'file' AND nlink > 1 GROUP BY ALL HAVING count(*) > 1) g USING (partition_no, dev, ino) WHERE t.entry_type = 'file' AND t.nlink > 1)"""

_PAIRED = """j AS (SELECT coalesce(b.partition_no, t.partition_no) AS partition_no, coalesce(b.path, t.path) AS path, b.path IS NOT NULL AS in_b, t.path IS NOT NULL AS in_t,
  b.entry_type AS bk, t.entry_type AS tk, b.mode AS bm, t.mode AS tm, b.uid AS bu, t.uid AS tu, b.gid AS bg, t.gid AS tg, b.mtime AS bt, t.mtime AS tt,
  b.size AS bs, t.size AS ts, b.sha256 AS bh, t.sha256 AS th, b.link_target AS bl, t.link_target AS tl, b.rdev AS br, t.rdev AS tr, l.canonical
  FROM b FULL JOIN t ON b.partition_no = t.partition_no AND b.path = t.path LEFT JOIN l ON l.partition_no = t.partition_no AND l.path = t.path),
m AS (SELECT *, bm <> tm OR bu <> tu OR bg <> tg OR abs(bt - tt) > 1 AS meta, CASE WHEN canonical <> path THEN canonical END AS hard FROM j)"""
_MAJOR, _MINOR = "((tr >> 8) & 4095)", "(tr & 255)"
_RECORDS = f"""SELECT partition_no, path AS old_path, NULL AS new_path, bk AS entry_type, bs AS size, CASE WHEN bk = 'file' THEN 'original_file' END AS data_kind,
    NULL AS link_to, NULL::BIGINT AS file_type_bits, NULL::BIGINT AS major, NULL::BIGINT AS minor, NULL AS patch_kind, NULL::BIGINT AS mode, NULL::BIGINT AS uid, NULL::BIGINT AS gid, NULL::BIGINT AS mtime
  FROM m WHERE in_b AND (NOT in_t OR bk <> tk OR (tk = 'special' AND ((bm & 61440) <> (tm & 61440) OR br <> tr)))
UNION ALL SELECT partition_no, NULL, path, CASE WHEN tk = 'file' AND hard IS NOT NULL THEN 'hardlink' ELSE tk END, CASE WHEN tk = 'file' AND hard IS NULL THEN ts ELSE 0 END,
    CASE tk WHEN 'symlink' THEN 'softlink_to' WHEN 'special' THEN 'special_device' WHEN 'file' THEN CASE WHEN hard IS NOT NULL THEN 'hardlink_to' ELSE 'lazy_blob' END END,
    CASE tk WHEN 'symlink' THEN tl WHEN 'file' THEN hard END, CASE WHEN tk = 'special' THEN tm & 61440 END, CASE WHEN tk = 'special' THEN {_MAJOR} END, CASE WHEN tk = 'special' THEN {_MINOR} END, NULL, tm, tu, tg, tt
  FROM m WHERE in_t AND (NOT in_b OR bk <> tk OR (tk = 'special' AND ((bm & 61440) <> (tm & 61440) OR br <> tr)))
UNION ALL SELECT partition_no, path, path, tk, CASE WHEN tk = 'file' THEN ts ELSE 0 END, CASE WHEN tk = 'symlink' AND bl <> tl THEN 'softlink_to' END, CASE WHEN tk = 'symlink' AND bl <> tl THEN tl END,
    NULL, NULL, NULL, CASE WHEN tk = 'file' AND bh <> th THEN 'lazy' END, CASE WHEN bm <> tm THEN tm END, CASE WHEN bu <> tu THEN tu END, CASE WHEN bg <> tg THEN tg END, CASE WHEN abs(bt - tt) > 1 THEN tt END
  FROM m WHERE in_b AND in_t AND bk = tk AND NOT (tk = 'special' AND ((bm & 61440) <> (tm & 61440) OR br <> tr))
    AND (meta OR (tk = 'symlink' AND bl <> tl) OR (tk = 'file' AND bh <> th))"""
_R = f"{_RBT}, {_LINKS}, {_PAIRED}, r AS ({_RECORDS})"
_R_PLAIN = f"{_BT}, {_LINKS}, {_PAIRED}, r AS ({_RECORDS})"


@query(f"{_R} SELECT * FROM r")
def entry_records(spark, sf_dir):
    return diff.records(*_both(spark, sf_dir, True))


@query(f"{_R} SELECT partition_no, path, CASE WHEN bm <> tm THEN tm END AS mode, CASE WHEN bu <> tu THEN tu END AS uid, CASE WHEN bg <> tg THEN tg END AS gid, CASE WHEN abs(bt - tt) > 1 THEN tt END AS mtime FROM m WHERE in_b AND in_t AND meta")
def metadata_sparse_diff(spark, sf_dir):
    return diff.metadata_diff(*_both(spark, sf_dir, True))


@query(f"WITH {_RT}, {_LINKS} SELECT * FROM l")
def hardlink_canonical(spark, sf_dir):
    return diff.hardlinks(virtual(spark, sf_dir, "target", True)).where("canonical is not null").select("partition_no", "path", "canonical")


@query(f"{_R} SELECT coalesce(new_path, old_path) AS path, count(*) AS n, min(entry_type) AS one, max(entry_type) AS other FROM r GROUP BY partition_no, coalesce(new_path, old_path) HAVING count(*) = 2")
def type_conflict_split(spark, sf_dir):
    r = diff.records(*_both(spark, sf_dir, True)).groupBy("partition_no", F.coalesce("new_path", "old_path").alias("path"))
    return r.agg(F.count("*").alias("n"), F.min("entry_type").alias("one"), F.max("entry_type").alias("other")).where("n = 2").drop("partition_no")


_RDEV = "event_id * 7919 + user_id * 1048576"


@query(f"SELECT event_id, 24576 AS bits, ((({_RDEV}) >> 8) & 4095) | ((({_RDEV}) >> 32) & ~4095) AS major, (({_RDEV}) & 255) | ((({_RDEV}) >> 12) & ~255) AS minor FROM events")
def device_info(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", f"cast({_RDEV} as bigint) as rdev", "cast(24576 + 420 as bigint) as mode")
    return e.select("event_id", scalars.type_bits("mode").cast("int").alias("bits"), scalars.major("rdev").alias("major"), scalars.minor("rdev").alias("minor"))


@query(f"{_BT} SELECT b.partition_no, b.path, b.sha256 FROM b LEFT JOIN t ON b.partition_no = t.partition_no AND b.path = t.path WHERE t.path IS NULL")
def unique_side_hashes(spark, sf_dir):
    return diff.unique_hashes(*_both(spark, sf_dir))


# Content-addressed blobs

_UUID5 = "(SELECT {h}[1:8] || '-' || {h}[9:12] || '-5' || {h}[14:16] || '-' || substr('89ab89ab89ab89ab', 1 + strpos('0123456789abcdef', {h}[17:17]) - 1, 1) || {h}[18:20] || '-' || {h}[21:32])"
_ID = _UUID5.format(h="sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(sha256))")


@query("SELECT sha256(text) AS sha256, min(doc_id::VARCHAR) AS path, count(*) AS copies FROM documents GROUP BY 1")
def dedup_groups(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), F.col("doc_id").cast("string").alias("path"), F.octet_length("text").alias("size"))
    return blobs.groups(files).select("sha256", "path", "copies")


def _existing(files: DataFrame) -> DataFrame:
    return files.where("doc_id % 3 = 0").select("sha256", F.concat(F.lit("known-"), F.substring("sha256", 1, 8)).alias("blob_id")).distinct()


_GROUPS = f"""{_BT}, f AS (SELECT sha256, min(path) AS path, count(*) AS copies, min(size) AS size FROM t GROUP BY sha256),
 k AS (SELECT DISTINCT sha256, 'known-' || sha256[1:8] AS blob_id FROM b WHERE doc_id % 3 = 0)"""


@query(f"{_GROUPS} SELECT count_if(k.sha256 IS NULL) AS uploaded, (sum(copies) - count_if(k.sha256 IS NULL))::BIGINT AS deduped, coalesce(sum(CASE WHEN k.sha256 IS NULL THEN size END), 0)::BIGINT AS uploaded_bytes FROM f LEFT JOIN k USING (sha256)")
def dedup_accounting(spark, sf_dir):
    b, t = _both(spark, sf_dir)
    return blobs.accounting(blobs.groups(t, _existing(b)))


@query(f"SELECT sha256, {_ID} AS blob_id FROM (SELECT DISTINCT sha256(text) AS sha256 FROM documents) d")
def blob_uuid5(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256")).distinct().select("sha256", scalars.uuid5_oid("sha256").alias("blob_id"))


@query(f"{_GROUPS} SELECT f.sha256, f.path, f.copies, coalesce(k.blob_id, {_ID.replace('encode(sha256)', 'encode(f.sha256)')}) AS blob_id, k.sha256 IS NULL AS is_new FROM f LEFT JOIN k ON f.sha256 = k.sha256")
def existing_blob_join(spark, sf_dir):
    b, t = _both(spark, sf_dir)
    return blobs.groups(t, _existing(b)).select("sha256", "path", "copies", "blob_id", "is_new")


# Matching of paths

_EXT = "regexp_extract(string_split({p}, '/')[-1], '^.+\\.([^.]*)$', 1)"


def _keys(side: str, path: str) -> str:
    return f"{path}, {_EXT.format(p=path)} AS {side}_ext, string_split({path}, '/')[1] AS {side}_first, strlen({path})::BIGINT AS {side}_bytes, strlen({path}) // 10 AS {side}_near"


_POOLS = f"""{_BT}, removed AS (SELECT b.partition_no, b.path AS source_path, b.sha256 FROM b LEFT JOIN t ON b.partition_no = t.partition_no AND b.path = t.path WHERE t.path IS NULL),
added AS (SELECT t.partition_no, t.path AS target_path, t.sha256 FROM t LEFT JOIN b ON b.partition_no = t.partition_no AND b.path = t.path WHERE b.path IS NULL),
sk AS (SELECT partition_no, sha256 AS s_sha, {_keys('s', 'source_path')} FROM removed), tk AS (SELECT partition_no, sha256 AS t_sha, {_keys('t', 'target_path')} FROM added)"""
_BLOCKS = """SELECT * FROM (SELECT *, min(class) OVER (PARTITION BY partition_no, target_path) AS best FROM (
  SELECT tk.*, sk.* EXCLUDE (partition_no), CASE WHEN t_ext = s_ext THEN CASE WHEN t_first = s_first AND abs(t_near - s_near) <= 2 THEN 1 WHEN t_first = s_first THEN 2 WHEN abs(t_near - s_near) <= 2 THEN 3 ELSE 4 END
    ELSE CASE WHEN abs(t_near - s_near) <= 2 THEN 5 ELSE 6 END END AS class
  FROM tk JOIN sk ON tk.partition_no = sk.partition_no AND (t_ext = s_ext OR t_first = s_first)) c) d WHERE class = best"""


def _pools(spark, sf_dir):
    b, t = _both(spark, sf_dir)
    key = ["partition_no", "path"]
    removed = b.select(*key, "sha256").join(t.select(*key), key, "left_anti").withColumnRenamed("path", "source_path")
    added = t.select(*key, "sha256").join(b.select(*key), key, "left_anti").withColumnRenamed("path", "target_path")
    return removed, added


@query(f"{_POOLS} SELECT partition_no, target_path, source_path, class::INTEGER AS class FROM ({_BLOCKS}) x")
def candidate_blocks(spark, sf_dir):
    removed, added = _pools(spark, sf_dir)
    return match.blocks(removed, added, ["partition_no"]).select("partition_no", "target_path", "source_path", "class")


# The distance by rows of its table, one character of the (byte-)longer string at a time, for all pairs together.
_DIGIT = "strpos('0123456789', {c}) > 0"
_COST = f"CASE WHEN c = l.y[j] THEN 0.0 WHEN {_DIGIT.format(c='c')} AND {_DIGIT.format(c='l.y[j]')} THEN l.w WHEN {_DIGIT.format(c='c')} OR {_DIGIT.format(c='l.y[j]')} THEN 0.7 ELSE 1.0 END"
_LET = "list_transform([{v}], lambda {n}: {e})[1]"
def _levenshtein(n: str = "") -> str:
    """CTEs z, lev and d over the pairs (u, v, w) of want; names end in n."""
    return f"""z{n} AS (SELECT u, v, w, strlen(u) < strlen(v) AS turn FROM (SELECT DISTINCT u, v, w FROM want{n}) q),
 lev{n}(u, v, w, i, x, y, cells) AS (
  SELECT u, v, w, 0::BIGINT, string_split(CASE WHEN turn THEN v ELSE u END, ''), string_split(CASE WHEN turn THEN u ELSE v END, ''),
    list_transform(range(0, length(CASE WHEN turn THEN u ELSE v END) + 1), lambda j: j::DOUBLE) FROM z{n}
  UNION ALL
  SELECT l.u, l.v, l.w, l.i + 1, l.x, l.y, {_LET.format(v='x[l.i + 1]', n='c', e=_LET.format(v="list_concat([l.cells[1] + 1], list_transform(range(1, len(l.cells)), lambda j: least(l.cells[j + 1] + 1, l.cells[j] + " + _COST + ")))", n='base', e="list_transform(range(0, len(l.cells)), lambda j: j + list_min(list_transform(range(0, j + 1), lambda k: base[k + 1] - k)))"))}
  FROM lev{n} l WHERE l.i < CASE WHEN l.x[1] = '' THEN 0 ELSE len(l.x) END),
 d{n} AS (SELECT u, v, w, cells[-1] AS dist, list_min(cells) AS least_cell FROM lev{n} WHERE i = CASE WHEN x[1] = '' THEN 0 ELSE len(x) END)"""


def _scored(source: str, min_score: float, first_weight: float, keys: str, n: str = "") -> str:
    """CTEs want, z, lev, d and e: e has keys, target_path, source_path and score of the pairs of ``source`` (a query)."""
    return f"""pairs{n} AS ({source}),
 parts{n} AS (SELECT *, list_filter(string_split(target_path, '/'), lambda q: q <> '') AS p, list_filter(string_split(source_path, '/'), lambda q: q <> '') AS q FROM pairs{n}),
 want{n} AS (SELECT target_path AS u, source_path AS v, 0.3::DOUBLE AS w FROM parts{n} UNION ALL SELECT coalesce(p[-1], ''), coalesce(q[-1], ''), 1.0 FROM parts{n}), {_levenshtein(n)},
 terms{n} AS (SELECT parts{n}.*, a.dist, a.least_cell, b.dist AS name_dist, greatest(strlen(target_path), 200) * 0.3 AS most, abs(strlen(target_path) - strlen(source_path)) AS gap, greatest(strlen(target_path), strlen(source_path)) AS longest,
    greatest(len(p), len(q)) AS deep, range(1, least(len(p), len(q)) + 1) AS spots, greatest(strlen(coalesce(p[-1], '')), strlen(coalesce(q[-1], ''))) AS name_len
  FROM parts{n} JOIN d{n} a ON a.u = target_path AND a.v = source_path AND a.w = 0.3 JOIN d{n} b ON b.u = coalesce(p[-1], '') AND b.v = coalesce(q[-1], '') AND b.w = 1.0),
 sums{n} AS (SELECT *, coalesce(list_sum(list_transform(spots, lambda k: 1 / sqrt(k))), 0) AS weight, len(list_filter(spots, lambda k: p[k] = q[k])) AS common,
    coalesce(list_sum(list_transform(spots, lambda k: CASE WHEN p[k] = q[k] THEN 1 / sqrt(k) WHEN k IN (2, 3) THEN -0.3 / k ELSE 0.0 END)), 0) AS place FROM terms{n}),
 e{n} AS (SELECT * FROM (SELECT {keys}target_path, source_path, CASE WHEN gap > most OR least_cell > most THEN 0.0 ELSE greatest(0.0, least(1.0,
    0.5 * CASE WHEN longest = 0 THEN 1.0 ELSE 1 - dist / longest END + 0.3 * CASE WHEN deep > 0 THEN common / deep ELSE 0.0 END + 0.2 * CASE WHEN weight > 0 THEN place / weight ELSE 0.0 END
    - CASE WHEN deep > 0 THEN abs(len(p) - len(q)) / deep * 0.3 ELSE 0.0 END - CASE WHEN len(p) > 0 AND len(q) > 0 AND p[1] <> q[1] THEN {first_weight} * 0.1 ELSE 0.0 END
    - CASE WHEN coalesce(p[-1], '') <> coalesce(q[-1], '') AND name_len > 0 THEN name_dist / name_len * 0.15 ELSE 0.0 END)) END AS score FROM sums{n}) f WHERE score >= {min_score})"""


_FILTERED = "SELECT {keys}target_path, source_path FROM ({blocks}) x WHERE abs(t_bytes - s_bytes) <= 0.4 * greatest(t_bytes, s_bytes) AND (t_first = s_first OR t_ext = s_ext)"


def _greedy(group: str, name: str = "g", edges: str = "e") -> str:
    """CTEs that take the edges in order if both ends are free; ends of different groups are different."""
    return f"""{name}o AS (SELECT *, {group} || ':' || target_path AS te, {group} || ':' || source_path AS se, row_number() OVER (ORDER BY score DESC, target_path, source_path, {group}) AS n FROM {edges}),
 {name}r(n, ts, ss, taken) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], false UNION ALL
  SELECT o.n, CASE WHEN ok THEN list_append(r.ts, o.te) ELSE r.ts END, CASE WHEN ok THEN list_append(r.ss, o.se) ELSE r.ss END, ok
  FROM {name}r r JOIN {name}o o ON o.n = r.n + 1, LATERAL (SELECT NOT list_contains(r.ts, o.te) AND NOT list_contains(r.ss, o.se) AS ok) y),
 {name} AS (SELECT o.* FROM {name}o o JOIN {name}r r USING (n) WHERE r.taken)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_ALL_PAIRS = f"SELECT DISTINCT target_path, source_path FROM ({_BLOCKS}) x"
_EXACT_BLOCKS = _BLOCKS.replace("PARTITION BY partition_no, target_path", "PARTITION BY partition_no, s_sha, target_path").replace("tk.partition_no = sk.partition_no AND", "tk.partition_no = sk.partition_no AND t_sha = s_sha AND")


@query(_recursive(f"{_POOLS}, k AS (SELECT partition_no, target_path, source_path, string_split(target_path, '/')[-1] AS u, string_split(source_path, '/')[-1] AS v FROM ({_BLOCKS}) x), want AS (SELECT u, v, 0.3::DOUBLE AS w FROM k), {_levenshtein()} SELECT partition_no, target_path, source_path FROM (SELECT *, row_number() OVER (PARTITION BY partition_no, target_path ORDER BY floor(dist * 1000), source_path) AS n FROM k JOIN d USING (u, v)) r WHERE n <= 5"))
def candidate_topk(spark, sf_dir):
    """The five candidates with the nearest names, where there are more (the engine's own bound is 500)."""
    removed, added = _pools(spark, sf_dir)
    return match.nearest(removed, added, ["partition_no"], 5).select("partition_no", "target_path", "source_path")


@query(SQL["candidate_topk"].replace("WHERE n <= 5", f"WHERE n <= {match.MOST_CANDIDATES}"))
def candidate_topk_whole(spark, sf_dir):
    """As ``candidate_topk``, at the engine's own bound."""
    removed, added = _pools(spark, sf_dir)
    return match.nearest(removed, added, ["partition_no"]).select("partition_no", "target_path", "source_path")


@query(_recursive(f"{_POOLS}, k AS ({_ALL_PAIRS}), want AS (SELECT target_path AS u, source_path AS v, 0.3::DOUBLE AS w FROM k), {_levenshtein()} SELECT u AS target_path, v AS source_path, round(dist, 9) AS distance FROM d"))
def levenshtein_weighted(spark, sf_dir):
    removed, added = _pools(spark, sf_dir)
    return match.compared(removed, added, ["partition_no"], "distance", "distance").withColumn("distance", F.round("distance", 9))


@query(_recursive(f"{_POOLS}, {_scored(_ALL_PAIRS, 0.0, 5.0, '')} SELECT target_path, source_path, round(score, 9) AS score FROM e"))
def path_similarity(spark, sf_dir):
    removed, added = _pools(spark, sf_dir)
    return match.compared(removed, added, ["partition_no"], "score", "score").withColumn("score", F.round("score", 9))


_EXACT = f"{_POOLS}, {_scored(_FILTERED.format(keys='partition_no, s_sha AS sha256, ', blocks=_EXACT_BLOCKS), 0.0, 0.0, 'partition_no, sha256, ')}, {_greedy('partition_no || sha256')}"


@query(_recursive(f"{_EXACT} SELECT partition_no, sha256, target_path, source_path, round(score, 9) AS score FROM g"))
def rename_exact(spark, sf_dir):
    out = rename.exact(*_pools(spark, sf_dir))
    return out.withColumn("score", F.round("score", 9))


_LEFT = """, sk2 AS (SELECT sk.* FROM sk WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.partition_no = sk.partition_no AND g.source_path = sk.source_path)),
 tk2 AS (SELECT tk.* FROM tk WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.partition_no = tk.partition_no AND g.target_path = tk.target_path))"""


_BLOCKS_LEFT = _BLOCKS.replace("FROM tk JOIN sk ON tk.partition_no = sk.partition_no", "FROM tk2 tk JOIN sk2 sk ON tk.partition_no = sk.partition_no")


@query(_recursive(f"{_EXACT}{_LEFT}, {_scored(_FILTERED.format(keys='partition_no, ', blocks=_BLOCKS_LEFT), 0.6, 0.0, 'partition_no, ', '2')}, {_greedy('partition_no', 'h', 'e2')} SELECT partition_no, target_path, source_path, round(score, 9) AS score, 1 AS pass FROM g UNION ALL SELECT partition_no, target_path, source_path, round(score, 9), 2 FROM h"))
def rename_fuzzy(spark, sf_dir):
    return rename.matches(*_pools(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey % 200 AS t, l_partkey % 200 AS s, (l_orderkey * 31 + l_partkey * 17) % 97 / 97.0::DOUBLE AS score FROM lineitem WHERE l_linenumber = 1),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, printf('t%03d', t), printf('s%03d', s)) AS n FROM e),
g(n, ts, ss, t, s, score, taken) AS (
  SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, false
  UNION ALL
  SELECT o.n, CASE WHEN ok THEN list_append(g.ts, o.t) ELSE g.ts END, CASE WHEN ok THEN list_append(g.ss, o.s) ELSE g.ss END, o.t, o.s, o.score, ok
  FROM g JOIN o ON o.n = g.n + 1, LATERAL (SELECT NOT list_contains(g.ts, o.t) AND NOT list_contains(g.ss, o.s) AS ok) x)
SELECT printf('t%03d', t) AS target_path, printf('s%03d', s) AS source_path, score FROM g WHERE taken""")
def bijection(spark, sf_dir):
    """Greedy one-to-one assignment with many ties."""
    e = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").selectExpr("l_orderkey % 200 as t", "l_partkey % 200 as s", "(l_orderkey * 31 + l_partkey * 17) % 97 / cast(97 as double) as score").distinct()
    return match.bijection(e.select(F.format_string("t%03d", F.col("t").cast("long")).alias("target_path"), F.format_string("s%03d", F.col("s").cast("long")).alias("source_path"), "score"))


@query()
def bijection_whole(spark, sf_dir):
    """As ``bijection``, over the edges of all lines between whole keys; lists in recursive SQL are too slow for that."""
    e = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as t", "l_partkey as s", "(l_orderkey * 31 + l_partkey * 17) % 97 / cast(97 as double) as score").distinct()
    return match.bijection(e.select(F.format_string("t%012d", F.col("t").cast("long")).alias("target_path"), F.format_string("s%012d", F.col("s").cast("long")).alias("source_path"), "score"))


_PAGES = f"""WITH paths AS (SELECT regexp_replace(url, '^[a-z]+://', '') AS path, min(page_id) AS page_id FROM pages GROUP BY 1),
removed AS (SELECT 0 AS partition_no, path AS source_path, '' AS sha256 FROM paths WHERE page_id % 2 = 0), added AS (SELECT 0 AS partition_no, path AS target_path, '' AS sha256 FROM paths WHERE page_id % 2 = 1),
sk AS (SELECT partition_no, sha256 AS s_sha, {_keys('s', 'source_path')} FROM removed), tk AS (SELECT partition_no, sha256 AS t_sha, {_keys('t', 'target_path')} FROM added)"""


@query(_recursive(f"{_PAGES}, {_scored(_FILTERED.format(keys='partition_no, ', blocks=_BLOCKS), 0.5, 5.0, 'partition_no, ')}, {_greedy('partition_no')} SELECT target_path, source_path, round(score, 9) AS score FROM g"))
def url_paths_match(spark, sf_dir):
    """Urls of pages with odd ids, matched with those of even ids."""
    paths = table(spark, sf_dir, "pages").groupBy(F.regexp_replace("url", r"^[a-z]+://", "").alias("path")).agg(F.min("page_id").alias("page_id"))
    s, t = paths.where("page_id % 2 = 0").select(F.col("path").alias("source_path")), paths.where("page_id % 2 = 1").select(F.col("path").alias("target_path"))
    return match.assigned(s, t).withColumn("score", F.round("score", 9))


def _origins(base: DataFrame) -> DataFrame:
    return base.where("doc_id % 4 = 0").select("partition_no", F.regexp_replace("path", "-1.0.", "-0.9.").alias("path"), F.col("doc_id").alias("ordinal"), F.concat(F.lit("blob-"), F.col("doc_id").cast("string")).alias("blob_id"))


_ORIGINS = f"""{_BT}, removed AS (SELECT partition_no, regexp_replace(path, '-1.0.', '-0.9.') AS source_path, 'blob-' || doc_id AS sha256 FROM b WHERE doc_id % 4 = 0),
added AS (SELECT t.partition_no, t.path AS target_path, t.sha256 FROM t LEFT JOIN b ON b.partition_no = t.partition_no AND b.path = t.path WHERE b.path IS NULL
  AND NOT EXISTS (SELECT 1 FROM (SELECT partition_no, dev, ino, min(path) AS canonical FROM t WHERE nlink > 1 GROUP BY ALL HAVING count(*) > 1) l WHERE l.partition_no = t.partition_no AND l.dev = t.dev AND l.ino = t.ino AND t.nlink > 1 AND l.canonical <> t.path)),
sk AS (SELECT partition_no, sha256 AS s_sha, {_keys('s', 'source_path')} FROM removed), tk AS (SELECT partition_no, sha256 AS t_sha, {_keys('t', 'target_path')} FROM added)"""


@query(_recursive(f"{_ORIGINS}, {_scored(_FILTERED.format(keys='partition_no, s_sha AS blob_id, ', blocks=_BLOCKS), 0.5, 5.0, 'partition_no, blob_id, ')}, {_greedy('partition_no')} SELECT partition_no, target_path AS new_path, 'blob_ref' AS data_kind, 'lazy' AS patch_kind, blob_id AS source_blob_id FROM g"))
def blob_lookup(spark, sf_dir):
    b, t = _both(spark, sf_dir)
    out = rename.blob_lookup(diff.records(b, t), _origins(b))
    return out.where("source_blob_id is not null").select("partition_no", "new_path", "data_kind", "patch_kind", "source_blob_id")


#: The SQL of the next query, too slow on whole tables; tests run it on the smallest.
BLOB_LOOKUP_WHOLE = SQL["blob_lookup"].replace(" FROM b WHERE doc_id % 4 = 0)", " FROM b)")


@query()
def blob_lookup_whole(spark, sf_dir):
    """As ``blob_lookup``, with every file of the base as an origin."""
    b, t = _both(spark, sf_dir)
    origins = b.select("partition_no", F.regexp_replace("path", "-1.0.", "-0.9.").alias("path"), F.col("doc_id").alias("ordinal"), F.concat(F.lit("blob-"), F.col("doc_id").cast("string")).alias("blob_id"))
    out = rename.blob_lookup(diff.records(b, t), origins)
    return out.where("source_blob_id is not null").select("partition_no", "new_path", "data_kind", "patch_kind", "source_blob_id")


# Records on their way to a manifest

_RECORD_COLUMNS = ["partition_no", "old_path", "new_path", "entry_type", "size", "data_kind", "link_to", "file_type_bits", "major", "minor", "patch_kind", "mode", "uid", "gid", "mtime"]
_CLEAN = "CASE WHEN new_path IS NOT NULL THEN {c} END AS {c}"


@query(f"{_R} SELECT partition_no, old_path, new_path, entry_type, size, {', '.join(_CLEAN.format(c=c) for c in _RECORD_COLUMNS[5:])} FROM r")
def cleanup_records(spark, sf_dir):
    return rename.cleanup(diff.records(*_both(spark, sf_dir, True)))


@query(f"{_R} SELECT partition_no, count(*) AS records, count_if(old_path IS NULL) AS added FROM r WHERE patch_kind IS NULL OR patch_kind <> 'lazy' GROUP BY partition_no")
def finalize_records(spark, sf_dir):
    r = manifest.finalise(diff.records(*_both(spark, sf_dir, True)))
    return r.groupBy("partition_no").agg(F.count("*").alias("records"), F.count_if(F.col("old_path").isNull()).alias("added"))


@query(f"{_R} SELECT partition_no, coalesce(new_path, old_path) AS path, row_number() OVER (PARTITION BY partition_no ORDER BY coalesce(new_path, old_path), new_path IS NOT NULL) - 1 AS ordinal, printf('p%d/%06d.patch', partition_no, row_number() OVER (PARTITION BY partition_no ORDER BY coalesce(new_path, old_path), new_path IS NOT NULL) - 1) AS archive_entry FROM r")
def patch_names(spark, sf_dir):
    r = manifest.numbered(diff.records(*_both(spark, sf_dir, True))).withColumn("ordinal", F.col("ordinal").cast("long"))
    return r.select("partition_no", F.coalesce("new_path", "old_path").alias("path"), "ordinal", scalars.archive_entry("partition_no", "ordinal").alias("archive_entry"))


# Routing

ROUTER = routing.Router(
    rules=(
        routing.Glob("src1*/**", routing.TEXT),
        routing.Glob("**/doc-?[0-4]*.en", routing.PASSTHROUGH),
        routing.Elf(routing.BINARY),
        routing.Magic("546865", routing.EXTENDED, "the"),
        routing.Size(500, routing.TEXT),
    ),
    fallback=routing.BINARY,
    threshold=0.5,
    extended={"the": (None, None)},
)
_FILES = """f AS (SELECT source || '/' || lang || '/doc-' || doc_id || '.' || lang AS path, strlen(text)::BIGINT AS size,
  CASE WHEN doc_id % 31 = 0 THEN unhex('7f454c46') || encode(text) ELSE encode(text) END[1:16] AS header, doc_id FROM documents),
g AS (SELECT *, regexp_full_match(path, 'src1.*/(.*/)?.*') AS m0, regexp_full_match(path, '(.*/)?doc-.[0-4].*\\.en') AS m1, starts_with(hex(header), '7F454C46') AS m2, starts_with(hex(header), '546865') AS m3, size <= 500 AS m4 FROM f)"""
_RULE = "CASE WHEN m0 THEN 0 WHEN m1 THEN 1 WHEN m2 THEN 2 WHEN m3 THEN 3 WHEN m4 THEN 4 ELSE -1 END"
_CODE = "CASE WHEN m0 THEN 2 WHEN m1 THEN 0 WHEN m2 THEN 1 WHEN m3 THEN 255 WHEN m4 THEN 2 ELSE 1 END"


def _files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    content = F.when(F.col("doc_id") % 31 == 0, F.concat(F.unhex(F.lit("7f454c46")), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    return d.select(F.concat_ws("", "source", F.lit("/"), "lang", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"), F.octet_length("text").cast("long").alias("size"), scalars.header(content).alias("header"), "doc_id")


@query(f"WITH {_FILES} SELECT path, CASE WHEN path LIKE '%.en' THEN CASE WHEN size <= 800 THEN 0 ELSE 2 END ELSE {_CODE} END AS code, CASE WHEN path LIKE '%.en' THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS threshold FROM g")
def route_nested(spark, sf_dir):
    """A router for English files within one whose fallback is a router."""
    english = routing.Router((routing.Size(800, routing.PASSTHROUGH),), routing.TEXT, 0.25)
    router = routing.Router((routing.Glob("*.en", english),), ROUTER, 0.75)
    return _files(spark, sf_dir).select("path", router.code().alias("code"), router.limit().alias("threshold"))


@query(f"WITH {_FILES} SELECT path, {_RULE} AS rule, {_CODE} AS code FROM g")
def route_encoder(spark, sf_dir):
    return _files(spark, sf_dir).select("path", ROUTER.rule_number().alias("rule"), ROUTER.code().alias("code"))


def _rule_query(n: int):
    def run(spark, sf_dir):
        return _files(spark, sf_dir).select("path", ROUTER.rules[n].accepts().alias("accepts"))

    return run


for _name, _n in (("route_glob", 1), ("route_elf", 2), ("route_magic", 3), ("route_size", 4)):
    QUERIES[_name], SQL[_name] = _rule_query(_n), f"WITH {_FILES} SELECT path, m{_n} AS accepts FROM g"


@query(f"WITH {_FILES} SELECT path, size // 3 + doc_id % 700 > size * 0.5 AS verbatim, CASE WHEN size // 3 + doc_id % 700 > size * 0.5 THEN 0 ELSE {_CODE} END AS code FROM g")
def passthrough_fallback(spark, sf_dir):
    f = _files(spark, sf_dir).withColumn("patch_bytes", F.expr("size div 3 + doc_id % 700"))
    verbatim = ROUTER.verbatim("patch_bytes", "size")
    return f.select("path", verbatim.alias("verbatim"), F.when(verbatim, 0).otherwise(ROUTER.code()).alias("code"))


@query("SELECT doc_id, doc_id % 4 IN (0, 1, 2) OR (doc_id % 8 = 3) AS known FROM documents")
def decoder_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "cast(case when doc_id % 4 = 3 then 255 else doc_id % 4 end as int) as code", "case when doc_id % 8 = 3 then 'the' end as codec_id")
    return d.select("doc_id", ROUTER.knows("code", "codec_id").alias("known"))


# Codecs


def _pairs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    changed = F.concat(F.substring("text", 1, 100), F.lit("[edited]\n"), F.expr("substring(text, 121)"), F.lit("\nend"))
    return d.select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("source"), changed.cast("binary").alias("target"))


_EDITED = "SELECT doc_id::VARCHAR AS path, true AS ok, sha256(substr(text, 1, 100) || '[edited]' || chr(10) || substr(text, 121) || chr(10) || 'end') AS sha256 FROM documents"


@query(_EDITED)
def text_diff_roundtrip(spark, sf_dir):
    return codecs.round_trip(_pairs(spark, sf_dir), routing.TEXT)


@query(_EDITED)
def binary_diff_roundtrip(spark, sf_dir):
    return codecs.round_trip(_pairs(spark, sf_dir), routing.BINARY)


@query(_EDITED)
def passthrough_roundtrip(spark, sf_dir):
    return codecs.round_trip(_pairs(spark, sf_dir), routing.PASSTHROUGH)


# Reconstruction

_CONTENTS = "SELECT t.partition_no, t.path, t.sha256, t.size FROM t JOIN r ON t.partition_no = r.partition_no AND t.path = r.new_path WHERE r.data_kind = 'lazy_blob' OR r.patch_kind = 'lazy'"


def _linkless(spark, sf_dir):
    """Snapshots without hard links: the derived ones link files with different texts."""
    return [s.withColumns({"nlink": F.lit(1).cast("long"), "ino": F.col("doc_id")}) for s in _both(spark, sf_dir, True)]


def _applied(spark, sf_dir):
    b, t = _linkless(spark, sf_dir)
    r = diff.records(b, t)
    contents = t.select("partition_no", "path", "sha256", "size").join(r.where("data_kind = 'lazy_blob' or patch_kind = 'lazy'").select("partition_no", F.col("new_path").alias("path")), ["partition_no", "path"], "left_semi")
    return b, t, r, contents


@query(f"{_R} SELECT b.partition_no, b.path FROM b LEFT JOIN r ON b.partition_no = r.partition_no AND b.path = r.old_path WHERE r.old_path IS NULL")
def copy_unchanged(spark, sf_dir):
    b, t = _both(spark, sf_dir, True)
    return reconstruct.copied(b, diff.records(b, t)).select("partition_no", "path")


@query(f"WITH {_RT}, {_RB} SELECT t.partition_no, t.path, t.entry_type, t.mode, t.uid, t.gid, CASE WHEN abs(t.mtime - b.mtime) <= 1 AND t.entry_type = b.entry_type AND NOT (t.entry_type = 'special' AND b.rdev <> t.rdev) THEN b.mtime ELSE t.mtime END AS mtime, t.size, t.sha256, t.link_target, t.rdev FROM t LEFT JOIN b ON t.partition_no = b.partition_no AND t.path = b.path")
def reconstruct_target(spark, sf_dir):
    b, _, r, contents = _applied(spark, sf_dir)
    return reconstruct.rebuilt(b, r, contents).select("partition_no", "path", "entry_type", "mode", "uid", "gid", "mtime", "size", "sha256", "link_target", "rdev")


_LINKED_SQL = "(SELECT * REPLACE (CASE WHEN entry_type = 'file' AND nlink > 1 THEN sha256('linked ' || ino) ELSE sha256 END AS sha256, CASE WHEN entry_type = 'file' AND nlink > 1 THEN strlen('linked ' || ino) ELSE size END AS size, CASE WHEN entry_type = 'special' THEN rdev + doc_id % 9 * 1048576 ELSE rdev END AS rdev) FROM ({side}) y)"


def _linked(spark, sf_dir):
    """Both snapshots with files that share an inode sharing their content too, and devices whose minors pass 255."""
    shared = (F.col("entry_type") == "file") & (F.col("nlink") > 1)
    text = F.concat(F.lit("linked "), F.col("ino").cast("string"))
    change = {"sha256": F.when(shared, F.sha2(text, 256)).otherwise(F.col("sha256")), "size": F.when(shared, F.octet_length(text)).otherwise(F.col("size")).cast("long"), "rdev": F.when(F.col("entry_type") == "special", F.col("rdev") + F.col("doc_id") % 9 * 1048576).otherwise(F.col("rdev"))}
    return [s.withColumns(change) for s in _both(spark, sf_dir, True)]


@query(f"""WITH t AS {_LINKED_SQL.format(side=rich_sql('duckdb', 'target'))}, b AS {_LINKED_SQL.format(side=rich_sql('duckdb', 'base'))}
SELECT t.partition_no, t.path, t.entry_type, t.mode, t.uid, t.gid, CASE WHEN abs(t.mtime - b.mtime) <= 1 AND t.entry_type = b.entry_type AND NOT (t.entry_type = 'special' AND b.rdev <> t.rdev) THEN b.mtime ELSE t.mtime END AS mtime, t.size, t.sha256, t.rdev FROM t LEFT JOIN b ON t.partition_no = b.partition_no AND t.path = b.path""")
def reconstruct_links(spark, sf_dir):
    """The target with its hard links, many of them new links to files that the records do not touch, and large devices."""
    b, t = _linked(spark, sf_dir)
    r = diff.records(b, t)
    contents = t.select("partition_no", "path", "sha256", "size").join(r.where("data_kind = 'lazy_blob' or patch_kind = 'lazy'").select("partition_no", F.col("new_path").alias("path")), ["partition_no", "path"], "left_semi")
    return reconstruct.rebuilt(b, r, contents).select("partition_no", "path", "entry_type", "mode", "uid", "gid", "mtime", "size", "sha256", "rdev")


@query("SELECT 0::BIGINT AS problems")
def reconstruct_verify(spark, sf_dir):
    b, t, r, contents = _applied(spark, sf_dir)
    return diff.compare(t, reconstruct.rebuilt(b, r, contents)).agg(F.count("*").alias("problems"))


@query(f"{_RBT} SELECT partition_no, path, problem FROM (SELECT coalesce(b.partition_no, t.partition_no) AS partition_no, coalesce(b.path, t.path) AS path, unnest(CASE WHEN b.path IS NULL THEN ['extra'] WHEN t.path IS NULL THEN ['missing'] WHEN b.entry_type <> t.entry_type THEN ['entry_type'] ELSE list_filter([CASE WHEN b.entry_type <> 'symlink' AND b.mode <> t.mode THEN 'mode' END, CASE WHEN b.link_target <> t.link_target THEN 'link_target' END, CASE WHEN b.sha256 <> t.sha256 THEN 'sha256' END, CASE WHEN b.entry_type = 'file' AND b.size <> t.size THEN 'size' END, CASE WHEN b.entry_type = 'file' AND b.uid <> t.uid THEN 'uid' END, CASE WHEN b.entry_type = 'file' AND b.gid <> t.gid THEN 'gid' END, CASE WHEN b.entry_type = 'file' AND abs(b.mtime - t.mtime) > 1 THEN 'mtime' END, CASE WHEN b.entry_type = 'special' AND b.rdev <> t.rdev THEN 'rdev' END], lambda x: x IS NOT NULL) END) AS problem FROM b FULL JOIN t ON b.partition_no = t.partition_no AND b.path = t.path) z")
def tree_compare(spark, sf_dir):
    return diff.compare(*_both(spark, sf_dir, True))


@query(f"{_R} SELECT count(*) AS files_written, coalesce(sum(c.size), 0)::BIGINT AS bytes_written, count_if(r.patch_kind IS NOT NULL) AS patches_verified FROM r LEFT JOIN ({_CONTENTS}) c ON r.partition_no = c.partition_no AND r.new_path = c.path WHERE r.new_path IS NOT NULL AND r.entry_type <> 'directory'")
def decompression_stats(spark, sf_dir):
    b, t = _both(spark, sf_dir, True)
    r = diff.records(b, t)
    contents = t.select("partition_no", "path", "sha256", "size").join(r.where("data_kind = 'lazy_blob' or patch_kind = 'lazy'").select("partition_no", F.col("new_path").alias("path")), ["partition_no", "path"], "left_semi")
    return reconstruct.decompression_stats(r, contents)


# Manifests

_STAT_SQL = """SELECT count_if(entry_type <> 'directory' AND old_path IS NULL) AS files_added, count_if(entry_type <> 'directory' AND new_path IS NULL) AS files_removed,
  count_if(entry_type <> 'directory' AND old_path <> new_path) AS files_renamed, count_if(entry_type <> 'directory' AND old_path = new_path AND patch_kind IS NOT NULL) AS files_patched,
  count_if(old_path IS NULL) AS entities_added, count_if(new_path IS NULL) AS entities_removed, count_if(old_path <> new_path) AS entities_renamed, count_if(old_path = new_path) AS entities_changed,
  coalesce(sum(size), 0)::BIGINT AS source_bytes, coalesce(sum(size // 10), 0)::BIGINT AS stored_bytes FROM r"""


@query(f"{_R} {_STAT_SQL}")
def compression_stats(spark, sf_dir):
    return manifest.compression_stats(diff.records(*_both(spark, sf_dir, True)), F.expr("size div 10"))


@query(f"{_R}, s AS ({_STAT_SQL}) SELECT CASE WHEN source_bytes = 0 THEN 1.0 ELSE stored_bytes / source_bytes END AS stored_ratio, CASE WHEN stored_bytes <> 0 THEN source_bytes / stored_bytes END AS shrink_factor FROM s")
def compression_ratio(spark, sf_dir):
    return manifest.ratios(manifest.compression_stats(diff.records(*_both(spark, sf_dir, True)), F.expr("size div 10"))).select("stored_ratio", "shrink_factor")


_PAYLOAD = "(patch_kind IS NOT NULL OR data_kind IS NOT NULL)"
_HAS_META = "coalesce(mode, uid, gid, mtime) IS NOT NULL"


@query(f"{_R} SELECT partition_no, count_if(old_path IS NULL) AS added, count_if(new_path IS NULL) AS removed, count_if(old_path <> new_path) AS renamed, count_if(old_path = new_path AND {_PAYLOAD}) AS patched, count_if(old_path = new_path AND NOT {_PAYLOAD} AND {_HAS_META}) AS meta_only, coalesce(sum(size), 0)::BIGINT AS total_bytes FROM r GROUP BY partition_no")
def inspect_counts(spark, sf_dir):
    return manifest.inspect(diff.records(*_both(spark, sf_dir, True)))


@query(f"{_R} SELECT partition_no, coalesce(new_path, old_path) AS path, CASE WHEN old_path IS NULL THEN '+' WHEN new_path IS NULL THEN '-' WHEN old_path <> new_path THEN 'R' WHEN {_PAYLOAD} THEN 'M' WHEN {_HAS_META} THEN '=' ELSE '?' END AS op, CASE WHEN patch_kind IS NOT NULL THEN 'patch' WHEN data_kind IN ('lazy_blob', 'blob_ref') THEN 'blob' WHEN data_kind = 'softlink_to' THEN 'symlink' WHEN data_kind = 'hardlink_to' THEN 'hardlink' WHEN data_kind = 'special_device' THEN 'device' ELSE '-' END AS stored, size FROM r")
def inspect_listing(spark, sf_dir):
    return manifest.listing(diff.records(*_both(spark, sf_dir, True)))


@query(f"""{_BT}, {_LINKS}, {_PAIRED}, r AS ({_RECORDS}), x AS (SELECT *, coalesce(new_path, old_path) AS path FROM r), y AS (SELECT * REPLACE (CASE WHEN entry_type = 'file' AND old_path = new_path THEN size + 1 ELSE size END AS size) FROM x WHERE NOT (old_path IS NULL AND size % 2 = 0))
SELECT coalesce(x.partition_no, y.partition_no) AS partition_no, coalesce(x.path, y.path) AS path, CASE WHEN y.path IS NULL THEN 'only_first' WHEN x.path IS NULL THEN 'only_second' ELSE 'differs' END AS status
FROM x FULL JOIN y ON x.partition_no = y.partition_no AND x.path = y.path WHERE x.path IS NULL OR y.path IS NULL OR x.size <> y.size""")
def manifest_diff(spark, sf_dir):
    one = diff.records(*_both(spark, sf_dir))
    other = one.where("not (old_path is null and size % 2 = 0)").withColumn("size", F.when((F.col("entry_type") == "file") & (F.col("old_path") == F.col("new_path")), F.col("size") + 1).otherwise(F.col("size")))
    return manifest.difference(one, other)


# Images


def _images(spark):
    rows = [(f"img{i}", f"img{i // 2}" if i > 1 else None) for i in range(1, 21)]
    return spark.createDataFrame(rows, "image_id string, base_image_id string")


_IMAGES = "i AS (SELECT 'img' || n AS image_id, CASE WHEN n > 1 THEN 'img' || (n // 2) END AS base_image_id FROM range(1, 21) r(n))"


@query(f"WITH RECURSIVE {_IMAGES}, w AS (SELECT image_id, base_image_id AS ancestor, 1 AS distance FROM i WHERE base_image_id IS NOT NULL UNION ALL SELECT w.image_id, i.base_image_id, distance + 1 FROM w JOIN i ON i.image_id = w.ancestor WHERE i.base_image_id IS NOT NULL) SELECT * FROM w")
def image_lineage(spark, sf_dir):
    return blobs.lineage(_images(spark))


@query(f"WITH {_IMAGES} SELECT image_id FROM i WHERE base_image_id = 'img3'")
def delete_children_check(spark, sf_dir):
    return blobs.children(_images(spark), "img3")


def _references(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("blob-"), F.substring(F.sha2("text", 256), 1, 12)).alias("blob_id"))
    return d.select(F.concat(F.lit("img"), (F.col("doc_id") % 3).cast("string")).alias("image_id"), "blob_id")


_REFS = "f AS (SELECT 'img' || (doc_id % 3) AS image_id, 'blob-' || sha256(text)[1:12] AS blob_id FROM documents)"


@query(f"WITH {_REFS} SELECT blob_id, CASE WHEN max(CASE WHEN image_id <> 'img1' THEN 1 ELSE 0 END) = 1 THEN 'kept' ELSE 'deleted' END AS fate FROM f GROUP BY blob_id HAVING max(CASE WHEN image_id = 'img1' THEN 1 ELSE 0 END) = 1")
def gc_blobs(spark, sf_dir):
    return blobs.collectable(_references(spark, sf_dir), "img1")


@query(f"WITH {_REFS} SELECT blob_id FROM f GROUP BY blob_id HAVING count_if(image_id <> 'img1') = 0")
def gc_sweep(spark, sf_dir):
    """The blobs that go once one image is gone: those that no record of the others refers to."""
    refs = _references(spark, sf_dir)
    return blobs.unreferenced(refs.select("blob_id").distinct(), refs.where("image_id <> 'img1'"))


@query(f"WITH {_REFS} SELECT DISTINCT blob_id FROM f WHERE image_id = 'img2'")
def blob_fetch_set(spark, sf_dir):
    refs = _references(spark, sf_dir)
    every = refs.select("blob_id").distinct()
    return blobs.fetch_set(every, refs.where("image_id = 'img2'").withColumn("entry_type", F.lit("file")))


@query("WITH f AS (SELECT 'blob-' || sha256(text)[1:12] AS source_blob_id, sha256(text) AS source_sha256, strlen(text)::BIGINT AS source_size, doc_id FROM documents), u AS (SELECT DISTINCT source_blob_id, source_sha256, source_size FROM f) SELECT f.doc_id, u.* FROM f JOIN u USING (source_blob_id) WHERE f.doc_id % 5 = 0")
def patch_source_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))
    d = d.withColumn("blob_id", F.concat(F.lit("blob-"), F.substring("sha256", 1, 12)))
    recs = d.select("doc_id", F.col("blob_id").alias("source_blob_id"), F.when(F.col("doc_id") % 5 == 0, "lazy").alias("patch_kind"))
    return blobs.patch_sources(recs, d.select("blob_id", "sha256", "size").distinct()).select("doc_id", "source_blob_id", "source_sha256", "source_size")


@query("""WITH r AS (SELECT source AS image_id, doc_id::INTEGER AS partition_no, sha256(text) AS h, strlen(text)::BIGINT AS size FROM documents)
SELECT image_id, partition_no, size, size > 0 AND NOT EXISTS (SELECT 1 FROM r o WHERE o.h = r.h AND o.partition_no % 3 = 0) AS is_new FROM r""")
def region_records(spark, sf_dir):
    """Documents as regions of their source's image; the content of every third is in the store already."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("image_id"), F.col("doc_id").cast("int").alias("partition_no"), F.lit("raw").alias("kind"), F.col("text").cast("binary").alias("content"))
    known = d.where("partition_no % 3 = 0").select(F.sha2("content", 256).alias("sha256")).distinct().withColumn("blob_id", F.concat(F.lit("known-"), "sha256"))
    return regions.compress(d, known)[0].select("image_id", "partition_no", "size", (F.col("stored_bytes") > 0).alias("is_new"))


# Layouts

_LAYOUT = '{"partitiontable": {"label": "gpt", "id": "AB", "device": "/dev/nbd0", "sectorsize": 512, "partitions": [{"node": "/dev/nbd0p1", "start": 2048, "size": 2048, "type": "21686148-6449-6E6F-744E-656564454649", "uuid": "U-1", "name": "boot"}, {"node": "/dev/nbd0p15", "start": 4096, "size": 20000000, "type": "0FC63DAF-8483-4772-8E79-3D69D8477DE4", "uuid": "U-2"}]}}'
_OTHER = '{"partitiontable": {"label": "dos", "partitions": [{"node": "/dev/sda1", "start": 63, "size": 100, "type": "83"}]}}'
_ALIEN = '{"partitiontable": {"label": "sun", "partitions": [{"node": "/dev/sda1", "start": 63, "size": 100, "type": "83"}]}}'
_PARTS = """p(image_id, scheme, number, partition_guid, type_guid, name, start_lba, end_lba, size_bytes, flags) AS (VALUES
 ('a', 'gpt', 1, 'u-1', '21686148-6449-6e6f-744e-656564454649', 'boot', 2048::BIGINT, 4095::BIGINT, 1048576::BIGINT, 0::BIGINT), ('a', 'gpt', 15, 'u-2', '0fc63daf-8483-4772-8e79-3d69d8477de4', NULL, 4096, 20004095, 10240000000, 0), ('b', 'mbr', 1, NULL, NULL, NULL, 63, 162, 51200, 0))"""


def _layouts(spark):
    return layout.parse(spark.createDataFrame([("a", _LAYOUT), ("b", _OTHER), ("c", _ALIEN), ("d", None)], "image_id string, sfdisk string"))


@query(f"WITH {_PARTS} SELECT * FROM p")
def disk_layout_parse(spark, sf_dir):
    return _layouts(spark)


_GUIDS = [("bios", "21686148-6449-6E6F-744E-656564454649", None), ("swap", "0657fd6d-a4ab-43c4-84e5-0933c84b4f4f", "swap"), ("efi", "C12A7328-F81F-11D2-BA4B-00A0C93EC93B", None), ("root", "0fc63daf-8483-4772-8e79-3d69d8477de4", "ext4"), ("blank", "0fc63daf-8483-4772-8e79-3d69d8477de4", ""), ("mbr", None, "xfs"), ("none", None, None)]


@query("SELECT * FROM (VALUES ('bios', 'bios_boot'), ('swap', 'raw'), ('efi', 'fs:vfat'), ('root', 'fs:ext4'), ('blank', 'raw'), ('mbr', 'fs:xfs'), ('none', 'raw')) v(name, kind)")
def partition_classify(spark, sf_dir):
    return spark.createDataFrame(_GUIDS, "name string, type_guid string, probed string").select("name", layout.classify("type_guid", "probed").alias("kind"))


@query(f"WITH {_PARTS} SELECT image_id, (ceil((max(end_lba) + 34) * 512 / 1048576.0::DOUBLE) * 1048576)::BIGINT AS image_bytes FROM p GROUP BY image_id")
def image_size(spark, sf_dir):
    return layout.image_size(_layouts(spark))


@query("SELECT * FROM (VALUES ('a', 'xfs', 'isize=512;block_size=4096;crc=1'), ('b', 'ext4', 'isize=256;block_size=4096;crc='), ('c', 'ntfs', NULL)) v(image_id, fs_type, found)")
def fs_params_parse(spark, sf_dir):
    out = [("a", "xfs", "meta-data=/dev/x isize=512 agcount=4\n = sectsz=512 crc=1\ndata     =   bsize=4096   blocks=2621440"), ("b", "ext4", "Filesystem UUID:          u-7\nBlock size:               4096\nInode size:\t          256"), ("c", "ntfs", "nothing")]
    p = layout.fs_params(spark.createDataFrame(out, "image_id string, fs_type string, output string"))
    got = F.concat(*[x for k in ("inode_size", "block_size", "crc") for x in (F.lit({"inode_size": "isize=", "block_size": ";block_size=", "crc": ";crc="}[k]), F.coalesce(F.col("params")[k], F.lit("")))])
    return p.select("image_id", "fs_type", F.when(F.col("params").isNotNull(), got).alias("found"))


@query("SELECT 1::INTEGER + (n::INTEGER) AS partition_no, n = 0 AS in_base FROM range(2) r(n)")
def partition_pairing(spark, sf_dir):
    b, t = _both(spark, sf_dir)
    return layout.paired_partitions(b.where("partition_no = 1"), t)


# Small functions over whole tables


@query("SELECT page_id, length(html) AS n, CASE WHEN strlen(html) >= 1048576 THEN printf('%.1f MiB', strlen(html) / 1048576.0::DOUBLE) WHEN strlen(html) >= 1024 THEN printf('%.1f KiB', strlen(html) / 1024.0::DOUBLE) ELSE printf('%d B', strlen(html)) END AS human FROM pages")
def human_bytes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length("html").cast("long").alias("n"), scalars.human_bytes(F.octet_length("html")).alias("human"))


@query("SELECT page_id, regexp_extract(string_split(url, '/')[-1], '^.+\\.([^.]*)$', 1) AS ext, string_split(url, '/')[1] AS first, string_split(url, '/')[-1] AS name, len(list_filter(string_split(url, '/'), lambda x: x <> '')) AS parts FROM pages")
def path_functions(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.extension("url").alias("ext"), scalars.first_component("url").alias("first"), scalars.file_name("url").alias("name"), F.size(scalars.components("url")).cast("long").alias("parts"))


@query(f"{_R} SELECT CASE WHEN old_path IS NULL THEN 'add' WHEN new_path IS NULL THEN 'remove' WHEN old_path = new_path THEN 'change' ELSE 'rename' END AS op, count(*) AS n FROM r GROUP BY 1")
def record_operations(spark, sf_dir):
    r = diff.records(*_both(spark, sf_dir, True))
    return r.groupBy(scalars.operation("old_path", "new_path").alias("op")).agg(F.count("*").alias("n"))


@query(f"""{_BT}, e AS (SELECT kind, CASE WHEN path LIKE '%/new/%' THEN 'added' WHEN m = 0 THEN 'removed' WHEN m IN (2, 6) THEN 'renamed' WHEN m = 1 THEN 'changed' ELSE 'metadata_only' END AS intended FROM (SELECT d.kind, d.path, regexp_extract(d.path, '-([0-9]+)[-.]', 1)::BIGINT % 10 AS m FROM ({_KINDS}) d) x)
SELECT intended, kind, count(*) AS n FROM e GROUP BY ALL""")
def accuracy_metrics(spark, sf_dir):
    """How the differences found agree with the changes that were made."""
    d = diff.kinds(*_both(spark, sf_dir)).withColumn("m", F.regexp_extract("path", r"-([0-9]+)[-.]", 1).cast("long") % 10)
    intended = F.when(F.contains("path", F.lit("/new/")), "added").when(F.col("m") == 0, "removed").when(F.col("m").isin(2, 6), "renamed").when(F.col("m") == 1, "changed").otherwise("metadata_only")
    return d.groupBy(intended.alias("intended"), "kind").agg(F.count("*").alias("n"))
