"""Snapshots: tables with a row for each entry of a tree.

Columns of ``entries``: image_id, partition_no, path, entry_type (file, directory, symlink, special), mode, uid, gid,
mtime (whole seconds), size, sha256 (files), content (files), link_target (symlinks), dev, ino, nlink, rdev.
Content is kept out of shuffles: operators carry sha256 and join content back where a codec needs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "image_id string, partition_no int, path string, entry_type string, mode long, uid long, gid long, mtime long, size long, "
    "sha256 string, content binary, link_target string, dev long, ino long, nlink long, rdev long"
)

#: One text for two engines; the names in braces are what they call differently.
_COLUMNS = """
  {part} AS partition_no, {path} AS path, 'file' AS entry_type, {mode} AS mode, doc_id % 5 AS uid, doc_id % 3 AS gid,
  1700000000 + doc_id{later} AS mtime, {blen}({content}) AS size, {sha} AS sha256, {content} AS content,
  CAST(NULL AS {string}) AS link_target, CAST(1 AS BIGINT) AS dev, {ino} AS ino, {nlink} AS nlink, CAST(0 AS BIGINT) AS rdev, doc_id
"""
_PART = "CAST(1 + floor(doc_id / 10) % 2 AS INTEGER)"
_OLD = "concat(source, '/', lang, '/doc-', CAST(doc_id AS {string}), '-1.0.', lang)"
_NEW = "concat(source, '/', lang, '/doc-', CAST(doc_id AS {string}), CASE WHEN doc_id % 10 IN (2, 6) THEN '-1.1.' ELSE '-1.0.' END, lang)"
_ADD = "concat(source, '/new/', lang, '-', CAST(doc_id AS {string}), '.txt')"
_TEXT = "CASE WHEN doc_id % 10 IN (1, 6) THEN concat(text, ' v2') ELSE text END"
_LATER = " + CASE doc_id % 10 WHEN 1 THEN 60 WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 0 END"
_MODE = "CAST(CASE WHEN doc_id % 10 = 3 THEN 33261 ELSE 33188 END AS BIGINT)"
_PLAIN_MODE = "CAST(33188 AS BIGINT)"
_INO = "doc_id - CASE WHEN doc_id % 20 = 9 THEN 1 ELSE 0 END"
_NLINK = "CAST(CASE WHEN doc_id % 20 IN (8, 9) THEN 2 ELSE 1 END AS BIGINT)"


def _names(engine: str) -> dict[str, str]:
    return {"spark": {"string": "STRING", "blen": "octet_length"}, "duckdb": {"string": "VARCHAR", "blen": "strlen"}}[engine]


def _select(engine: str, path: str, content: str, mode: str, later: str) -> str:
    names = _names(engine)
    sha = {"spark": f"sha2({content}, 256)", "duckdb": f"sha256({content})"}[engine]
    return "SELECT" + _COLUMNS.format(part=_PART, path=path.format(**names), content=content, mode=mode, later=later, sha=sha, ino=_INO, nlink=_NLINK, **names)


def base_sql(engine: str) -> str:
    """Every document is a file of the base snapshot."""
    return f"{_select(engine, _OLD, 'text', _PLAIN_MODE, '')} FROM documents"


def target_sql(engine: str) -> str:
    """By the last digit of the id: 0 is dropped, 1 has new content and time, 2 is renamed, 3 has another mode, 4 and 5
    other times (by 1 and 2 seconds), 6 is renamed with new content; one in 17 is there a second time as a new file."""
    return (
        f"{_select(engine, _NEW, _TEXT, _MODE, _LATER)} FROM documents WHERE doc_id % 10 <> 0 "
        f"UNION ALL {_select(engine, _ADD, 'text', _PLAIN_MODE, '')} FROM documents WHERE doc_id % 17 = 0"
    )


#: The same with directories, symlinks, devices and flips of type, by the id modulo 23 (and 29 for flips).
_KIND = "CASE WHEN {flip} THEN 'symlink' WHEN doc_id % 23 = 1 THEN 'directory' WHEN doc_id % 23 = 2 THEN 'symlink' WHEN doc_id % 23 = 3 THEN 'special' ELSE 'file' END"


def rich_sql(engine: str, side: str) -> str:
    inner = base_sql(engine) if side == "base" else target_sql(engine)
    flip = "doc_id % 29 = 5" if side == "target" else "false"
    kind = _KIND.format(flip=flip)
    string = _names(engine)["string"]
    moved = "CASE WHEN doc_id % 2 = 0 THEN '-moved' ELSE '' END" if side == "target" else "''"
    minor = "doc_id % 7" if side == "base" else "doc_id % 7 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END"
    return f"""
SELECT partition_no, path, kind AS entry_type,
  CASE kind WHEN 'directory' THEN 16877 + (mode - 33188) WHEN 'symlink' THEN 41471 WHEN 'special' THEN 8630 ELSE mode END AS mode,
  uid, gid, mtime, CASE WHEN kind = 'file' THEN size ELSE 0 END AS size, CASE WHEN kind = 'file' THEN sha256 END AS sha256,
  CASE WHEN kind = 'file' THEN content END AS content,
  CASE WHEN kind = 'symlink' THEN concat('../lib/', CAST(doc_id AS {string}), {moved}) END AS link_target,
  dev, ino, CASE WHEN kind = 'file' THEN nlink ELSE 1 END AS nlink,
  CAST(CASE WHEN kind = 'special' THEN 256 * (1 + doc_id % 5) + {minor} ELSE 0 END AS BIGINT) AS rdev, doc_id
FROM (SELECT *, {kind} AS kind FROM ({inner}) s) k"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def virtual(spark: SparkSession, sf_dir: str, side: str, rich: bool = False) -> DataFrame:
    """The base or target snapshot derived from the documents table, with content as text."""
    sql = rich_sql("spark", side) if rich else {"base": base_sql, "target": target_sql}[side]("spark")
    return spark.sql(sql.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
