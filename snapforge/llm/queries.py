"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snapforge.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op1_bpe": op1_bpe}
SQL: dict[str, str] = {}


#: Fixed by the contract of op3.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snapforge.llm import url_filter

    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snapforge.llm import mixing

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES |= {"op3_url_filter": op3_url_filter, "op4_mixing": op4_mixing}

SQL["op3_url_filter"] = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM u),
r(rule, host, path, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
m AS (SELECT p.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC) AS nth
      FROM p JOIN r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM m WHERE nth = 1) m USING (page_id)
"""

SQL["op4_mixing"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM s),
w AS (SELECT *, CASE rnk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS most FROM r),
l AS (SELECT *, row_number() OVER (ORDER BY most / weight, rnk) AS nth,
        (1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM w) - coalesce(sum(most) OVER (ORDER BY most / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY most / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT min(nth) AS nth, min_by(level, nth) AS level FROM l WHERE level <= most / weight),
t AS (SELECT l.source, l.source_size, CASE WHEN f.nth IS NULL OR l.nth < f.nth THEN l.most ELSE f.level * l.weight END AS target FROM l LEFT JOIN f ON true),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN budget // source_size * size + greatest(0, least(size, budget % source_size - before_)) ELSE 0 END)::BIGINT AS taken FROM x
"""


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from snapforge.llm import token_binary

    files, folder = token_binary.store(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_binary.read_files(files, folder)


QUERIES["op10_token_binary"] = op10_token_binary


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snapforge.llm import simhash

    return simhash.link(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op5_simhash"] = op5_simhash


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snapforge.llm import media

    return media.describe(media.store(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("media_error")


QUERIES["op8_media"] = op8_media


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snapforge.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", ~quality.held_out(F.col("doc_id")))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES["op6_quality"] = op6_quality


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snapforge.llm import substring

    out = substring.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES["op7_substring"] = op7_substring


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snapforge.llm import embedding_dedup

    return embedding_dedup.link(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES["op2_embedding_dedup"] = op2_embedding_dedup


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from snapforge.llm import line_dedup

    return line_dedup.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op9_line_dedup"] = op9_line_dedup
