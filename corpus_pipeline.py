"""From raw documents to training tokens: five stages, each over all that the one before has kept.

Each stage takes (spark, docs, sf_dir), docs being the last stage's table, and returns a DataFrame. All but the last
return the columns of documents; the last returns the encoded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from snapforge.llm import bpe, line_dedup, mixing, near_duplicates, quality
from snapforge.llm.common import discard, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents (score under 0.7) go. Learned from the labels of documents that are not held out.

    A null text is judged as the empty text; rows without an id and repeated rows are judged like others. Where nothing can
    be learned, all have one score. An empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, "quality", ~quality.held_out(F.col("doc_id")))
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that near-repeat an earlier line go; n_chars follows the text. A document of which nothing but spaces is left goes.

    Null texts stay. Rows without an id come first, so their lines stay; of equal rows all keep the same lines."""
    cut = line_dedup.dedup(docs)
    return cut.where("text is null or trim(text) <> ''").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the row with the smallest id, and of these the one whose text has the smallest hash.
    Links are pairs at a Jaccard similarity of 0.8 or more of five-word shingles.

    Rows without an id give way to rows with one, and else to each other by their texts' hash; of equal rows one stays.
    Texts without words, null ones among them, are in no group and stay."""
    rows = near_duplicates.link(docs.select("doc_id", "text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("r")
    stay = rows.groupBy("component").agg(first).select(F.col("r.doc_id").alias("stays"), F.col("r.mark").alias("mark"))
    worded = near_duplicates.has_words(F.col("text"))
    marked = docs.where(worded).withColumn("mark", F.xxhash64("text"))
    kept = marked.join(stay, F.col("doc_id").eqNullSafe(F.col("stays")) & (marked["mark"] == stay["mark"]), "left_semi").dropDuplicates(["doc_id", "mark"])
    return kept.select(*docs.columns).unionByName(docs.where(~worded)).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a document that is taken more than once has a row for each time.

    Null is a source of its own; texts without words add nothing and are taken as their place in the order says."""
    return mixing.mix_documents(docs).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the check that they decode to the text; a null text has none. Every row has one row, in any order."""
    coded = bpe.encode(docs, with_decoded=True)
    exact = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.withColumn("round_trip", exact).select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]

#: Learned scores, hashes of shingles and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(docs)  # a table of written() only, never the input
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
