"""A cleaning pipeline over documents: toxicity, line dedup, SimHash near-dedup, decontamination, source mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next stage's docs. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.llm.common import only_rows, row_key, without_rows, written
from halocline.llm.decontam import clean_documents
from halocline.llm.line_dedup import dedup_lines
from halocline.llm.mixing import mixed_documents
from halocline.llm.near_copies import near_copies
from halocline.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are toxic with a probability of a half or more go; the model learns from the labels table."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated long lines go, all documents stay; n_chars follows the text."""
    done = dedup_lines(docs).drop("n_lines", "n_dropped")
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one with the smallest id (nulls last), then the smallest hash of the row.

    Near copies have a Jaccard similarity of 0.8 or more over five-word shingles. Rows are told apart by id and text: rows that
    share an id, or have none, but differ in text are judged each.
    """
    found = written(near_copies(docs.select("doc_id", "text"), exact=True), "near-copies")
    rank = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")
    first = written(found.groupBy("component").agg(F.min(rank).alias("first")).select("first.row"), "first-rows")
    again = written(found.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(first, "row", "left_semi").select("row"), "repeated-rows")
    gone = written(found.select("row").distinct().join(first, "row", "left_anti").unionByName(again), "gone-rows")
    row = row_key("doc_id", "text")
    kept = without_rows(docs, row, gone, "row")
    # rows equal in id and text: the one with the smallest hash of all its columns stays
    equal = only_rows(docs, row, again, "row").groupBy("doc_id", "text").agg(F.min_by(F.struct("*"), F.xxhash64("*")).alias("own"))
    return kept.unionByName(equal.select("own.*"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; taken says how many words of a document the mix takes."""
    return mixed_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
]

#: SQL can't express the fitted toxicity model; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to what its predecessor has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
