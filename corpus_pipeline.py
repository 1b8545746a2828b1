"""Corpus pipeline over ``documents``: quality, near copies, benchmark
passages, secrets, subword encoding and decoding.

Each stage calls one operator of ``parcelscope.llm`` on all that the stage
before it kept; its result is written as Parquet and read again as the next
one's input.  All stages but the last return the columns of ``documents``;
the last returns the piece ids of what is left and what they decode to.

Edge cases.  The stages take nulls in any column, empty and very long texts,
repeated rows and empty tables, each with the result that its operator's text
states; other columns, whatever their names, go along through all stages but
the last.  A document without an id is judged like any other and keeps its
null; of rows that repeat an id and text one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelscope.llm.common import stored, table
from parcelscope.llm.decontaminate import drop_contaminated
from parcelscope.llm.piece_lattice import encode
from parcelscope.llm.secret_forest import redact, scan
from parcelscope.llm.simhash import keep_first
from parcelscope.llm.site_quality import keep_good

VOCABULARY = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"), host=F.col("source"), path=F.col("lang"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (3-word shingles,
    at most 2 differing bits)."""
    return keep_first(docs, shingle=3, distance=2)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; n_chars, where it is there, changes
    by as many characters as its text."""
    found = stored(scan(docs, path=F.col("source")), "secret_findings")
    if "n_chars" not in docs.columns:
        return redact(docs, found)
    clean = redact(docs.withColumn("__before", F.length("text")), found)
    change = F.coalesce(F.length("text") - F.col("__before"), F.lit(0))
    n_chars = (F.col("n_chars") + change).cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", n_chars).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_pieces, ids, n_decoded, decoded_sha256)``: the encoded
    texts, and length and digest of the texts that the ids decode to."""
    model = public_tokenizers.path(VOCABULARY)
    return encode(docs, model, decoded=True).withColumnRenamed("row_id", "doc_id")


STAGES = [("quality_classifier", quality), ("simhash_near_dedup", near_copies),
          ("benchmark_decontamination", benchmark), ("secret_scan", secrets), ("sentencepiece", pieces)]
#: Model training, fingerprints and merges can't be said in SQL; tests/llm
#: holds each stage and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
