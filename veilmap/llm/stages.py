"""Stages of the corpus pipeline."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmap.llm import linechunks, mixing, pieces, quality, simhash
from veilmap.llm.queries import default_model, quality_model
from veilmap.sources.storage import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model takes for bad go; the others stay as they are."""
    scored = quality.score(docs.select(COLUMNS), quality_model(spark, docs, sf_dir))
    return scored.where("predicted = 1").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Multi-line chunks that occur before are taken out; documents that lose all lines by it (full copies) go,
    the others stay.  `n_chars` is counted anew."""
    found = linechunks.dedup_lines(docs.select(COLUMNS)).where("n_removed = 0 or n_removed < n_lines")
    return found.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id stays."""
    return simhash.keep_first(docs.select(COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated towards weights by the square root of their size, and shuffled."""
    return mixing.mix(docs.select(COLUMNS)).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds `ids`, and `decoded`: whether they decode to the text."""
    return pieces.encode_table(docs.select(COLUMNS), default_model(), verify=True)


STAGES = [("quality", quality_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("mix_sources", mix_sources), ("sentencepiece", encode)]
# Line chunks, fingerprints, the line model and the transducer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written and read again as the input of the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
