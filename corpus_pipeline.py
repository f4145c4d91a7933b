"""From raw documents to token files: the stages of the corpus pipeline, each one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.decontamination import PositionalIndex
from flowlens.llm.jaccard import ngram_jaccard_join
from flowlens.llm.mixing import Mix
from flowlens.llm.queries import END_ID, WORD_TOKENIZER, clean_labels
from flowlens.llm.resampling import importance_resample
from flowlens.llm.tokenfiles import read_token_files, write_token_files
from flowlens.operators.shared import scratch_path


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and text are not among the rejected ones (doc_id, text_key)."""
    out = rejected.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    same = docs["doc_id"].eqNullSafe(out["__id"]) & (F.xxhash64(docs["text"]) == out["__key"])
    return docs.join(out, same, "left_anti")


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance weight, as many as the share of clean ones among the labelled."""
    return without(docs, importance_resample(docs, clean_labels(spark, sf_dir)).where("not kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id, also where several of
    them share it; rows repeated whole go."""
    linked = ngram_jaccard_join(docs, words=5, threshold=80).where("not representative")
    kept = without(docs, linked).withColumn("__key", F.xxhash64("text"))
    return kept.dropDuplicates(["doc_id", "__key"]).drop("__key")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no phrase of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, PositionalIndex(docs, benchmark).report().where("contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often and as far as the mix uses them."""
    return Mix(docs).documents().withColumn("n_chars", F.length("text").cast("long"))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and what the files hold per document."""
    from public_tokenizers import path

    return read_token_files(write_token_files(docs, path(WORD_TOKENIZER), END_ID))


STAGES = [
    ("quality_classifier", select_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_files", write_tokens),
]

# Log-ratios, permutations and token ids have no SQL form; the tests rebuild each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
