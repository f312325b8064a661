"""Corpus pipeline: language ID, SimHash near-dedup, secret scans, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. All
but the last return the columns of ``docs``; the last returns the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import langid, packing, secrets, simhash
from shelfwise.llm.queries import tokenizer_path
from shelfwise.session import checkpoint_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts that resemble no learned language; learns from ``docs`` itself."""
    model = langid.train(docs, "doc_id", "text", "lang", per_class=200, max_sample_chars=20000)
    return langid.keep_known(docs, "text", model, min_score=0.1, min_known=langid.MIN_KNOWN)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays: the one with the smallest id."""
    return simhash.drop_near_duplicates(docs, "doc_id", "text", shingle=4, max_bits=4)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets that one owner holds and that look live; every document stays, ``n_chars`` follows the text."""
    columns = docs.columns
    out = secrets.redact_secrets(docs, "doc_id", "text", owner_col="source", repo_col="doc_id", copied_owners=3)
    if "n_chars" in columns:
        size = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", size)
    return out.select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full 2048-token sequences, filled with lexical neighbours."""
    return packing.pack(docs, tokenizer_path(), "doc_id", "text", window=2048, end_id=1)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

#: Kernel regression, fingerprints and BPE have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet in the shared
    folder and read again as the next one's ``docs``, so a lost executor costs one stage's tasks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(base)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
