"""Clean-up of a document corpus in stages, each a table of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm import bpe, decontaminate, language_id, minmax_dedup, substring_dedup
from maskloom.llm.common import table
from maskloom.session import shared_dir

#: Least similarity of a link in this corpus, in hundredths.
SIMILARITY = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages learned here; all with a letter if there are none."""
    return language_id.keep_identified(docs, language_id.train_on(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of documents linked at ``SIMILARITY`` or more."""
    return minmax_dedup.one_of_each(docs, similarity=SIMILARITY)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur elsewhere too are cut out of the text; ``n_chars`` follows."""
    cut = substring_dedup.without_repeats(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of what is kept."""
    return bpe.query(docs)


STAGES = [
    ("language_id", identify_language),
    ("minmax_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontaminate", drop_benchmark_leaks),
    ("bpe", encode_texts),
]

#: No stage has an SQL counterpart; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written once and read again by the next."""
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
