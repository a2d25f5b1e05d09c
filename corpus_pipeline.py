"""From raw documents to a tokenized mix: reject toxic documents, delete repeated runs of lines, keep
one document of each near-duplicate class, mix the sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents; the last writes the
tokenized mix and returns its digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlake.llm import bpe, jaccard, line_dedup, mixing, queries, toxicity
from contractlake.llm.common import WORD, fold, table, text_column, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine predicts as toxic go. It learns as op10_toxicity does."""
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    scored = toxicity.score(docs, machine, threshold=0.7, keep=COLUMNS)
    return scored.filter("predicted = 0").select(*COLUMNS)


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later runs of repeated lines go, and with them documents that have no word left."""
    cleaned = line_dedup.remove_repeated(docs.select(*COLUMNS))
    worded = text_column("text").rlike(WORD)
    kept = cleaned.filter((F.col("n_deleted_lines") == 0) | worded)
    return kept.withColumn("n_chars", F.when(F.col("n_deleted_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs.select(*COLUMNS))


def tokens(docs: DataFrame) -> DataFrame:
    """The tokenized mix: doc_id, lang, source, ids array<int>, decoded string."""
    return bpe.encode_texts(docs, queries.tokenizer_path(), keep=["doc_id", "lang", "source"], out="ids")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix is written to tokenized-mix-* in the shared folder; its digests are returned, as the contract asks."""
    return bpe.digests(written(tokens(docs), "tokenized-mix", "zstd").drop("lang", "source"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", delete_repeated_lines),
    ("jaccard", keep_one_of_each_class),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The first stage is a trained classifier and the last a tokenizer file: SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
