"""The corpus operators' registered queries, at production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, html_text, inner_product, jaccard, langid, line_dedup, line_quality, mixing, permutation_index, quality_mil, toxicity, whitening
from .common import fold, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = langid.fit(docs, ~held_out)
    out = langid.predict(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = quality_mil.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = quality_mil.score(docs, model, threshold=0.3)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_passages", "top_weight")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 3) == 1
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = toxicity.score(docs, machine, threshold=0.7)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_product.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard": op1_jaccard,
        "op2_main_text": op2_main_text,
        "op3_bpe": op3_bpe,
        "op4_line_quality": op4_line_quality,
        "op5_mix": op5_mix,
        "op6_language": op6_language,
        "op7_line_dedup": op7_line_dedup,
        "op8_nearest": op8_nearest,
        "op9_quality": op9_quality,
        "op10_toxicity": op10_toxicity,
        "op11_whiten": op11_whiten,
        "op12_centroids": op12_centroids,
        "op13_inner_product": op13_inner_product,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_jaccard": jaccard.SQL,
        "op4_line_quality": line_quality.SQL,
        "op5_mix": mixing.SQL,
        "op7_line_dedup": line_dedup.SQL,
        "op12_centroids": centroids.sql(),
        "op13_inner_product": inner_product.SQL,
    }
