"""One query for each operator of this subpackage, over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import ann, centroids, mixing, packing, quality_gam, quality_rules, quotes, secrets, simhash, substring, token_files, toxicity, vector_codes
from lodestrata.llm.shared import new_path
from lodestrata.tables import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_samples(spark))
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), model))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_gam.score(docs, quality_gam.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer("byte_bpe_50k.json"), end_id=0)
    return token_files.read_token_files(spark, folder, manifest)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_pieces(packing.cut_pieces(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op10_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.shared_passages(table(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_secret_scan, op2_quality_rules, op3_quality_classifier, op4_token_files, op5_simhash_near_dedup, op6_best_fit_packing, op7_source_mixing, op8_nearest_neighbours, op9_quote_linking, op10_shared_passages, op11_centroid_clusters, op12_toxicity, op13_vector_codes]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """SQL of the vector operators. The others can't be put whole into SQL: learned models, BPE, XXH64, packing and seeded draws are checked in tests."""
    return {"op11_centroid_clusters": centroids.clusters_sql(), "op13_vector_codes": vector_codes.codes_sql()}
