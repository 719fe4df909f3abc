"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and gives the documents that go on, with the columns of documents; the
last gives the pieces with their token ids and places in sequences.

Edge cases: an empty table gives no rows at every stage; a null or empty text is a document without words, which
the classifier scores like any other, near-dedup takes for a copy of other empty ones, and packing gives its end id;
a null doc_id or source is kept; repeated rows stay one in near-dedup; texts of any length are taken whole; further
columns, whatever their names, are carried through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import mixing, packing, quality_gam, secrets, simhash
from lodestrata.llm.queries import tokenizer
from lodestrata.llm.shared import new_path
from lodestrata.tables import table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to the labels outside the held-out fold, predicts to be good."""
    model = quality_gam.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality_gam.keep_good(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id."""
    return simhash.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets struck out of the text and n_chars counted anew where there were any."""
    model = secrets.train(secrets.labelled_samples(spark))
    found = secrets.scan(docs.select(F.struct("*").alias("row"), "text"), model)
    clean = found.withColumn("text", secrets.redacted(F.col("text"), F.col("secret_spans")))
    changed = F.size("secret_spans") > 0
    of = {"text": F.col("text"), "n_chars": F.when(changed, F.length("text")).otherwise(F.col("row.n_chars")).cast("long")}
    return clean.select(*[of.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, not at all, once or twice, shard by shard and shuffled within each."""
    return mixing.shuffled(mixing.mixed(docs)).select("row.*")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, their token ids, and their places in sequences of 4096 tokens."""
    return packing.pack_pieces(packing.cut_pieces(docs, tokenizer("word_bpe_49k.json"), end_id=1, with_ids=True))


STAGES = [
    ("quality classifier", good_documents),
    ("simhash near-dedup", without_near_duplicates),
    ("secret scans", without_secrets),
    ("source mixing", mixed_sources),
    ("best-fit packing", packed_sequences),
]

#: Learned models, XXH64 and BPE are beyond SQL; tests check the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
