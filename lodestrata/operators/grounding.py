"""Validation of extracted facts against the chunks they cite, and of runs against gold facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import parsing as P
from lodestrata.functions import text as T


def issues(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """project_id, severity, issue_type, field_path of facts (project_id, field_path, kind, value, citations:
    array<struct<chunk_id, quote>>) against chunks (chunk_id, text). Facts without a value raise none; a number or date
    without citation is an error, a text a warning."""
    said = facts.where("value is not null and trim(value) <> ''")
    bare = said.where("citations is null or size(citations) = 0")
    hard = F.col("kind").isin("number", "date")
    none = bare.select("project_id", F.when(hard, "error").otherwise("warn").alias("severity"), F.when(hard, "unsupported_numeric_or_date").otherwise("missing_citation").alias("issue_type"), "field_path")
    cited = said.select("project_id", "field_path", F.posexplode("citations").alias("i", "c")).select("project_id", "field_path", "i", "c.chunk_id", "c.quote")
    met = cited.join(chunks.select("chunk_id", "text"), "chunk_id", "left").where(~F.coalesce(T.supports(F.col("text"), F.col("quote")), F.lit(False)))
    wrong = met.select("project_id", F.lit("error").alias("severity"), F.lit("citation_not_supported").alias("issue_type"), F.concat(F.col("field_path"), F.lit(".citations["), F.col("i").cast("string"), F.lit("]")).alias("field_path"))
    return none.unionByName(wrong)


def unconfirmed(found: DataFrame) -> DataFrame:
    """Paths with an error, cut before citations."""
    return found.where("severity = 'error'").select("project_id", P.field_path(F.col("field_path")).alias("field_path")).distinct()


def gold_accuracy(gold: DataFrame, runs: DataFrame) -> DataFrame:
    """n_facts, n_matched, accuracy of gold (project_id, field_path, value_type, value) against the runs' JSON
    (project_id, output_json). Null equals null for numbers and dates, not for strings; a missing run never matches."""
    j = gold.join(runs, "project_id", "left").withColumn("got", P.json_path(F.col("output_json"), F.col("field_path")))
    v, g = F.col("value"), F.col("got")
    same = F.when(F.col("value_type") == "number", P.number_key(v).eqNullSafe(P.number_key(g))).when(F.col("value_type") == "date", P.date_key(v).eqNullSafe(P.date_key(g))).otherwise(F.coalesce(F.trim(v) == F.trim(g), F.lit(False)))
    hit = F.count(F.when(F.col("output_json").isNotNull() & same, 1))
    return j.agg(F.count("*").alias("n_facts"), hit.alias("n_matched"), F.coalesce(F.try_divide(hit, F.count("*")), F.lit(0.0)).alias("accuracy"))
