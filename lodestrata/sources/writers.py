"""Sinks: versioned Parquet, manifests, CSV with a byte-order mark, JSON exports, split folders, reports."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_version(df: DataFrame, root: str, layer: str, name: str, version: str) -> None:
    """Replaces one version of a dataset and leaves the others."""
    out = df.withColumn("dataset_version", F.lit(version))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_version").parquet(f"{root}/{layer}/{name}")


def append_version(df: DataFrame, root: str, layer: str, name: str, version: str) -> None:
    """Adds rows; columns take the types that the dataset has."""
    path = f"{root}/{layer}/{name}"
    try:
        have = {f.name: f.dataType for f in df.sparkSession.read.parquet(path).schema}
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = {}
    out = df.select(*[F.col(c).cast(have[c]).alias(c) if c in have else F.col(c) for c in df.columns]).withColumn("dataset_version", F.lit(version))
    out.write.mode("append").partitionBy("dataset_version").parquet(path)


def write_manifest(df: DataFrame, root: str, version: str, stage: str, **payload) -> None:
    """One row for each stage and version: a stage does not replace another's."""
    row = json.dumps({"dataset_version_id": version, "created_at": datetime.datetime.now(datetime.UTC).isoformat(), **payload}, sort_keys=True)
    df.sparkSession.createDataFrame([(version, stage, row)], "version string, stage string, manifest string").coalesce(1).write.mode("append").parquet(f"{root}/manifests")


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV with a header; with a byte-order mark in front of the first column's name if wanted."""
    out = df.withColumnRenamed(df.columns[0], chr(0xFEFF) + df.columns[0]) if mark else df
    out.write.mode("overwrite").csv(path, header=True)


def json_export(df: DataFrame, label: str, positive) -> DataFrame:
    """JSON lines: a header with counts, then each row."""
    head = df.agg(F.to_json(F.struct(F.count("*").alias("total"), F.count(F.when(F.col(label) == positive, 1)).alias("positive"), F.count(F.when(F.col(label) != positive, 1)).alias("negative"))).alias("json"))
    return head.unionAll(df.select(F.to_json(F.struct("*")).alias("json")))


def write_split(df: DataFrame, path: str, label: str) -> None:
    """A folder for each split and label (column split, see operators.ranking.split)."""
    df.write.mode("overwrite").partitionBy("split", label).parquet(path)


def markdown(title: str, fields: list[tuple[str, Column]]) -> Column:
    """A report of a row; what is null or empty is 'Not confirmed'."""
    lines = [F.concat(F.lit(f"- **{n}:** "), F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("Not confirmed"))) for n, c in fields]
    return F.concat_ws("\n", F.lit(f"# {title}"), *lines)


def write_labelled(df: DataFrame, path: str, key: str, label: str, zipped: str | None = None) -> None:
    """A folder for each split and label (column split) and labels.csv (key, split, label) beside them; with zipped, all of it in
    an archive: a last step on the driver, for folders that it can see."""
    write_split(df, f"{path}/files", label)
    write_csv(df.select(key, "split", label), f"{path}/labels.csv")
    if zipped:
        import os
        import zipfile

        with zipfile.ZipFile(zipped, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(path):
                for n in sorted(names):
                    if not n.startswith(("_", ".")):
                        z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), path))


def assessment_report(assessed: DataFrame, project: str, model: str) -> DataFrame:
    """One row of markdown and json out of operators.review.assessment(): models first, then their projects. It is a report, of as
    many lines as there are models and projects."""
    share = F.coalesce(F.format_number(F.col("accuracy") * 100, 1), F.lit("Not confirmed"))
    line = F.concat(F.lit("| "), F.coalesce(F.col(project).cast("string"), F.lit("all")), F.lit(" | "), F.col(model), *[F.concat(F.lit(" | "), F.col(c).cast("string")) for c in ("runs", "errors", "facts", "matched")], F.lit(" | "), share, F.lit(" |"))
    rows = F.sort_array(F.collect_list(F.struct(F.col(project).isNotNull().alias("a"), F.col(model).alias("b"), F.col(project).cast("string").alias("c"), line.alias("line"), F.to_json(F.struct(project, model, "runs", "errors", "facts", "matched", "accuracy")).alias("json"))))
    head = F.array(F.lit("# Assessment"), F.lit(""), F.lit("| project | model | runs | errors | facts | matched | accuracy % |"), F.lit("|-|-|-|-|-|-|-|"))
    return assessed.agg(rows.alias("r")).select(F.array_join(F.concat(head, F.transform("r", lambda x: x["line"])), "\n").alias("markdown"), F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["json"]), ","), F.lit("]")).alias("json"))
