"""Typed tables out of JSON payloads, attribute joins, merges, hash splits and orders chosen at run time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import documents as D
from lodestrata.functions import parsing as P


def _iso(x: Column) -> Column:
    return F.date_format(P.moment(x), "yyyy-MM-dd'T'HH:mm:ss")


def projects(bronze: DataFrame) -> DataFrame:
    """16 columns of bronze (payload_json, ingested_at, dataset_version_id); rows without an id go."""
    js = lambda k: F.get_json_object("payload_json", f"$.{k}")
    either = lambda *ks: P.first_filled(*[js(k) for k in ks])
    zero_is_empty = lambda k: F.nullif(js(k), F.lit("0"))
    of = {
        "project_id": F.trim(js("id")), "project_name": either("project_name", "proj_title"), "status": either("status", "projectstatusdisplay"),
        "regionname": js("regionname"), "country_iso2": P.first_of(js("countrycode")), "country_name": P.first_filled(P.first_of(js("countryname")), js("countryshortname")),
        "approval_fy": js("approvalfy"), "board_approval_date": _iso(js("boardapprovaldate")), "closing_date": _iso(js("closingdate")),
        "total_commitment_usd": P.money(P.first_filled(zero_is_empty("totalamt"), js("totalcommamt"))), "lending_instrument": js("lendinginstr"), "prodline": js("prodline"),
        "updated_at": _iso(js("p2a_updated_date")), "source_url": js("url"), "ingested_at": F.col("ingested_at"), "dataset_version_id": F.col("dataset_version_id"),
    }
    return with_key(bronze.select(*[c.alias(n) for n, c in of.items()]), "project_id")


def documents(bronze: DataFrame) -> DataFrame:
    """18 columns of bronze (payload_json, project_id, doc_id, ingested_at, dataset_version_id); rows without an id go."""
    js = lambda k: F.get_json_object("payload_json", f"$.{k}")
    title, kind, major, pdf = P.first_filled(js("display_title"), js("repnme.repnme")), js("docty"), js("majdocty"), js("pdfurl")
    has_pdf, public = F.coalesce(pdf != "", F.lit(False)), F.coalesce(F.lower(js("seccl")) == "public", F.lit(False))
    cls = D.document_class(title, kind, major)
    of = {
        "doc_id": F.trim(P.first_filled(js("id"), js("repnb"), F.col("doc_id").cast("string"))), "project_id": D.filled(F.col("project_id").cast("string")), "doc_type": P.first_filled(kind, major),
        "doc_class": cls, "doc_score": D.document_score(cls, has_pdf, public, title, kind, major), "language": P.first_filled(js("lang"), js("available_in")), "title": title,
        "publication_date": _iso(js("docdt")), "stored_date": _iso(js("datestored")), "disclosure_date": _iso(js("disclosure_date")), "pdf_url": pdf, "txt_url": js("txturl"), "url": js("url"),
        "security_classification": js("seccl"), "is_public": public, "has_pdf": has_pdf, "dataset_version_id": F.col("dataset_version_id"), "ingested_at": F.col("ingested_at"),
    }
    return with_key(bronze.select(*[c.alias(n) for n, c in of.items()]), "doc_id")


def with_key(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not empty but for white space."""
    return df.where(F.trim(F.coalesce(key, F.lit(""))) != "")


def readable(df: DataFrame) -> DataFrame:
    """Documents to read: with a PDF or any address, and public (unknown is not)."""
    return df.where("has_pdf or url is not null").where("is_public")


def merged_on(key: str, *tables: DataFrame) -> DataFrame:
    """Full outer join of tables on a key that each holds once."""
    return reduce(lambda a, b: a.join(b, key, "full"), tables)


def with_attributes(nodes: DataFrame, key: str, *sources: DataFrame) -> DataFrame:
    """nodes with the attributes of sources: later sources override where they have a value; the first row of a repeated
    key within a source counts, in the order of all its columns. Attributes of other keys are left out."""
    out = nodes
    for s in sources:
        names = [c for c in s.columns if c != key]
        once = s.groupBy(key).agg(F.min(F.struct(*names)).alias("_new"))
        had = out.columns
        out = out.join(once, key, "left").select(*[F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in had], *[F.col(f"_new.{c}").alias(c) for c in names if c not in had])
    return out


def hash_share(seed: str, key: str) -> Column:
    """A number of [0, 1) for each key, the same at every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def hash_split(df: DataFrame, bounds: dict[str, float], last: str, seed: str, key: str) -> DataFrame:
    """Column split: the first name whose upper bound is above the row's hash share. No shuffle: every row decides alone."""
    out = F.lit(last)
    for name, bound in reversed(bounds.items()):
        out = F.when(hash_share(seed, key) < bound, name).otherwise(out)
    return df.withColumn("split", out)


def ordered_by(df: DataFrame, choices: dict[str, list[Column]], choice: str, n: int | None = None) -> DataFrame:
    """df in an order chosen by name; with n, its first rows only."""
    if choice not in choices:
        raise ValueError(f"no order {choice}: {', '.join(choices)}")
    out = df.orderBy(*choices[choice])
    return out.limit(n) if n else out


def relevelled(df: DataFrame, column: str, reference, levels: list) -> DataFrame:
    """Indicator columns column_<level> of every level but the reference."""
    return df.withColumns({f"{column}_{v}": (F.col(column) == F.lit(v)).cast("int") for v in levels if v != reference})


def merged_items(old: Column, new: Column, keys: list[str]) -> Column:
    """Array old, then those of new whose keys (case and white space aside) old has not; null is empty."""
    ident = lambda x: F.concat_ws("\x1f", *[F.lower(F.trim(F.coalesce(x[k], F.lit("")))) for k in keys])
    have = F.coalesce(F.transform(old, ident), F.array().cast("array<string>"))
    added = F.filter(new, lambda x, i: ~F.array_contains(have, ident(x)) & (F.array_position(F.transform(new, ident), ident(x)) == i + 1))
    return F.coalesce(F.concat(old, added), old, added)


def filled_from(old: Column, new: Column, fields: list) -> Column:
    """A struct in which every field of old that is null or empty takes that of new; a field given as (name, fields)
    is a struct that is merged in the same way."""
    out = []
    for f in fields:
        if isinstance(f, tuple):
            out.append(filled_from(old[f[0]], new[f[0]], f[1]).alias(f[0]))
        else:
            out.append(F.coalesce(F.nullif(old[f], F.lit("")), new[f]).alias(f))
    return F.struct(*out)


def profile(df: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """Size and means of each cluster."""
    return df.groupBy(cluster).agg(F.count("*").alias("size"), *[F.avg(c).alias(f"mean_{c}") for c in columns])


def full_report(per_class: DataFrame) -> DataFrame:
    """Rows of a class report (label, precision, recall, f1, support) and accuracy, macro and weighted averages."""
    mean = lambda c: F.avg(c)
    weighted = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    names = ["precision", "recall", "f1"]
    macro = per_class.agg(F.lit("macro avg").alias("label"), *[mean(c).alias(c) for c in names], F.sum("support").alias("support"))
    weight = per_class.agg(F.lit("weighted avg").alias("label"), *[weighted(c).alias(c) for c in names], F.sum("support").alias("support"))
    share = F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support"))
    accuracy = per_class.agg(F.lit("accuracy").alias("label"), *[share.alias(c) for c in names], F.sum("support").alias("support"))
    return per_class.withColumn("label", F.col("label").cast("string")).unionByName(accuracy).unionByName(macro).unionByName(weight)


def latest_version(df: DataFrame, by: list[str], version: str, seq: str) -> DataFrame:
    """The row of the highest version of each key, the first of equals in the order of seq."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(version), seq)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
