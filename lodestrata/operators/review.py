"""A review workflow over append-only tables: versions, audit entries, treatments, states, assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators import ranking
from lodestrata.operators.records import latest_version

#: States of a treatment and those that may follow.
STATES = {"en_traitement": ["en_attente_examens", "hospitalise", "termine"], "en_attente_examens": ["en_traitement", "hospitalise", "termine"], "hospitalise": ["en_traitement", "en_attente_examens", "termine"], "termine": []}


def updated(versions: DataFrame, updates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The new versions that updates (key, fields) give: each field of the update or, where it is null, of the key's latest
    version (versions: key, version, version_id, fields); version counts on and previous_version_id points back.
    Keys without a version give none."""
    last = latest_version(versions, [key], "version", "version_id")
    was = last.select(key, *[F.col(c).alias(f"_{c}") for c in fields], "version", "version_id")
    return updates.join(was, key).select(key, *[F.coalesce(c, f"_{c}").alias(c) for c in fields], (F.col("version") + 1).alias("version"), F.col("version_id").alias("previous_version_id"))


def audit_entries(changes: DataFrame, user: Column, action: Column, at: Column, details: list[str]) -> DataFrame:
    """Rows to append to the audit log: user_name, action, at, details (JSON)."""
    return changes.select(user.alias("user_name"), action.alias("action"), F.to_json(F.struct(*details)).alias("details"), at.alias("at"))


def audit_of(log: DataFrame, ident: str) -> DataFrame:
    """Entries whose details mention an id."""
    return log.where(F.col("details").contains(ident))


def numbered(df: DataFrame, prefix: str, order: list[str], already: int = 0) -> DataFrame:
    """Column id: prefix_1, prefix_2 ... in order, after those already there. Not unique once rows are deleted: prefer uuid()."""
    return ranking.numbered(df, [F.col(c) for c in order], "_n").withColumn("id", F.concat(F.lit(f"{prefix}_"), (F.col("_n") + already).cast("string"))).drop("_n")


def treatment_started(info: Column, action: Column, user: Column, at: Column) -> Column:
    """map<string,string> info with a treatment in it: what was there stays."""
    return F.map_concat(F.map_filter(F.coalesce(info, F.create_map().cast("map<string,string>")), lambda k, _: ~k.startswith("treatment.")), F.create_map(F.lit("treatment.action_type"), action, F.lit("treatment.started_by"), user, F.lit("treatment.started_at"), at, F.lit("treatment.status"), F.lit("en_traitement")))


def treatment_moved(info: Column, status: Column, user: Column, at: Column) -> Column:
    """info with the treatment's new status; unchanged where no treatment was started."""
    new = F.create_map(F.lit("treatment.status"), status, F.lit("treatment.updated_by"), user, F.lit("treatment.updated_at"), at)
    rest = F.map_filter(info, lambda k, _: ~k.isin("treatment.status", "treatment.updated_by", "treatment.updated_at"))
    return F.when(F.map_contains_key(info, "treatment.status"), F.map_concat(rest, new)).otherwise(info)


def allowed_moves(events: DataFrame, key: str, status: str, order: list[str], start: str, states: dict[str, list[str]]) -> DataFrame:
    """events with column allowed: whether each status may follow the one before it (start before the first). All events are
    judged against the one before them, allowed or not."""
    before = F.coalesce(F.lag(status).over(Window.partitionBy(key).orderBy(*order)), F.lit(start))
    moves = F.array(*[F.lit(f"{a}>{b}") for a, bs in states.items() for b in bs])
    return events.withColumn("allowed", F.array_contains(moves, F.concat(before, F.lit(">"), F.col(status))))


def by_patient(images: DataFrame, annotated: DataFrame, patient: str, image: str) -> DataFrame:
    """patient, n_images, images (sorted) and annotated: whether any of them has an annotation."""
    has = images.join(annotated.select(image).distinct().withColumn("_has", F.lit(True)), image, "left")
    return has.groupBy(patient).agg(F.count("*").alias("n_images"), F.array_sort(F.collect_list(image)).alias("images"), F.coalesce(F.bool_or("_has"), F.lit(False)).alias("annotated"))


def sent_batch(images: DataFrame, chosen: DataFrame, patient: str, status: str = "sent") -> DataFrame:
    """The images of chosen patients, as status events to append."""
    return images.join(chosen.select(patient).distinct(), patient, "left_semi").withColumn("status", F.lit(status))


def validated(images: DataFrame, annotations: DataFrame, image: str, role: str, version: str, seq: str, fields: list[str], by: str) -> DataFrame:
    """Of each image whether anyone of role `by` annotated it, and the fields of the latest such annotation."""
    own = latest_version(annotations.where(F.col(role) == by), [image], version, seq).select(image, *fields).withColumn("_v", F.lit(True))
    return images.join(own, image, "left").withColumn("validated", F.coalesce("_v", F.lit(False))).drop("_v")


def stability(runs: DataFrame, project: str, seq: str, scalars: list[str], names: str) -> DataFrame:
    """project, agreement and jaccard averaged over consecutive runs: agreement is the share of scalars equal among those
    that either run has; null with fewer than two runs."""
    w = Window.partitionBy(project).orderBy(seq)
    pairs = runs.select(project, *scalars, names, *[F.lead(c).over(w).alias(f"_{c}") for c in [*scalars, names]], F.lead(seq).over(w).alias("_next"))
    has = sum(((F.col(c).isNotNull() | F.col(f"_{c}").isNotNull()).cast("int") for c in scalars), F.lit(0))
    same = sum((F.coalesce((F.col(c) == F.col(f"_{c}")).cast("int"), F.lit(0)) for c in scalars), F.lit(0))
    union = F.size(F.array_union(names, f"_{names}"))
    jaccard = F.when(union > 0, F.size(F.array_intersect(names, f"_{names}")) / union).otherwise(1.0)
    agree = F.when(has > 0, same / has).otherwise(1.0)
    some = F.col("_next").isNotNull()
    return pairs.groupBy(project).agg(F.avg(F.when(some, agree)).alias("agreement"), F.avg(F.when(some, jaccard)).alias("jaccard"))


def assessment(runs: DataFrame, errors: DataFrame, gold: DataFrame, project: str, model: str) -> DataFrame:
    """One row a project and model, and one a model (project null): runs, errors, facts, matched and accuracy."""
    per = lambda df, name: df.groupBy(project, model).agg(F.count("*").alias(name))
    facts = gold.groupBy(project, model).agg(F.count("*").alias("facts"), F.sum("matched").alias("matched"))
    each = per(runs, "runs").join(per(errors, "errors"), [project, model], "left").join(facts, [project, model], "left").fillna(0)
    rolled = each.groupBy(model).agg(*[F.sum(c).alias(c) for c in ("runs", "errors", "facts", "matched")]).withColumn(project, F.lit(None))
    return each.unionByName(rolled).withColumn("accuracy", F.try_divide("matched", "facts"))


def open_paths(errors: DataFrame, insufficient: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """key, path: paths with an error (key, field_path; cut before citations), and those called insufficient (key, path) whose
    value (key, path, value) is missing or empty."""
    from lodestrata.functions import parsing as P

    filled = values.where("value is not null and trim(value) <> ''")
    missing = insufficient.select(key, "path").join(filled, [key, "path"], "left_anti")
    return errors.select(key, P.field_path(F.col("field_path")).alias("path")).union(missing).distinct()
