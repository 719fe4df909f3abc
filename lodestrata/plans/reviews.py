"""Queries of the review workflow in full: versions that carry fields on, audit, treatments, states, batches, assessments.
Images are events, patients users, annotations the events of a type."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import ranking as R
from lodestrata.operators import review as V
from lodestrata.plans.registry import query


def _versions(t):
    return t("events").select("user_id", F.col("event_type").alias("label"), "value", F.col("event_id").alias("version_id"), F.floor(F.col("value") / 25).cast("int").alias("version"))


_LAST = "(select * from (select user_id, event_type as label, value, event_id as version_id, floor(value / 25)::int as version, row_number() over (partition by user_id order by floor(value / 25)::int desc, event_id) as r from events) where r = 1)"


@query("wf2_carried_update", f"select user_id, case when c_custkey % 2 = 0 then c_mktsegment else label end as label, case when c_custkey % 3 = 0 then c_acctbal else value end as value, version + 1 as version, version_id as previous_version_id from customer join {_LAST} on user_id = c_custkey")
def carried(t):
    k = F.col("c_custkey")
    updates = t("customer").select(k.alias("user_id"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("label"), F.when(k % 3 == 0, F.col("c_acctbal")).alias("value"))
    return V.updated(_versions(t), updates, "user_id", ["label", "value"])


def _log(t):
    return V.audit_entries(t("events"), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("event_type"), F.col("ts"), ["event_id", "value"])


@query("wf4_audit", "select 'u' || user_id as user_name, event_type as action, event_id from events where event_id::varchar like '77%'")
def audit(t):
    return V.audit_of(_log(t), '"event_id":77').select("user_name", "action", F.get_json_object("details", "$.event_id").cast("long").alias("event_id"))


_FIRST = "(select user_id, arg_min(event_id, (ts, event_id)) as first, arg_max(event_id, (ts, event_id)) as last, count(*) as n from events group by 1)"


@query("wf7_treatments", f"""select user_id, 'kept' as note, case when n > 1 and user_id % 4 > 0 then 'termine' when user_id % 4 > 0 then 'en_traitement' end as status, case when user_id % 4 > 0 then 'u' || first end as started_by, case when n > 1 and user_id % 4 > 0 then 'u' || last end as updated_by from {_FIRST}""")
def treatments(t):
    o = F.struct("ts", "event_id")
    p = t("events").groupBy("user_id").agg(F.min_by("event_id", o).alias("first"), F.max_by("event_id", o).alias("last"), F.count("*").alias("n"))
    who = lambda c: F.concat(F.lit("u"), F.col(c).cast("string"))
    info = F.create_map(F.lit("note"), F.lit("kept"))
    p = p.withColumn("info", F.when(F.col("user_id") % 4 > 0, V.treatment_started(info, F.lit("examens"), who("first"), F.lit("t0"))).otherwise(info))
    p = p.withColumn("info", F.when(F.col("n") > 1, V.treatment_moved(F.col("info"), F.lit("termine"), who("last"), F.lit("t1"))).otherwise(F.col("info")))
    return p.select("user_id", *[F.try_element_at("info", F.lit(k)).alias(n) for k, n in (("note", "note"), ("treatment.status", "status"), ("treatment.started_by", "started_by"), ("treatment.updated_by", "updated_by"))])


@query("wf8_patients", "select user_id, count(*) as n_images, string_agg(event_id::varchar, ',' order by event_id) as images, bool_or(event_type = 'purchase') as annotated from events group by 1")
def patients(t):
    images = t("events").select("user_id", "event_id")
    return V.by_patient(images, t("events").where("event_type = 'purchase'"), "user_id", "event_id").withColumn("images", F.array_join("images", ","))


@query("wf9_batch", "select event_id, user_id, 'sent' as status from events where user_id in (select c_custkey from customer where c_acctbal > 5000)")
def batch(t):
    chosen = t("customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"))
    return V.sent_batch(t("events").select("event_id", "user_id"), chosen, "user_id")


_NAMES = ["en_attente_examens", "hospitalise", "en_traitement", "termine"]


@query("wf13_enforced", f"""with e as (select event_id, (['en_attente_examens', 'hospitalise', 'en_traitement', 'termine'])[event_id % 4 + 1] as status, user_id, ts from events), p as (select event_id, status, coalesce(lag(status) over (partition by user_id order by ts, event_id), 'en_traitement') as before from e)
select event_id, status, before <> 'termine' and before <> status as allowed from p""")
def enforced(t):
    e = t("events").select("event_id", F.element_at(F.array(*[F.lit(x) for x in _NAMES]), (F.col("event_id") % 4 + 1).cast("int")).alias("status"), "user_id", "ts")
    return V.allowed_moves(e, "user_id", "status", ["ts", "event_id"], "en_traitement", V.STATES).select("event_id", "status", "allowed")


@query("wf14_validated", """select c_custkey as image, l.label is not null as validated, l.label from customer left join (select image, label from (select user_id as image, event_type as label, row_number() over (partition by user_id order by floor(value / 25) desc, event_id) as r from events where event_id % 2 = 0) where r = 1) l on l.image = c_custkey""")
def validated(t):
    notes = _versions(t).select(F.col("user_id").alias("image"), "label", "version", "version_id", F.when(F.col("version_id") % 2 == 0, "doctor").otherwise("nurse").alias("role"))
    return V.validated(t("customer").select(F.col("c_custkey").alias("image")), notes, "image", "role", "version", "version_id", ["label"], "doctor").select("image", "validated", "label")


@query("wf1_absent", "select user_id as id from (select distinct user_id from events) where user_id not in (select s_suppkey from supplier)")
def absent(t):
    return t("events").select("user_id").distinct().join(t("supplier"), F.col("user_id") == F.col("s_suppkey"), "left_anti").select(F.col("user_id").alias("id"))


_RUNS = "(select user_id, event_id, ts, case when event_id % 5 > 0 then event_type end as kind, case when event_id % 7 > 0 then floor(value / 50) end as level, list_distinct([event_type, 'k' || (event_id % 3)]) as names from events)"


@query("val4_run_stability", f"""with p as (select user_id, ts, kind, level, names, lead(kind) over w as kind2, lead(level) over w as level2, lead(names) over w as names2, lead(event_id) over w as nx from {_RUNS} window w as (partition by user_id order by event_id)),
s as (select user_id, nx, (kind is not null or kind2 is not null)::int + (level is not null or level2 is not null)::int as has, coalesce(kind = kind2, false)::int + coalesce(level = level2, false)::int as same, len(list_intersect(names, names2)) / len(list_distinct(list_concat(names, names2)))::double as j from p)
select user_id, round(avg(case when has > 0 then same / has else 1 end) filter (nx is not null), 6) as agreement, round(avg(j) filter (nx is not null), 6) as jaccard from s group by 1""")
def run_stability(t):
    k = F.col("event_id")
    runs = t("events").select("user_id", "event_id", F.when(k % 5 > 0, F.col("event_type")).alias("kind"), F.when(k % 7 > 0, F.floor(F.col("value") / 50)).alias("level"), F.array_distinct(F.array("event_type", F.concat(F.lit("k"), (k % 3).cast("string")))).alias("names"))
    return V.stability(runs, "user_id", "event_id", ["kind", "level"], "names").select("user_id", *[F.round(c, 6).alias(c) for c in ("agreement", "jaccard")])


@query("val5_assessment", """with r as (select user_id % 50 as project, event_type as model, count(*) as runs, count(*) filter (value > 80) as errors, count(*) filter (event_id % 2 = 0) as facts, count(*) filter (event_id % 6 = 0) as matched from events group by 1, 2)
select project, model, runs, errors, facts, matched, round(matched / nullif(facts, 0)::double, 9) as accuracy from (select * from r union all select null, model, sum(runs)::bigint, sum(errors)::bigint, sum(facts)::bigint, sum(matched)::bigint from r group by model)""")
def assessed(t):
    e = t("events").withColumns({"project": F.col("user_id") % 50, "model": F.col("event_type"), "matched": (F.col("event_id") % 6 == 0).cast("int")})
    out = V.assessment(e, e.where("value > 80"), e.where("event_id % 2 = 0"), "project", "model")
    return out.withColumn("accuracy", F.round("accuracy", 9))


@query("val2_unconfirmed", "select distinct c_custkey as id, path from (select c_custkey, 'name' as path from customer where c_custkey % 3 = 0 union all select c_custkey, 'bal' from customer where c_acctbal < 0 or c_custkey % 4 = 0)")
def unconfirmed(t):
    """Paths with an error, and those a model calls insufficient where the field is really missing."""
    k = F.col("c_custkey")
    errors = t("customer").where("c_custkey % 3 = 0").select(k.alias("id"), F.lit("name.citations[0]").alias("field_path"))
    said = t("customer").select(k.alias("id"), F.explode(F.array(F.lit("bal"), F.lit("name"))).alias("path"))
    values = t("customer").select(k.alias("id"), F.lit("bal").alias("path"), F.when((F.col("c_acctbal") >= 0) & (k % 4 != 0), F.col("c_acctbal").cast("string")).alias("value")).unionByName(t("customer").select(k.alias("id"), F.lit("name").alias("path"), F.col("c_name").alias("value")))
    return V.open_paths(errors, said, values, "id")


@query("fn26_coherence_whole", """with l as (select page_id, html, len(list_filter(string_split(html, chr(10)), lambda x: trim(x) <> '')) as n, len(list_filter(string_split(html, chr(10)), lambda x: trim(x) <> '' and contains(lower(x), 'div'))) as bad from pages)
select page_id, round(case when n > 0 then least(1.0, greatest(0.0, 0.2 * contains(lower(html), 'objective')::int + 0.3 * contains(lower(html), 'achieve')::int + 0.2 * contains(lower(html), 'data quality')::int + 0.1 * contains(html, '|')::int + greatest(0.0, 0.2 * (1 - least(1.0, bad / n / 0.25))))) else 0 end, 9) as score from l""")
def coherence(t):
    from lodestrata.functions import text as T

    return t("pages").select("page_id", F.round(T.coherence(F.col("html"), "div"), 9).alias("score"))


@query("srt4_recent_by_user", "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r <= 10")
def recent_by_user(t):
    return R.top_k(t("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id")
