"""Queries of a review workflow over append-only logs: events are versions, statuses and audit entries of users."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.operators import ranking as R
from lodestrata.plans.registry import query


@query("wf1_insert_if_absent", "select user_id as id from (select distinct user_id from events) where user_id not in (select c_custkey from customer where c_custkey % 2 = 0)")
def insert_if_absent(t):
    return t("events").select("user_id").distinct().join(t("customer").where("c_custkey % 2 = 0"), F.col("user_id") == F.col("c_custkey"), "left_anti").select(F.col("user_id").alias("id"))


@query("wf2_win4_versions", "select user_id, event_id, row_number() over (partition by user_id order by ts, event_id)::int as version, lag(event_id) over (partition by user_id order by ts, event_id) as previous from events")
def versions(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("user_id", "event_id", F.row_number().over(w).alias("version"), F.lag("event_id").over(w).alias("previous"))


@query("wf3_status", "select event_type as status, count(*) as users from (select user_id, arg_max(event_type, (ts, event_id)) as event_type from events group by 1) group by 1")
def status(t):
    return R.latest(t("events"), ["user_id"], "ts", "event_id").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("users"))


@query("wf5_all_any", "select user_id, bool_or(event_type = 'purchase') as any_purchase, bool_and(value > 1) as all_high from events group by 1")
def all_any(t):
    return t("events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("any_purchase"), F.bool_and(F.col("value") > 1).alias("all_high"))


@query("wf6_wf8_summary", "select user_id, count(*) as n, string_agg(event_id::varchar, ',' order by event_id) as ids from events group by 1")
def summary(t):
    return t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("ids"))


@query("wf10_wf11_defaults", "with p as (select user_id, arg_max(event_type, (ts, event_id)) as label from events where event_type = 'purchase' group by 1) select c_custkey, coalesce(label, case when c_acctbal > 0 then 'sound' end, 'unknown') as label, nullif(c_nationkey, 0) as nation from customer left join p on user_id = c_custkey")
def defaults(t):
    p = R.latest(t("events").where("event_type = 'purchase'"), ["user_id"], "ts", "event_id").select("user_id", "event_type")
    j = t("customer").join(p, F.col("user_id") == F.col("c_custkey"), "left")
    return j.select("c_custkey", F.coalesce("event_type", F.when(F.col("c_acctbal") > 0, "sound"), F.lit("unknown")).alias("label"), F.nullif("c_nationkey", F.lit(0)).alias("nation"))


@query("wf12_joi7_untreated", "with l as (select user_id, arg_max(event_type, (ts, event_id)) as kind, arg_max(props, (ts, event_id)) as props from events group by 1) select user_id, kind from l where json_extract_string(props, '$.k')::int < 50")
def untreated(t):
    l = R.latest(t("events"), ["user_id"], "ts", "event_id")  # noqa: E741
    return l.where(F.get_json_object("props", "$.k").try_cast("int") < 50).select("user_id", F.col("event_type").alias("kind"))


@query("wf13_transitions", "select a, b, count(*) as n from (select event_type as a, lead(event_type) over (partition by user_id order by ts, event_id) as b from events) where b is not null group by 1, 2")
def transitions(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = t("events").select(F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b")).where("b is not null")
    return p.groupBy("a", "b").agg(F.count("*").alias("n"))


@query("prj10_prj11_srt6_priority", "select event_id, 1 - (event_type = 'click')::int as open, case event_type when 'purchase' then 2 when 'click' then 1 else 0 end as priority from events order by priority desc, event_id limit 100")
def priority(t):
    p = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    return t("events").select("event_id", (1 - (F.col("event_type") == "click").cast("int")).alias("open"), p.alias("priority")).orderBy(F.desc("priority"), "event_id").limit(100)


@query("val3_agg25_gold", """with e as (select user_id, arg_max(props, (ts, event_id)) as js from events group by 1), g as (select c_custkey as id, (c_custkey % 100)::varchar as want from customer)
select count(*) as facts, count(*) filter (try_cast(json_extract_string(js, '$.k') as double) = want::double) as matched, round(count(*) filter (try_cast(json_extract_string(js, '$.k') as double) = want::double) / count(*)::double, 9) as accuracy from g left join e on user_id = id""")
def gold(t):
    e = R.latest(t("events"), ["user_id"], "ts", "event_id").select("user_id", "props")
    j = t("customer").join(e, F.col("user_id") == F.col("c_custkey"), "left")
    hit = F.count(F.when(F.get_json_object("props", "$.k").try_cast("double") == (F.col("c_custkey") % 100).cast("double"), 1))
    return j.agg(F.count("*").alias("facts"), hit.alias("matched"), F.round(F.coalesce(F.try_divide(hit, F.count("*")), F.lit(0.0)), 9).alias("accuracy"))


@query("snk6_export_counts", "select count(*) as total, count(*) filter (quality = 1) as positive, count(*) filter (quality = 0) as negative from labels")
def export(t):
    return t("labels").agg(F.count("*").alias("total"), F.count(F.when(F.col("quality") == 1, 1)).alias("positive"), F.count(F.when(F.col("quality") == 0, 1)).alias("negative"))
