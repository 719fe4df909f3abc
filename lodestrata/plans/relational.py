"""Queries of typing, filtering, joining, aggregating and sampling over the star schema and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import parsing as P
from lodestrata.operators import ranking as R
from lodestrata.plans.registry import query


@query("prj1_fn11_json_typed", "select event_id, try_cast(json_extract_string(props, '$.k') as int) as k, json_extract_string(props, '$.k') is not null as has_k, coalesce(nullif(event_type, ''), 'unknown') as kind from events")
def typed(t):
    k = P.json_path(F.col("props"), F.lit("k"))
    return t("events").select("event_id", k.try_cast("int").alias("k"), k.isNotNull().alias("has_k"), P.first_filled(F.col("event_type"), F.lit("unknown")).alias("kind"))


@query("fn1_money", "select p_partkey, case p_partkey % 4 when 0 then null when 1 then p_retailprice else 1234.5 end as amount from part")
def money(t):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, " N/A").when(k == 1, F.col("p_retailprice").cast("string")).otherwise("1,234.50 ")
    return t("part").select("p_partkey", P.money(raw).alias("amount"))


@query("fn2_moments", "select o_orderkey, case when o_orderkey % 4 = 3 then null else date_trunc('day', o_orderdate)::timestamp end as at from orders")
def moments(t):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format(d, "yyyy-MM-dd'T00:00:00Z'")).when(k == 1, F.date_format(d, "yyyy-MM-dd 00:00:00.0")).when(k == 2, F.date_format(d, "M/d/yyyy '12:00:00 AM'")).otherwise("soon")
    return t("orders").select("o_orderkey", P.moment(raw).alias("at"))


@query("fn12_fn33_keys", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, o_totalprice as price from orders")
def keys(t):
    return t("orders").select("o_orderkey", P.compact_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("day"), P.number_key(F.col("o_totalprice").cast("string")).alias("price"))


@query("fn14_millions", "select s_suppkey, format('{:,}', (s_suppkey * 1500000)::bigint) as usd from supplier")
def millions(t):
    return t("supplier").select("s_suppkey", P.millions_to_usd((F.col("s_suppkey") * 1.5).cast("string")).alias("usd"))


@query("fn22_json_repair", "select event_id, props as fixed from events")
def repair(t):
    return t("events").select("event_id", P.repaired_json(F.concat(F.lit("Answer: "), F.col("props"), F.lit(" done."))).alias("fixed"))


@query("fn35_params", "select p_partkey, 'brand=' || p_brand || ',size=' || p_size as params from part")
def params(t):
    return t("part").select("p_partkey", P.sorted_params(F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))).alias("params"))


@query("prj5_prj6_prj16_rows", "select l_orderkey, l_linenumber, round(coalesce(l_discount, 0) + coalesce(l_tax, 0), 6) as total, round((l_discount + l_tax + l_quantity) / 3, 6) as mean from lineitem")
def rows(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(F.coalesce("l_discount", F.lit(0.0)) + F.coalesce("l_tax", F.lit(0.0)), 6).alias("total"), F.round((F.col("l_discount") + F.col("l_tax") + F.col("l_quantity")) / 3, 6).alias("mean"))


@query("prj7_prj8_guarded", "select o_orderkey, (120 - o_orderkey % 100)::bigint as tenure, case when o_orderkey % 7 = 0 then null else round(o_totalprice / (o_orderkey % 7), 6) end as per, (o_totalprice > 100000)::int as high, case when o_custkey % 5 <= 3 then 1 else 0 end as recent from orders")
def guarded(t):
    k = F.col("o_orderkey") % 7
    return t("orders").select("o_orderkey", (120 - F.col("o_orderkey") % 100).alias("tenure"), F.round(F.try_divide("o_totalprice", k), 6).alias("per"), (F.col("o_totalprice") > 100_000).cast("int").alias("high"), F.when(F.col("o_custkey") % 5 <= 3, 1).otherwise(0).alias("recent"))


@query("prj12_attainment", "select l_orderkey, l_linenumber, case when l_tax = 0 then null when l_discount / l_tax >= 1 then 'met' when l_discount / l_tax >= 0.5 then 'partial' else 'not' end as bucket from lineitem")
def attainment(t):
    r = F.try_divide("l_discount", "l_tax")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.when(r >= 1, "met").when(r >= 0.5, "partial").when(r.isNotNull(), "not").alias("bucket"))


@query("flt1_flt8_filters", "select o_orderkey from orders where o_orderstatus = 'F' and o_totalprice > 50000 and o_orderpriority in ('1-URGENT', '2-HIGH') and contains(lower(o_orderpriority), 'urgent')")
def filters(t):
    return t("orders").where("o_orderstatus = 'F' and o_totalprice > 50000").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).where(F.lower("o_orderpriority").contains("urgent")).select("o_orderkey")


@query("flt5_anti", "select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey)")
def anti(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("flt10_flt12_details", "select event_id from events where contains(props, '1') and isfinite(value) and value > 0")
def details(t):
    return t("events").where(F.contains("props", F.lit("1")) & ~F.isnan("value") & (F.abs("value") < float("inf")) & (F.col("value") > 0)).select("event_id")


@query("joi1_joi14_lookup", "select l_orderkey, l_linenumber, coalesce(nullif(p_brand, ''), s_name, 'none') as label from lineitem left join part on p_partkey = l_partkey left join supplier on s_suppkey = l_suppkey")
def lookup(t):
    j = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey"), "left").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return j.select("l_orderkey", "l_linenumber", F.coalesce(F.nullif("p_brand", F.lit("")), "s_name", F.lit("none")).alias("label"))


@query("joi5_full_chain", """with o as (select c_nationkey as k, sum(o_totalprice) as total from orders join customer on c_custkey = o_custkey where c_nationkey < 15 group by 1), s as (select s_nationkey as k, count(*) as suppliers from supplier where s_nationkey > 5 group by 1)
select coalesce(n_nationkey, o.k, s.k) as k, round(total, 2) as total, coalesce(suppliers, 0) as suppliers from nation full join o on n_nationkey is not distinct from o.k full join s on coalesce(n_nationkey, o.k) is not distinct from s.k""")
def full_chain(t):
    o = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("o_totalprice").alias("total"))
    s = t("supplier").where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    n = t("nation").select(F.col("n_nationkey").alias("k"))
    return n.join(o, "k", "full").join(s, "k", "full").select("k", F.round("total", 2).alias("total"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("joi6_joi8_enriched", """with f as (select user_id, arg_min(event_type, (ts, event_id)) as first_type, arg_max(event_type, (ts, event_id)) as last_type from events group by user_id)
select c_custkey, coalesce(first_type, 'N/A') as first_type, coalesce(last_type, 'N/A') as last_type, coalesce(n_name, 'N/A') as nation from customer left join f on user_id = c_custkey left join nation on n_nationkey = c_nationkey""")
def enriched(t):
    e = t("events")
    first = R.earliest(e, ["user_id"], "ts", "event_id").select("user_id", F.col("event_type").alias("first_type"))
    last = R.latest(e, ["user_id"], "ts", "event_id").select("user_id", F.col("event_type").alias("last_type"))
    n = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    j = t("customer").withColumnRenamed("c_custkey", "user_id").join(first, "user_id", "left").join(last, "user_id", "left").join(n, "c_nationkey", "left").fillna("N/A", ["first_type", "last_type", "nation"])
    return j.select(F.col("user_id").alias("c_custkey"), "first_type", "last_type", "nation")


@query("joi15_semi", "select s_suppkey, s_nationkey from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey = 1)")
def semi(t):
    return t("supplier").join(t("nation").where("n_regionkey = 1"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey", "s_nationkey")


@query("joi17_win7_run_pairs", """with r as (select user_id, event_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events), p as (select *, lead(value) over (partition by user_id order by k) as before from r where k <= 5)
select user_id, count(before) as pairs, round(avg(value - before), 6) as change from p group by user_id""")
def run_pairs(t):
    last = R.top_k(t("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5)
    p = last.withColumn("before", F.lead("value").over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))
    return p.groupBy("user_id").agg(F.count("before").alias("pairs"), F.round(F.avg(F.col("value") - F.col("before")), 6).alias("change"))


@query("agg3_agg9_pivot", "select c_mktsegment, count(*) filter (o_orderstatus = 'F') as F, count(*) filter (o_orderstatus = 'O') as O, count(*) filter (o_orderstatus = 'P') as P from orders join customer on c_custkey = o_custkey group by 1")
def pivot(t):
    j = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    return j.groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


@query("agg9_pivot_years", "select o_custkey, " + ", ".join(f"round(coalesce(sum(o_totalprice) filter (year(o_orderdate) = {y}), 0), 2) as y{y}" for y in range(1992, 1999)) + " from orders group by 1")
def pivot_years(t):
    g = t("orders").withColumn("y", F.year("o_orderdate")).groupBy("o_custkey").pivot("y", list(range(1992, 1999)))
    return g.agg(F.sum("o_totalprice")).select("o_custkey", *[F.round(F.coalesce(F.col(str(y)), F.lit(0.0)), 2).alias(f"y{y}") for y in range(1992, 1999)])


@query("agg10_unpivot", "select l_orderkey, l_linenumber, unnest(['l_discount', 'l_tax']) as name, unnest([l_discount, l_tax]) as value from lineitem")
def unpivot(t):
    return t("lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "name", "value")


@query("agg6_agg7_agg14_describe", "select p_brand, count(*) as n, round(avg(p_retailprice), 6) as mean, round(stddev_samp(p_retailprice), 6) as sd, median(p_retailprice) as med, max(p_size) as top, row_number() over (order by avg(p_retailprice) desc, p_brand)::int as rank from part group by p_brand")
def describe(t):
    g = t("part").groupBy("p_brand").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("mean"), F.round(F.stddev_samp("p_retailprice"), 6).alias("sd"), F.median("p_retailprice").alias("med"), F.max("p_size").alias("top"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), "p_brand"))).withColumn("mean", F.round("mean", 6))


@query("agg8_pivot_mean", "select p_brand, round(avg(p_retailprice) filter (p_size <= 25), 6) as small, round(avg(p_retailprice) filter (p_size > 25), 6) as large from part group by 1")
def pivot_mean(t):
    p = t("part").withColumn("s", F.when(F.col("p_size") <= 25, "small").otherwise("large"))
    return p.groupBy("p_brand").pivot("s", ["small", "large"]).agg(F.round(F.avg("p_retailprice"), 6))


@query("agg12_agg13_shares", "select c_nationkey, c_mktsegment, count(*) as n, round(count(*) / sum(count(*)) over (partition by c_nationkey), 6) as within, round(count(*) / sum(count(*)) over (), 6) as share from customer group by 1, 2")
def shares(t):
    g = t("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return g.select("*", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("c_nationkey")), 6).alias("within"), F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("agg4_agg18_top", "select l_suppkey, count(*) as n, round(sum(l_extendedprice), 2) as flow from lineitem group by 1 order by n desc, l_suppkey limit 8")
def top(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("flow")).orderBy(F.desc("n"), "l_suppkey").limit(8)


@query("agg23_agg30_totals", "select count(*) filter (o_orderstatus = 'F') as done, count(*) filter (o_orderstatus = 'O') as open, count(*) filter (o_orderstatus not in ('F', 'O')) as other from orders")
def totals(t):
    c = lambda x: F.count(F.when(x, 1))
    s = F.col("o_orderstatus")
    return t("orders").agg(c(s == "F").alias("done"), c(s == "O").alias("open"), c(~s.isin("F", "O")).alias("other"))


@query("agg24_model_averages", "select coalesce(nullif(event_type, ''), 'unknown') as model, count(*) as runs, round(avg(value), 6) as mean from events group by 1")
def model_averages(t):
    return t("events").groupBy(P.first_filled(F.col("event_type"), F.lit("unknown")).alias("model")).agg(F.count("*").alias("runs"), F.round(F.avg("value"), 6).alias("mean"))


@query("agg27_covariance", "select l_returnflag, round(covar_samp(l_quantity, l_extendedprice), 4) as qe, round(covar_samp(l_discount, l_tax), 9) as dt from lineitem group by 1")
def covariance(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.covar_samp("l_quantity", "l_extendedprice"), 4).alias("qe"), F.round(F.covar_samp("l_discount", "l_tax"), 9).alias("dt"))


@query("agg29_mse", "select round(avg(pow(l_discount - l_tax, 2)), 9) as mse from lineitem")
def mse(t):
    return t("lineitem").agg(F.round(F.avg(F.pow(F.col("l_discount") - F.col("l_tax"), 2)), 9).alias("mse"))


@query("win3_latest", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def latest(t):
    return R.latest(t("events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("win6_set2_src11_first", "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as r from events) where r = 1")
def first(t):
    return R.earliest(t("events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@query("win8_win9_ranks", "select s_suppkey, row_number() over (order by s_acctbal desc, s_suppkey)::int as place, rank() over (partition by s_nationkey order by round(s_acctbal, -3)) + (count(*) over (partition by s_nationkey, round(s_acctbal, -3)) - 1) / 2 as avg_rank from supplier")
def ranks(t):
    s = t("supplier").withColumn("b", F.round("s_acctbal", -3))
    s = R.numbered(s, [F.desc("s_acctbal"), F.col("s_suppkey")]).withColumn("place", F.col("place").cast("int"))
    return s.select("s_suppkey", "place", R.average_rank("b", ["s_nationkey"]).alias("avg_rank"))


@query("win11_vl6_first_match", "select user_id, arg_min(value, (ts, event_id)) filter (value > 50) as first_high, arg_min(event_type, (ts, event_id)) filter (event_type <> 'click') as first_other from events group by 1")
def first_match(t):
    o = F.struct("ts", "event_id")
    return t("events").groupBy("user_id").agg(F.min_by(F.when(F.col("value") > 50, F.col("value")), F.when(F.col("value") > 50, o)).alias("first_high"), F.min_by(F.when(F.col("event_type") != "click", F.col("event_type")), F.when(F.col("event_type") != "click", o)).alias("first_other"))


@query("srt7_topk_long", "select metric, rank, s_suppkey from (select 'quantity' as metric, l_suppkey as s_suppkey, row_number() over (order by sum(l_quantity) desc, l_suppkey)::int as rank from lineitem group by 2 union all select 'lines', l_suppkey, row_number() over (order by count(*) desc, l_suppkey)::int from lineitem group by 2) where rank <= 10")
def topk_long(t):
    g = t("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("l_quantity").alias("quantity"), F.count("*").cast("double").alias("lines"))
    u = g.unpivot("s_suppkey", ["quantity", "lines"], "metric", "v")
    return u.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("v"), "s_suppkey"))).where("rank <= 10").select("metric", "rank", "s_suppkey")


@query("srt8_set3_candidates", "select l_suppkey from (select l_suppkey from lineitem group by 1 order by sum(l_quantity) desc, l_suppkey limit 10) union (select l_suppkey from lineitem group by 1 order by count(*) desc, l_suppkey limit 10)")
def candidates(t):
    g = t("lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    return g.orderBy(F.desc("q"), "l_suppkey").limit(10).union(g.orderBy(F.desc("n"), "l_suppkey").limit(10)).select("l_suppkey").distinct()


@query("set4_topk_overlap", """with g as (select s_nationkey, l_suppkey, row_number() over (partition by s_nationkey order by sum(l_quantity) desc, l_suppkey) as a, row_number() over (partition by s_nationkey order by count(*) desc, l_suppkey) as b from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2)
select s_nationkey, round(count(*) filter (a <= 3 and b <= 3) / least(3, count(*))::double, 6) as overlap from g group by 1""")
def overlap(t):
    g = t("lineitem").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy("s_nationkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    return R.overlap(g, "q", "n", "l_suppkey", ["s_nationkey"], 3).withColumn("overlap", F.round("overlap", 6))


@query("set1_union", "select c_custkey as key, c_acctbal as bal from customer union all select s_suppkey, s_acctbal from supplier")
def union(t):
    return t("customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("bal")).unionByName(t("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("bal")))


@query("set7_set8_stratified", "select o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_orderstatus order by md5('s' || o_orderkey), o_orderkey) as r from orders) where r <= (case o_orderstatus when 'F' then 50 when 'O' then 100 else 0 end)")
def stratified(t):
    return R.stratified(t("orders"), "o_orderstatus", {"F": 50, "O": 100}, "s", "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("set9_split", "select o_orderkey, case when p < 0.7 then 'train' when p < 0.85 then 'valid' else 'test' end as split from (select o_orderkey, (row_number() over (partition by o_orderstatus order by md5('t' || o_orderkey), o_orderkey) - 1) / count(*) over (partition by o_orderstatus) as p from orders)")
def split(t):
    return R.split(t("orders"), ["o_orderstatus"], {"train": 0.7, "valid": 0.15, "test": 0.15}, "t", "o_orderkey").select("o_orderkey", "split")


@query("set12_sampled_nodes", "select n_nationkey from nation order by md5('n' || n_nationkey), n_nationkey limit 7")
def sampled(t):
    return t("nation").orderBy(R.hash_order("n", "n_nationkey"), "n_nationkey").limit(7).select("n_nationkey")


@query("set6_merge", "select c_custkey, coalesce(nullif(c_mktsegment, ''), n_name) as name, coalesce(c_acctbal, 0) as bal from customer left join nation on n_nationkey = c_nationkey")
def merge(t):
    j = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return j.select("c_custkey", P.first_filled(F.col("c_mktsegment"), F.col("n_name")).alias("name"), F.coalesce("c_acctbal", F.lit(0.0)).alias("bal"))
