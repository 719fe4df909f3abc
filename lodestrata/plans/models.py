"""Queries of the statistical models in full, with SQL where a closed form exists."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import models as M
from lodestrata.operators import ranking as R
from lodestrata.operators import stats as S
from lodestrata.plans.registry import query


@query("ml2_kendall", """with g as (select s_nationkey, l_suppkey, round(sum(l_quantity) / 500) as q, round(sum(l_extendedprice) / 1e6) as e from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2),
p as (select a.s_nationkey, sum(sign(a.q - b.q) * sign(a.e - b.e)) as s, sum((a.q <> b.q)::int) as nq, sum((a.e <> b.e)::int) as ne from g a join g b on a.s_nationkey = b.s_nationkey and a.l_suppkey < b.l_suppkey group by 1)
select n.s_nationkey, case when nq > 0 and ne > 0 then round(s / sqrt(nq * ne::double), 9) end as tau, n.n from (select s_nationkey, count(*) as n from g group by 1) n left join p using (s_nationkey)""")
def kendall(t):
    g = t("lineitem").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy("s_nationkey", "l_suppkey").agg(F.round(F.sum("l_quantity") / 500).alias("q"), F.round(F.sum("l_extendedprice") / 1e6).alias("e"))
    return R.kendall(g, "q", "e", ["s_nationkey"]).withColumn("tau", F.round("tau", 9))


def _life(t):
    j = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(F.col("l_returnflag").alias("plan"), F.date_diff("l_shipdate", "o_orderdate").alias("time"), (F.col("l_linestatus") == "F").cast("int").alias("event"), (F.col("l_discount") > 0.05).cast("int").alias("x")).where("time > 0")


_CURVE = """l as (select l_returnflag as plan, date_diff('day', o_orderdate, l_shipdate) as time, (l_linestatus = 'F')::int as event from lineitem join orders on o_orderkey = l_orderkey where date_diff('day', o_orderdate, l_shipdate) > 0),
p as (select plan, time, count(*) as n, sum(event) as events from l group by 1, 2), r as (select plan, time, events, sum(n) over (partition by plan order by time desc) as at_risk from p),
c as (select plan, time, case when max((at_risk = events)::int) over w = 1 then 0 else exp(sum(case when at_risk > events then ln((at_risk - events) / at_risk::double) else 0 end) over w) end as survival, sum(case when at_risk > events then events / (at_risk * (at_risk - events))::double else 0 end) over w as green from r window w as (partition by plan order by time))"""


@query("ml21_quartiles", f"with {_CURVE} select plan, share, min(time) filter (survival <= 1 - share + 1e-12)::int as time from c, (values (0.25::double), (0.5), (0.75)) s(share) group by 1, 2")
def quartiles(t):
    return S.survival_quartiles(S.kaplan_meier(_life(t), "time", "event", ["plan"]), "time", ["plan"])


@query("ml21_bounds", f"with {_CURVE} select plan, time::int as time, case when survival > 0 then round(survival * exp(-1.959963984540054 * sqrt(green)), 9) end as lower, case when survival > 0 then round(least(1.0, survival * exp(1.959963984540054 * sqrt(green))), 9) end as upper from c")
def bounds(t):
    c = S.survival_bounds(S.kaplan_meier(_life(t), "time", "event", ["plan"]))
    return c.select("plan", "time", F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"))


@query("ml21_restricted_mean", f"with {_CURVE}, n as (select plan, time, survival, coalesce(lead(time) over (partition by plan order by time), 200) as nxt from c where time < 200) select plan, round(sum((least(nxt, 200) - time) * survival) + min(time), 6) as mean from n group by 1")
def restricted(t):
    return S.restricted_mean(S.kaplan_meier(_life(t), "time", "event", ["plan"]), "time", ["plan"], 200.0).withColumn("mean", F.round("mean", 6))


@query("ml22_ml23_cox_exact")
def cox(t):
    m = M.Cox(M.risk_table(_life(t), "time", "event", "x"))
    (lr, p), (sch, q) = m.likelihood_ratio(), m.schoenfeld()
    return t("nation").sparkSession.createDataFrame([(float(m.beta), float(m.se), lr, p, sch, q)], "beta double, se double, likelihood_ratio double, p double, schoenfeld double, schoenfeld_p double")


def _orders(t):
    o = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    return o.select("o_orderkey", (F.col("o_totalprice") / 1e5).alias("price"), (F.col("c_acctbal") / 1e3).alias("bal"), (F.col("o_custkey") % 13).cast("double").alias("noise"), (F.col("o_totalprice") + 20 * F.col("c_acctbal") + (F.col("o_orderkey") * 7919 % 100_000) > 260_000).cast("double").alias("label"))


@query("ml12_stepwise")
def stepwise(t):
    rows = [(by, i, change, ",".join(own), float(value)) for by, steps in M.stepwise_by(_orders(t), ["price", "bal", "noise"], "label", ["aic", "bic"]).items() for i, change, own, value in steps]
    return t("nation").sparkSession.createDataFrame(rows, "criterion string, step int, change string, columns string, value double")


@query("ml11_ml14_lasso")
def lasso(t):
    """Main effects, all products and squares; lambda by five folds of a hash."""
    d, terms = M.expanded(_orders(t), ["price", "bal", "noise"])
    d = d.withColumn("fold", F.pmod(F.xxhash64("o_orderkey"), F.lit(5)).cast("int"))
    d = d.withColumnsRenamed({c: c.replace(":", "_") for c in terms})
    terms = [c.replace(":", "_") for c in terms]
    m = M.lasso(d, terms, "label", "fold")
    return d.select("o_orderkey", F.round(m.probability(), 6).alias("p"), F.lit(m.lam).alias("lambda"))


@query("ml18_kmeans_table")
def kmeans_table(t):
    rows = M.kmeans_table(t("part").select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_size", "p_retailprice"], range(1, 11), 3)
    return t("part").sparkSession.createDataFrame(rows, "k int, sse double, r2 double, semi_partial_r2 double, bic double")


@query("ml18_total", "select round(sum(pow(p_size - s, 2) + pow(p_retailprice - r, 2)), 3) as sse from part, (select avg(p_size) as s, avg(p_retailprice) as r from part)")
def total(t):
    rows = M.kmeans_table(t("part").select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_size", "p_retailprice"], range(1, 2), 1)
    return t("part").sparkSession.createDataFrame([(round(rows[0][1], 3),)], "sse double")


@query("ml19_factors")
def factors(t):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    load = M.factors(t("lineitem"), names, 2)
    return t("nation").sparkSession.createDataFrame([(n, float(a), float(b)) for n, (a, b) in zip(names, load, strict=True)], "name string, factor1 double, factor2 double")
