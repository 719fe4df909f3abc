"""Queries over a trade graph of nations, built from line items: supplier nation to customer nation by priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import graph as G
from lodestrata.plans.registry import query

_TRADE = """select s_nationkey as src, c_nationkey as dst, o_orderpriority as industry, sum(l_quantity) as w from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey group by 1, 2, 3"""
_EDGES = f"select least(src, dst) as src, greatest(src, dst) as dst, sum(w) as cond from ({_TRADE}) where src <> dst and w > 20 group by 1, 2 having sum(w) > 20"


def trade(t):
    j = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return j.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"), F.col("o_orderpriority").alias("industry")).agg(F.sum("l_quantity").alias("w"))


def edges(t):
    return G.undirected(trade(t), "src", "dst", "w", 20.0)


@query("gr1_agg19_edges", f"select src, dst, round(cond, 4) as cond, round(1 / (cond + 1e-9), 9) as cost from ({_EDGES})")
def edge_list(t):
    return edges(t).select("src", "dst", F.round("cond", 4).alias("cond"), F.round("cost", 9).alias("cost"))


@query("joi11_flow_shares", f"""with t as ({_TRADE}), x as (select industry, src, sum(w) as e from t group by 1, 2), m as (select industry, dst, sum(w) as i from t group by 1, 2), a as (select industry, sum(w) as total from t group by 1)
select x.industry, src, dst, round(total * (e / total) * (i / total), 4) as w from x join m using (industry) join a using (industry)""")
def shares(t):
    """Export and import sides meet within an industry: at most nations squared rows each, after aggregation."""
    f = trade(t)
    x = f.groupBy("industry", "src").agg(F.sum("w").alias("e"))
    m = f.groupBy("industry", "dst").agg(F.sum("w").alias("i"))
    a = f.groupBy("industry").agg(F.sum("w").alias("total"))
    return x.join(m, "industry").join(a, "industry").select("industry", "src", "dst", F.round(F.col("total") * (F.col("e") / F.col("total")) * (F.col("i") / F.col("total")), 4).alias("w"))


@query("agg20_symmetrized", f"select least(src, dst) as src, greatest(src, dst) as dst, round(avg(w), 4) as cond from (select src, dst, sum(w) as w from ({_TRADE}) group by 1, 2) group by 1, 2")
def symmetrized(t):
    arcs = trade(t).groupBy("src", "dst").agg(F.sum("w").alias("cond"))
    return G.symmetrized(arcs, "avg").withColumn("cond", F.round("cond", 4))


@query("gr2_agg21_completed", f"select round(median(1 / (cond + 1e-9)), 9) as med, round(10 * median(1 / (cond + 1e-9)) * 25, 6) as penalty from ({_EDGES})")
def completed(t):
    m = F.median("cost")
    return G.completed(edges(t).withColumn("cost", F.lit(None).cast("double"))).agg(F.round(m, 9).alias("med"), F.round(10 * m * 25, 6).alias("penalty"))


@query("gr5_degrees", f"with e as ({_EDGES}) select node, count(*) as degree, round(sum(cond), 4) as strength from (select src as node, cond from e union all select dst, cond from e) group by 1")
def degrees(t):
    return G.degrees(edges(t)).withColumn("strength", F.round("strength", 4))


_STRONG = f"select * from ({_EDGES}) where (src * 7 + dst * 3) % 11 < 2"
_WALK = f"with recursive e as ({_STRONG}), b as (select src, dst from e union all select dst, src from e), w(node, reach) as (select distinct src, src from b union select w.node, b.dst from w join b on b.src = w.reach), c as (select node, min(reach) as component from w group by 1)"


def strong(t):
    return edges(t).where("(src * 7 + dst * 3) % 11 < 2")


@query("gr3_gr4_components", f"{_WALK}, s as (select component, count(*) as n from c group by 1) select sum(n)::bigint as nodes, count(*) as parts, round(sum(n * (n - 1) / 2) / (sum(n) * (sum(n) - 1) / 2)::double, 9) as pair_fraction from s")
def components(t):
    n = G.component_labels(strong(t)).groupBy("component").agg(F.count("*").alias("n"))
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2) / (F.sum("n") * (F.sum("n") - 1) / 2)
    return n.agg(F.sum("n").alias("nodes"), F.count("*").alias("parts"), F.round(pairs, 9).alias("pair_fraction"))


@query("gr3_component_labels", f"{_WALK} select node, component from c")
def labels(t):
    return G.component_labels(strong(t))


@query("gr20_random_k", f"with e as ({_EDGES}) select node from (select src as node from e union select dst from e) order by md5('5:' || node), node limit 6")
def random_k(t):
    return G.removal_nodes(edges(t), "random_k", 6, 5)


@query("gr20_top_conductance", f"with e as ({_EDGES}) select node from (select src as node, cond from e union all select dst, cond from e) group by 1 order by sum(cond) desc, node limit 5")
def top_conductance(t):
    return G.removal_nodes(edges(t), "top_cond_degree_k", 5)


@query("gr20_removal_candidates", f"with e as ({_EDGES}) select node from (select src as node, cond from e union all select dst, cond from e) group by 1 order by count(*) desc, sum(cond) desc, node limit 5")
def removal_candidates(t):
    return G.degrees(edges(t)).orderBy(F.desc("degree"), F.desc("strength"), "node").limit(5).select("node")


@query("gr6_gr15_gr19_node_metrics")
def metrics(t):
    return G.node_metrics(edges(t))


@query("gr16_gr17_gr18_removal_impact")
def impact(t):
    return G.removal_impact(edges(t), G.degrees(edges(t)))


_RING = """with recursive e as (select n_nationkey as src, n_nationkey + 1 as dst, 1.0 + n_nationkey % 3 as cost from nation where n_nationkey < 6 union all select 0, 6, 4.0 union all select 10, 11, 2.0), b as (select src, dst, cost from e union all select dst, src, cost from e),
w(node, pos, d, path) as (select distinct src, src, 0.0::double, [src] from b union all select w.node, b.dst, w.d + b.cost, list_append(path, b.dst) from w join b on b.src = w.pos where not list_contains(path, b.dst)), s as (select node, pos, min(d) as d from w where node <> pos group by 1, 2)"""


def ring(t):
    """A ring of nodes 0 to 6 and, apart from it, an edge from 10 to 11: the SQL can walk all of its paths."""
    k = F.col("n_nationkey")
    base = t("nation").where(k < 6).select(k.alias("src"), (k + 1).alias("dst"), (1.0 + k % 3).alias("cost"))
    more = t("nation").where(k.isin(0, 1)).select((k * 10).alias("src"), F.when(k == 0, 6).otherwise(11).alias("dst"), F.when(k == 0, 4.0).otherwise(2.0).alias("cost"))
    return base.unionByName(more).withColumn("cond", 1 / F.col("cost"))


@query("gr10_gr11_gr12_efficiency", _RING + " select round(sum(1 / d) / (9 * 8), 9) as efficiency, round(avg(d), 9) as aspl from s")
def efficiency(t):
    return G.efficiency(ring(t)).select(F.round("efficiency", 9).alias("efficiency"), F.round("aspl", 9).alias("aspl"))


# On a ring the resistance of two nodes is that of both ways in parallel; between components it is ten median costs times the nodes.
_RESIST = """e as (select n_nationkey as src, 1.0 + n_nationkey % 3 as cost from nation where n_nationkey < 6 union all select 6, 4.0), n as (select src as v, coalesce(sum(cost) over (order by src rows between unbounded preceding and 1 preceding), 0) as pos, sum(cost) over () as total from e),
p as (select a.v as src, b.v as dst, (b.pos - a.pos) * (a.total - (b.pos - a.pos)) / a.total as resistance from n a join n b on a.v < b.v union all select 10, 11, 2.0 union all select v, x, 10 * (select median(cost) from (select cost from e union all select 2.0)) * 9 from n, (values (10), (11)) t(x))"""


@query("gr13_gr14_resistance", f"with {_RESIST} select src, dst, round(resistance, 6) as resistance from p")
def resistance(t):
    return G.resistances(ring(t)).withColumn("resistance", F.round("resistance", 6))


@query("gr14_current_flow", f"with {_RESIST}, b as (select src, dst, resistance from p union all select dst, src, resistance from p) select src as node, round(1 / sum(resistance), 9) as cf_closeness from b group by 1")
def current_flow(t):
    p = G.resistances(ring(t))
    both = p.unionByName(p.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "resistance"))
    return both.groupBy(F.col("src").alias("node")).agg(F.round(1 / F.sum("resistance"), 9).alias("cf_closeness"))


@query("gr16_resk", "select unnest([0, 1, 2, 3, 4, 5, 6]) as node, true as positive")
def resk(t):
    """Without a node of the ring the rest is a path, so every resistance rises or is that of a penalty."""
    impact = G.removal_impact(ring(t), G.removal_nodes(ring(t)))
    return impact.where("node < 10").select("node", (F.col("resk") != 0).alias("positive"))


@query("gr9_sampled_betweenness")
def sampled_betweenness(t):
    e = edges(t)
    nodes = [r.node for r in G.removal_nodes(e, "random_k", 8).collect()]
    return G.node_metrics(e, nodes).select("node", "betweenness")


@query("ml3_evaluation")
def evaluation(t):
    """Rank correlation of each metric with what a removal costs in efficiency."""
    from lodestrata.operators import ranking as R

    m = metrics(t).join(impact(t).select("node", "delta_eff"), "node")
    long = m.unpivot(["node", "delta_eff"], [F.col("degree").cast("double").alias("degree"), "strength", "betweenness", "eigenvector", "cf_closeness"], "metric", "value")
    return R.spearman(long, "value", "delta_eff", ["metric"]).orderBy(F.desc_nulls_last("rho"))
