"""Queries of customer analytics: rollups, grids, cutoffs, survival, reliability, correlations, scaling, models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.operators import ranking as R
from lodestrata.operators import stats as S
from lodestrata.plans.registry import query


def families(t):
    o = t("orders").groupBy(F.col("o_custkey").alias("family")).agg(F.avg(F.col("o_totalprice") / 500_000).alias("p"), F.count("*").alias("members"), F.sum("o_totalprice").alias("revenue"))
    return o.withColumns({"value": F.col("p") * F.col("revenue"), "cost": F.col("members") * 100.0})


_FAM = "select o_custkey as family, avg(o_totalprice / 500000) as p, count(*) as members, sum(o_totalprice) as revenue, avg(o_totalprice / 500000) * sum(o_totalprice) as value, count(*) * 100.0 as cost from orders group by 1"


@query("agg5_families", f"select family, round(p, 6) as p, members, round(revenue, 2) as revenue, round(value, 2) as value, cost::double as cost from ({_FAM})")
def family_rollup(t):
    return families(t).select("family", F.round("p", 6).alias("p"), "members", F.round("revenue", 2).alias("revenue"), F.round("value", 2).alias("value"), "cost")


@query("ml17_joi16_grid", f"""with f as ({_FAM}), g as (select a.i as a, b.i as b from range(32) a(i), range(32) b(i)), s as (select a, b, value, cost, row_number() over (partition by a, b order by a * p * 100 + b * members desc, family) as r from f, g)
select a, b, count(*) as n, round(sum(value - cost), 2) as profit from s where r <= 20 group by 1, 2""")
def grid(t):
    """Best 20 families for each of 1,024 weightings. Weights are not negative, so among families of equal size only the
    20 first by p, or by key where p has no weight, can be among the best: the rest goes before the grid is joined.
    The grid has 1,024 rows whatever the data, and is broadcast."""
    spark = t("nation").sparkSession
    same = Window.partitionBy("members")
    able = families(t).withColumn("x", F.row_number().over(same.orderBy(F.desc("p"), "family"))).withColumn("y", F.row_number().over(same.orderBy("family"))).where("x <= 20 or y <= 20")
    g = F.broadcast(spark.range(1024).select((F.col("id") % 32).alias("a"), F.floor(F.col("id") / 32).alias("b")))
    s = able.crossJoin(g).withColumn("score", F.col("a") * F.col("p") * 100 + F.col("b") * F.col("members"))
    best = R.top_k(s, ["a", "b"], [F.desc("score"), F.col("family")], 20)
    return best.groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") - F.col("cost")), 2).alias("profit"))


@query("flt8_srt9_best_families", f"select family, round(0.6 * p + 0.4 * members, 6) as score from ({_FAM}) where members > 1 and p > 0.1 order by 0.6 * p + 0.4 * members desc, family limit 15")
def best_families(t):
    s = 0.6 * F.col("p") + 0.4 * F.col("members")
    return families(t).where("members > 1 and p > 0.1").orderBy(F.desc(s), "family").limit(15).select("family", F.round(s, 6).alias("score"))


@query("ml15_gain_curve", """with g as (select round(o_totalprice, -3) as score, count(*) as n, sum((o_orderstatus = 'F')::int) as good from orders group by 1)
select score, (sum(n) over (order by score desc))::bigint as n, (57 * sum(good) over (order by score desc) - 10 * (sum(n) over (order by score desc) - sum(good) over (order by score desc)))::double as gain from g""")
def gains(t):
    o = t("orders").select(F.round("o_totalprice", -3).alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("good"))
    return S.gain_curve(o, "score", "good", 57.0, -10.0)


@query("ml15_best_cutoff", """with g as (select round(o_totalprice, -3) as score, count(*) as n, sum((o_orderstatus = 'F')::int) as good from orders group by 1), c as (select score, 57 * sum(good) over w - 10 * (sum(n) over w - sum(good) over w) as gain from g window w as (order by score desc))
select score as cutoff, gain::double as gain from c order by gain desc, score limit 1""")
def cutoff(t):
    return gains(t).orderBy(F.desc("gain"), "score").limit(1).select(F.col("score").alias("cutoff"), "gain")


@query("fn36_fn37_costs", "select o_orderpriority, count(*) as n, (case when count(*) * 40 <= 60000 then count(*) * 200 else 300000 + 25 * (count(*) * 40 - 60000) end)::bigint as cost, round(sum(o_totalprice) - 10 * count(*), 2) as profit from orders group by 1")
def costs(t):
    n = F.count("*")
    return t("orders").groupBy("o_orderpriority").agg(n.alias("n"), S.tiered_cost(n * 40).alias("cost"), F.round(F.sum("o_totalprice") - 10 * n, 2).alias("profit"))


@query("agg28_performance", """with g as (select (o_totalprice > 150000)::int as p, (o_orderstatus = 'F')::int as y from orders)
select round(count(*) filter (p = 1 and y = 1) / count(*) filter (y = 1), 6) as sensitivity, round(count(*) filter (p = 0 and y = 0) / count(*) filter (y = 0), 6) as specificity, round(count(*) filter (p = y) / count(*), 6) as accuracy from g""")
def performance(t):
    p, y = F.col("o_totalprice") > 150_000, F.col("o_orderstatus") == "F"
    c = lambda x: F.count(F.when(x, 1))
    return t("orders").agg(F.round(F.try_divide(c(p & y), c(y)), 6).alias("sensitivity"), F.round(F.try_divide(c(~p & ~y), c(~y)), 6).alias("specificity"), F.round(F.try_divide(c(p == y), F.count("*")), 6).alias("accuracy"))


_LIFE = "select l_returnflag as plan, date_diff('day', o_orderdate, l_shipdate) as time, (l_linestatus = 'F')::int as event from lineitem join orders on o_orderkey = l_orderkey where l_shipdate > o_orderdate and date_diff('day', o_orderdate, l_shipdate) > 0"


@query("ml21_win10_kaplan_meier", f"""with l as ({_LIFE}), p as (select plan, time, count(*) as n, sum(event) as events from l group by 1, 2), r as (select plan, time, events, sum(n) over (partition by plan order by time desc) as at_risk from p),
s as (select *, max((at_risk = events)::int) over w as dead, sum(case when at_risk > events then ln((at_risk - events) / at_risk::double) else 0 end) over w as lg, sum(case when at_risk > events then events / (at_risk * (at_risk - events))::double else 0 end) over w as gr from r window w as (partition by plan order by time))
select plan, time::int as time, at_risk::bigint as at_risk, events::bigint as events, round(case when dead = 1 then 0 else exp(lg) end, 9) as survival, round(case when dead = 1 then 0 else exp(lg) * exp(lg) * gr end, 9) as variance from s""")
def kaplan_meier(t):
    j = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    life = j.select(F.col("l_returnflag").alias("plan"), F.date_diff("l_shipdate", "o_orderdate").alias("time"), (F.col("l_linestatus") == "F").cast("int").alias("event")).where("time > 0")
    return S.kaplan_meier(life, "time", "event", ["plan"]).withColumns({"survival": F.round("survival", 9), "variance": F.round("variance", 9)})


@query("agg26_cronbach", "select l_returnflag, round(1.5 * (1 - (var_samp(l_quantity) + var_samp(l_discount) + var_samp(l_tax)) / var_samp(l_quantity + l_discount + l_tax)), 6) as alpha from lineitem group by 1")
def alpha(t):
    return S.cronbach(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"]).withColumn("alpha", F.round("alpha", 6))


@query("ml1_ml2_spearman", """with g as (select s_nationkey, l_suppkey, sum(l_quantity) as q, sum(l_extendedprice) as e from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2),
r as (select s_nationkey, rank() over (partition by s_nationkey order by q) + (count(*) over (partition by s_nationkey, q) - 1) / 2 as a, rank() over (partition by s_nationkey order by e) + (count(*) over (partition by s_nationkey, e) - 1) / 2 as b from g)
select s_nationkey, case when count(*) > 1 then round(corr(a, b), 6) + 0.0::double end as rho, count(*) as n from r group by 1""")
def spearman(t):
    g = t("lineitem").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy("s_nationkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("e"))
    return R.spearman(g, "q", "e", ["s_nationkey"]).withColumn("rho", F.round("rho", 6) + F.lit(0.0))


@query("prj13_min_max", "select p_partkey, round((p_size - min(p_size) over (partition by p_brand)) / (max(p_size) over (partition by p_brand) - min(p_size) over (partition by p_brand))::double, 6) as p_size from part qualify max(p_size) over (partition by p_brand) > min(p_size) over (partition by p_brand)")
def min_max(t):
    w = Window.partitionBy("p_brand")
    p = t("part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("p_size")).withColumn("v", F.max("p_size").over(w) > F.min("p_size").over(w))
    return S.min_max(p, ["p_size"], ["p_brand"]).where("v").select("p_partkey", F.round("p_size", 6).alias("p_size"))


@query("prj14_z_scores", "select p_partkey, round((p_retailprice - avg(p_retailprice) over (partition by p_brand)) / stddev_samp(p_retailprice) over (partition by p_brand), 6) as z from part")
def z_scores(t):
    return S.z_scores(t("part"), ["p_retailprice"], ["p_brand"]).select("p_partkey", F.round("p_retailprice", 6).alias("z"))


@query("prj15_design_matrix", "select p_partkey, round(p_size * p_retailprice, 4) as x, p_size * p_size as s2, round(p_retailprice * p_retailprice, 2) as r2 from part")
def design(t):
    return t("part").select("p_partkey", F.round(F.col("p_size") * F.col("p_retailprice"), 4).alias("x"), (F.col("p_size") * F.col("p_size")).alias("s2"), F.round(F.col("p_retailprice") * F.col("p_retailprice"), 2).alias("r2"))


def _parts(t):
    from pyspark.ml.feature import VectorAssembler

    p = t("part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", (F.col("p_size") > 25).cast("double").alias("label"))
    return VectorAssembler(inputCols=["p_size", "p_retailprice"], outputCol="features").transform(p)


@query("ml18_kmeans")
def kmeans(t):
    """Clusters for k = 2..5 with their sum of squares; the models are fitted one after another, each distributed."""
    from pyspark.ml.clustering import KMeans

    data = _parts(t)
    rows = [(k, float(KMeans(k=k, seed=42, maxIter=20).fit(data).summary.trainingCost)) for k in range(2, 6)]
    return data.sparkSession.createDataFrame(rows, "k int, sse double")


@query("ml11_ml14_logistic")
def logistic(t):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    m = LogisticRegression(regParam=0.01, elasticNetParam=1.0, maxIter=30).fit(_parts(t))
    return m.transform(_parts(t)).select("p_partkey", F.round(F.get(vector_to_array("probability"), F.lit(1)), 6).alias("p"), "prediction")


@query("ml7_ml8_forest")
def forest(t):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(numTrees=20, maxDepth=5, seed=42).fit(_parts(t)).transform(_parts(t)).select("p_partkey", "prediction")


@query("ml6_svm")
def svm(t):
    from pyspark.ml.classification import LinearSVC

    return LinearSVC(maxIter=20, regParam=0.1).fit(_parts(t)).transform(_parts(t)).select("p_partkey", "prediction")


@query("ml20_multinomial")
def multinomial(t):
    from pyspark.ml.classification import LogisticRegression

    d = _parts(t).withColumn("label", (F.col("p_partkey") % 3).cast("double"))
    return LogisticRegression(family="multinomial", maxIter=20).fit(d).transform(d).select("p_partkey", "prediction")


@query("ml5_word2vec")
def word2vec(t):
    """Mean vector over the words of a text that are in the vocabulary."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    d = t("benchmark").select("item_id", F.split("text", " ").alias("words"))
    m = Word2Vec(vectorSize=16, windowSize=5, minCount=2, seed=42, inputCol="words", outputCol="v").fit(d)
    v = m.getVectors().select("word", F.posexplode(vector_to_array("vector")).alias("k", "x"))
    return d.select("item_id", F.explode("words").alias("word")).join(v, "word").groupBy("item_id", "k").agg(F.round(F.avg("x"), 6).alias("x"))


@query("ml22_cox")
def cox(t):
    """Proportional hazards (Breslow ties) on one covariate: risk sets are aggregates of distinct times; Newton steps on the driver."""
    import numpy as np

    j = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    life = j.select((F.col("l_discount") > 0.05).cast("int").alias("x"), F.date_diff("l_shipdate", "o_orderdate").alias("time"), (F.col("l_linestatus") == "F").cast("int").alias("event")).where("time > 0")
    per = life.groupBy("time").agg(F.count(F.when(F.col("x") == 0, 1)).alias("n0"), F.count(F.when(F.col("x") == 1, 1)).alias("n1"), F.sum("event").alias("d"), F.sum(F.col("event") * F.col("x")).alias("dx"))
    rows = np.array(per.orderBy(F.desc("time")).collect(), dtype=float)  # one row a day of follow-up
    beta = se = 0.0
    if len(rows):
        r0, r1 = rows[:, 1].cumsum(), rows[:, 2].cumsum()
        for _ in range(25):
            p = r1 * np.exp(beta) / (r0 + r1 * np.exp(beta))
            info = (rows[:, 3] * p * (1 - p)).sum()
            if info <= 0:
                break
            beta += (rows[:, 4] - rows[:, 3] * p).sum() / info
            se = 1 / np.sqrt(info)
    return life.sparkSession.createDataFrame([(float(beta), float(se))], "beta double, se double")
