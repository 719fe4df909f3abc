"""Queries that read facts out of the lines of pages. The pages are built out of orders, and the SQL says from the same columns what
must come out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions import documents as D
from lodestrata.functions import extraction as E
from lodestrata.functions import parsing as P
from lodestrata.functions import text as T
from lodestrata.operators import graph as G
from lodestrata.operators import models as M
from lodestrata.plans import graphs
from lodestrata.plans.registry import query

def K() -> Column:
    return F.col("o_orderkey")


def text(*lines) -> Column:
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


def num(x: Column) -> Column:
    return x.cast("string")


@query("fn15_amounts", """select o_orderkey, case when o_orderkey % 3 <> 0 then format('{:,}', (o_orderkey % 900 + 1) * 1000000 + 500000) end as total_cost, case when o_orderkey % 2 = 0 then '7,250,000' end as financing,
format('{:,}', (o_orderkey % 50) * 1000000 + 250000) as third from orders""")
def amounts(t):
    first = F.when(K() % 3 != 0, F.concat(F.lit("Total Operation Cost   "), num(K() % 900 + 1), F.lit(".50"))).otherwise("Total Operation Cost unknown")
    page = text(first, F.when(K() % 2 == 0, "Total Financing 7.25").otherwise("Financing 7.25"), F.concat(F.lit("Borrower: 1.00 2,000.50 "), num(K() % 50), F.lit(".25")), "Borrower: 9.00 9.00 9.00")
    return t("orders").select("o_orderkey", E.amount(page, "total_cost").alias("total_cost"), E.amount(page, "financing").alias("financing"), E.third_amount(page, "Borrower").alias("third"))


@query("fn16_labelled_lines", """select o_orderkey, case when o_orderkey % 4 <> 0 then 'Project ' || o_orderkey end as name, case when o_orderkey % 4 <> 0 then 'Land ' || (o_orderkey % 5) end as country, case when o_orderkey % 4 <> 0 then 'Loan' end as instrument,
case when o_orderkey % 3 = 0 then 'actual' else 'original' end as closing_kind from orders""")
def labelled(t):
    block = F.when(K() % 4 != 0, text("Project ID", F.concat(F.lit(" P"), num(K())), "", F.concat(F.lit("Project "), num(K())), "Country", "Financing Instrument", F.concat(F.lit("Land "), num(K() % 5)), "Loan")).otherwise("nothing here")
    page = text(block, "Original Closing", "original", F.when(K() % 3 == 0, text("Actual Closing", "actual")).otherwise("x"))
    lines = E.lines_of(F.col("page"))
    got = t("orders").withColumn("page", page).withColumn("lines", lines)
    after = lambda label, skip=1: E.after_label(F.col("lines"), label, skip)
    closing = F.coalesce(after("Actual Closing"), after("Original Closing"))
    return got.select("o_orderkey", after("Project ID", 2).alias("name"), after("Financing Instrument").alias("country"), after("Financing Instrument", 2).alias("instrument"), closing.alias("closing_kind"))


@query("fn16_key_dates", """select o_orderkey, label, case when label = 'Closing' and o_orderkey % 3 = 0 then null else strftime(o_orderdate, '%Y-%m-%d') end as day from orders, (values ('Approval'), ('Closing')) v(label)""")
def key_dates(t):
    day = F.date_format("o_orderdate", "d-MMM-yyyy")
    page = text("Key dates", "Approval", "Closing", day, F.when(K() % 3 != 0, day).otherwise("-"))
    got = t("orders").withColumn("lines", E.lines_of(page))
    return got.select("o_orderkey", F.explode(E.dates_of(F.col("lines"), ["Approval", "Closing"])).alias("label", "day"))


@query("fn17_header", "select o_orderkey, case when o_orderkey % 2 = 0 then 'East Asia' else 'Africa' end as region, case when o_orderkey % 3 <> 0 then 'Water' end as practice from orders")
def header(t):
    line = F.concat(F.when(K() % 2 == 0, " EAST ASIA ").otherwise("AFRICA"), F.when(K() % 3 != 0, "| Water ").otherwise(""))
    return t("orders").select("o_orderkey", E.header(line).alias("h")).select("o_orderkey", "h.region", "h.practice")


@query("fn18_objective", """select o_orderkey, case when o_orderkey % 4 = 0 then null else 'To reach ' || o_orderkey || ' ' || rtrim(repeat('more people ', 40)) end as objective, case when o_orderkey % 4 <> 0 then ('To reach ' || o_orderkey || ' ' || repeat('more people ', 40))[1:300] end as quote from orders""")
def objective(t):
    page = text("Intro", F.when(K() % 4 != 0, "Original PDO").otherwise("Other PDO"), F.concat(F.lit("  To reach "), num(K()), F.lit(" ")), F.repeat(F.lit("more people "), 40), "Revised PDO", "end")
    got = E.between(page, "original pdo", "revised pdo")
    return t("orders").select("o_orderkey", got.alias("objective"), F.substring(got, 1, 300).alias("quote"))


@query("fn19_fn21_ratings", """select o_orderkey, label, case when label = 'Risk' then case when o_orderkey % 5 <> 0 then 'Low' end when o_orderkey % 3 = 0 then 'Satisfactory' when o_orderkey % 3 = 1 then 'Moderate' end as rating from orders, (values ('Progress'), ('Risk')) v(label)""")
def ratings(t):
    page = text("Progress", F.when(K() % 3 == 0, text("• Modest", "■  Satisfactory ")).when(K() % 3 == 1, "• Moderate").otherwise("Risk"), "Risk", F.when(K() % 5 != 0, "▪ Low").otherwise(""))
    lines = F.when(K() % 3 == 2, F.array(F.lit("Progress"), *([F.lit("Risk")]), F.when(K() % 5 != 0, "▪ Low").otherwise("Progress"))).otherwise(E.lines_of(page))
    got = t("orders").withColumn("lines", lines)
    one = lambda label: F.struct(F.lit(label).alias("label"), E.rating_of(F.col("lines"), label, ["Progress", "Risk"]).alias("rating"))
    return got.select("o_orderkey", F.inline(F.array(one("Progress"), one("Risk"))))


@query("fn20_indicator_blocks", """select o_orderkey, 'People reached' as name, 'Number' as unit, (o_orderkey % 100)::double as baseline, 1200.5::double as achieved, 3000.0::double as target from orders where o_orderkey % 3 <> 0
union all select o_orderkey, 'Roads', 'Kilometer', 0.0, 2.0, (o_orderkey % 7)::double from orders""")
def indicator_blocks(t):
    one = F.when(K() % 3 != 0, F.concat(F.lit("People reached (Number, Core)\nBaseline Actual Target\nValue "), num(K() % 100), F.lit(" 7 1,200.5 3,000\nDate 1-Jan-2020 1-Jan-2021 1-Jan-2022 1-Jan-2023"))).otherwise("People reached (Number)\nValue 1 2")
    page = F.concat(F.lit("Results\n• "), one, F.lit("\n■ Roads (Kilometer, Custom)\nValue 0 1 2 "), num(K() % 7), F.lit("\nend"))
    got = t("orders").select("o_orderkey", F.explode(E.indicators(page)).alias("x"))
    return got.select("o_orderkey", "x.name", "x.unit", "x.baseline", "x.achieved", "x.target")


@query("fn30_without_urls", "select o_orderkey, 'see größe ' || o_orderkey || ' _ok' as t from orders")
def without_urls(t):
    raw = F.concat(F.lit("  SEE http://x.y/z?q=1 GRÖßE, "), num(K()), F.lit("!  www.a.b (_ok) "))
    return t("orders").select("o_orderkey", T.without_urls(raw).alias("t"))


@query("prj3_first_of", "select o_orderkey, case o_orderkey % 3 when 0 then 'a' when 1 then 'plain' end as x from orders")
def first_of(t):
    raw = F.when(K() % 3 == 0, '["a","b"]').when(K() % 3 == 1, "plain").otherwise("[]")
    return t("orders").select("o_orderkey", P.first_of(raw).alias("x"))


@query("prj4_shape", "select o_custkey as customer, o_orderkey as id, 'v1' as version from orders")
def shape(t):
    return t("orders").withColumn("version", F.lit("v1")).withColumnsRenamed({"o_orderkey": "id", "o_custkey": "customer"}).drop("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority").select("customer", "id", "version")


@query("prj6_row_means", "select p_partkey, case when p_size % 3 <> 0 then round((p_size + p_retailprice + p_partkey) / 3, 6) end as mean from part")
def row_means(t):
    items = [F.when(F.col("p_size") % 3 != 0, F.col("p_size")), F.col("p_retailprice"), F.col("p_partkey")]
    return t("part").select("p_partkey", F.round((items[0] + items[1] + items[2]) / 3, 6).alias("mean"))


@query("prj15_expanded", "select p_partkey, p_size::double as a, p_retailprice as b, (p_size * p_size)::double as aa, round(p_size * p_retailprice, 4) as ab, round(p_retailprice * p_retailprice, 4) as bb from part")
def expanded(t):
    d, terms = M.expanded(t("part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b")), ["a", "b"])
    names = [c for c in terms if ":" in c]
    return d.select("p_partkey", "a", "b", *[(F.round(F.col(f"`{c}`"), 4) if "b" in c else F.col(f"`{c}`")).alias(c.replace(":", "")) for c in names])


@query("agg20_all_folds", f"select least(src, dst) as src, greatest(src, dst) as dst, round(sum(w), 4) as total, round(avg(w), 4) as mean, round(max(w), 4) as most from (select src, dst, sum(w) as w from ({graphs._TRADE}) group by 1, 2) group by 1, 2")
def all_folds(t):
    arcs = graphs.trade(t).groupBy("src", "dst").agg(F.sum("w").alias("cond"))
    out = None
    for how, name in (("sum", "total"), ("avg", "mean"), ("max", "most")):
        one = G.symmetrized(arcs, how).select("src", "dst", F.round("cond", 4).alias(name))
        out = one if out is None else out.join(one, ["src", "dst"])
    return out


@query("agg6_several", "select p_brand, count(*) as n, round(avg(p_size), 6) as mean_size, round(median(p_size), 6) as median_size, round(avg(p_retailprice), 6) as mean_price, round(median(p_retailprice), 6) as median_price, round(stddev_samp(p_retailprice), 6) as sd_price from part group by 1")
def several(t):
    r = lambda x, n: F.round(x, 6).alias(n)
    return t("part").groupBy("p_brand").agg(F.count("*").alias("n"), r(F.avg("p_size"), "mean_size"), r(F.median("p_size"), "median_size"), r(F.avg("p_retailprice"), "mean_price"), r(F.median("p_retailprice"), "median_price"), r(F.stddev_samp("p_retailprice"), "sd_price"))


@query("agg22_grounding", "select user_id % 20 as project, count(*) as citations, count(*) filter (value > 50) as supported, round(count(*) filter (value > 50) / count(*)::double, 9) as rate, count(distinct user_id) as docs, count(distinct event_type) as chunks from events group by 1")
def grounding(t):
    yes = F.count(F.when(F.col("value") > 50, 1))
    return t("events").groupBy((F.col("user_id") % 20).alias("project")).agg(F.count("*").alias("citations"), yes.alias("supported"), F.round(F.try_divide(yes, F.count("*")), 9).alias("rate"), F.countDistinct("user_id").alias("docs"), F.countDistinct("event_type").alias("chunks"))


@query("agg23_completeness", """select o_custkey, count(*) filter (o_orderstatus = 'F') as errors, count(*) filter (o_orderstatus = 'O') as warnings, sum(o_orderkey % 4)::bigint as insufficient from orders group by 1""")
def completeness(t):
    js = F.when(K() % 4 == 0, "{}").otherwise(F.to_json(F.struct(F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (K() % 4).cast("int")).alias("insufficient_evidence"))))
    said = F.coalesce(F.size(F.from_json(F.get_json_object(js, "$.insufficient_evidence"), "array<string>")), F.lit(0))
    said = F.when(said < 0, 0).otherwise(said)
    count = lambda s, n: F.count(F.when(F.col("o_orderstatus") == s, 1)).alias(n)
    return t("orders").groupBy("o_custkey").agg(count("F", "errors"), count("O", "warnings"), F.sum(said).alias("insufficient"))


@query("agg28_profit_table", """with g as (select (o_totalprice > 150000)::int as p, (o_orderstatus = 'F')::int as y from orders), c as (select sum(p * y) as tp, sum(p * (1 - y)) as fp, sum((1 - p) * y) as fn, sum((1 - p) * (1 - y)) as tn from g)
select cell, n::bigint as n, (n * gain)::bigint as profit from c, lateral (values ('tp', tp, 60), ('fp', fp, -5), ('fn', fn, -10), ('tn', tn, 0)) v(cell, n, gain)""")
def profit_table(t):
    p, y = F.col("o_totalprice") > 150_000, F.col("o_orderstatus") == "F"
    cells = {"tp": (p & y, 60), "fp": (p & ~y, -5), "fn": (~p & y, -10), "tn": (~p & ~y, 0)}
    c = t("orders").agg(*[F.count(F.when(when, 1)).alias(n) for n, (when, _) in cells.items()])
    return c.select(F.inline(F.array(*[F.struct(F.lit(n).alias("cell"), F.col(n).alias("n"), (F.col(n) * gain).alias("profit")) for n, (_, gain) in cells.items()])))


@query("set1_relaxed", "select c_custkey::double as key, c_name as name from customer union all select s_acctbal, null from supplier")
def relaxed(t):
    """Union by name where a type widens and a column is missing on one side."""
    a = t("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return a.select(F.col("key").cast("double").alias("key"), "name").unionByName(t("supplier").select(F.col("s_acctbal").alias("key")), allowMissingColumns=True)


@query("srt2_all_terms", """select doc_id, round(10 * (contains(lower(text), 'token'))::int + contains(lower(text), 'the')::int + contains(lower(text), 'with')::int + case when contains(text, doc_id::varchar) then 2 else 0 end + regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(target)([^A-Za-z0-9_]|$)')::int, 0)::int as score from documents
where 10 * (contains(lower(text), 'token'))::int + contains(lower(text), 'the')::int + contains(lower(text), 'with')::int + case when contains(text, doc_id::varchar) then 2 else 0 end + regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(target)([^A-Za-z0-9_]|$)')::int > 0 order by score desc, doc_id limit 30""")
def all_terms(t):
    x = F.col("text")
    ident = F.when(F.contains(x, F.col("doc_id").cast("string")), 2).otherwise(0)
    score = 10 * T.keyword_score(x, ["token"]) + T.keyword_score(x, ["the", "with"]) + ident + T.hints(x, ["target"])
    return t("documents").select("doc_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(30)


@query("fn5_quota_by_k", """with s as (select o_orderkey, o_orderkey % 25 as project, (['ICR', 'PAD', 'ISR', 'OTHER'])[(o_orderkey // 25) % 4 + 1] as cls, o_totalprice as score from orders), m as (select *, row_number() over (partition by project, cls order by score desc, o_orderkey) <= case cls when 'ICR' then 10 // 3 when 'PAD' then 10 // 5 else 0 end as must_include from s),
r as (select *, row_number() over (partition by project order by must_include desc, score desc, o_orderkey)::int as rank from m) select project, o_orderkey, must_include, rank from r where rank <= 10""")
def quota_by_k(t):
    from lodestrata.operators import ranking as R

    k = 10
    rows = t("orders").select("o_orderkey", (K() % 25).alias("project"), F.element_at(F.array(*[F.lit(c) for c in ("ICR", "PAD", "ISR", "OTHER")]), (F.floor(K() / 25) % 4 + 1).cast("int")).alias("cls"), F.col("o_totalprice").alias("score"))
    return R.quota_top_k(rows, "project", "cls", {"ICR": k // 3, "PAD": k // 5}, [F.desc("score"), F.col("o_orderkey")], k).select("project", "o_orderkey", "must_include", "rank")
