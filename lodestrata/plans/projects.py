"""Queries over records of projects and documents. The texts that they read are built out of orders, customers and parts, so
that every class, fallback and odd value occurs, and the SQL says from the same columns what must come out."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lodestrata.functions import documents as D
from lodestrata.functions import text as T
from lodestrata.operators import ranking as R
from lodestrata.operators import records as X
from lodestrata.operators import stats as S
from lodestrata.plans.registry import query

TITLES = ["Implementation Completion and Results Report for a project", "final ICR", "Project Appraisal Document", "the PAD; annex", "Implementation Status and Results Report 7", "ISR no 3", "Results Framework and Monitoring", "logframe", "Restructuring of the loan", "padded bisrat", "Annual report", "", "working notes"]
_CLASS_OF = ["ICR", "ICR", "PAD", "PAD", "ISR", "ISR", "RESULTS_FRAMEWORK", "RESULTS_FRAMEWORK", "RESTRUCTURING", "OTHER", "OTHER", "OTHER", "OTHER"]
_WORDS_OF = [1.5, 0, 1.0, 0, 0.5, 0, 0, 0, 0, 0, 0.5, 0, 0]
KINDS = ["Working Paper", "ICR review", None, "Letter", ""]
MAJORS = ["Publications & Research", "Board Documents", None]


def pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def _list(values: list) -> str:
    return "[" + ", ".join("null" if v is None else repr(v) for v in values) + "]"


def _pick(values: list, at: str) -> str:
    return f"({_list(values)})[({at}) % {len(values)} + 1]"


_K = "o_orderkey"
_CLASS = f"case when {_K} % 5 = 1 then 'ICR' else {_pick(_CLASS_OF, _K)} end"
_POINTS = f"case {_CLASS} when 'ICR' then 20 when 'PAD' then 15 when 'ISR' then 12 when 'RESULTS_FRAMEWORK' then 14 when 'RESTRUCTURING' then 10 else 1 end"
_DOC_SCORE = f"(case when {_K} % 2 = 0 then 5 else 0 end + case when {_K} % 4 = 1 then 3 else 0 end + {_POINTS} - case when {_K} % 3 = 0 then 10 else 0 end - case when {_K} % 5 = 0 then 10 else 0 end + {_pick(_WORDS_OF, _K)})::double"


def _titled(t):
    k = F.col("o_orderkey")
    return t("orders").select("*", pick(TITLES, k).alias("title"), pick(KINDS, k).alias("kind"), pick(MAJORS, k).alias("major"))


@query("fn4_fn5_document_class", f"select o_orderkey, {_CLASS} as cls, {_DOC_SCORE} as score from orders")
def document_class(t):
    cls = D.document_class(F.col("title"), F.col("kind"), F.col("major"))
    d = _titled(t).withColumn("cls", cls)
    return d.select("o_orderkey", "cls", D.document_score(F.col("cls"), F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 4 == 1, F.col("title"), F.col("kind"), F.col("major")).alias("score"))


@query("fn7_section_words", "select o_orderkey, (o_orderkey % 2 = 0)::int + (o_orderkey % 3 = 0)::int + (o_orderkey % 5 = 0)::int + (o_orderkey % 7 = 0)::int as hints from orders")
def section_words(t):
    k = F.col("o_orderkey")
    text = F.concat(*[F.when(k % n == 0, f"The {w.title() if n == 3 else w}. ").otherwise(f"{w}s pre{w} ") for n, w in zip((2, 3, 5, 7), ("results", "indicator", "baseline", "target"), strict=True)])
    return t("orders").select("o_orderkey", T.hints(text, D.SECTIONS).alias("hints"))


def _project_payloads(t):
    k = F.col("o_orderkey")
    text = k.cast("string")
    d = F.col("o_orderdate")
    at = F.when(k % 3 == 0, F.date_format(d, "yyyy-MM-dd'T'00:00:00'Z'")).when(k % 3 == 1, F.date_format(d, "M/d/yyyy '12:00:00 AM'")).otherwise("later")
    fields = {
        "id": F.when(k % 11 == 0, "  ").when(k % 11 != 1, F.concat(F.lit(" P"), text)), "project_name": F.when(k % 2 == 0, F.concat(F.lit("Name "), text)).otherwise(""), "proj_title": F.concat(F.lit("Title "), text),
        "status": F.when(k % 3 == 0, F.col("o_orderstatus")), "projectstatusdisplay": F.lit("Shown"), "regionname": F.col("o_orderpriority"), "countrycode": F.array(F.concat(F.lit("C"), (k % 7).cast("string")), F.lit("ZZ")),
        "countryname": F.when(k % 4 != 0, "Land").otherwise(""), "countryshortname": F.lit("Short"), "approvalfy": F.date_format(d, "yyyy"), "boardapprovaldate": at, "closingdate": F.date_format(d, "yyyy-MM-dd"), "p2a_updated_date": F.lit("none"),
        "totalamt": F.when(k % 2 == 0, "0").otherwise(F.format_number("o_totalprice", 2)), "totalcommamt": F.when(k % 8 == 0, "N/A").otherwise("1,250.5"), "lendinginstr": F.lit("Loan"), "prodline": F.lit("PE"), "url": F.concat(F.lit("http://x/"), text),
    }
    return t("orders").select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("payload_json"), F.lit("2024-01-01").alias("ingested_at"), F.lit("v1").alias("dataset_version_id"))


@query("prj1_flt3_projects", """select 'P' || o_orderkey as project_id, case when o_orderkey % 2 = 0 then 'Name ' else 'Title ' end || o_orderkey as project_name, case when o_orderkey % 3 = 0 then o_orderstatus else 'Shown' end as status, o_orderpriority as regionname,
'C' || (o_orderkey % 7) as country_iso2, case when o_orderkey % 4 <> 0 then 'Land' else 'Short' end as country_name, strftime(o_orderdate, '%Y') as approval_fy, case when o_orderkey % 3 < 2 then strftime(o_orderdate, '%Y-%m-%dT00:00:00') end as board_approval_date,
strftime(o_orderdate, '%Y-%m-%dT00:00:00') as closing_date, case when o_orderkey % 2 = 1 then round(o_totalprice, 2) when o_orderkey % 8 <> 0 then 1250.5 end as total_commitment_usd, 'Loan' as lending_instrument, 'PE' as prodline, null::varchar as updated_at,
'http://x/' || o_orderkey as source_url, '2024-01-01' as ingested_at, 'v1' as dataset_version_id from orders where o_orderkey % 11 > 1""")
def projects(t):
    return X.projects(_project_payloads(t))


def _document_payloads(t):
    k = F.col("o_orderkey")
    text = k.cast("string")
    fields = {
        "id": F.when(k % 3 == 0, text), "repnb": F.when(k % 3 == 1, F.concat(F.lit("R"), text)).otherwise(""), "display_title": F.when(k % 13 != 11, F.col("title")), "repnme": F.struct(F.lit("inner name").alias("repnme")), "docty": F.col("kind"), "majdocty": F.col("major"),
        "seccl": F.when(k % 4 == 1, "PUBLIC").when(k % 4 == 2, "Official"), "pdfurl": F.when(k % 2 == 0, F.concat(F.lit("http://x/"), text, F.lit(".pdf"))).otherwise(""), "lang": F.when(k % 5 == 0, "").otherwise("en"), "available_in": F.lit("fr"),
        "docdt": F.date_format("o_orderdate", "yyyy-MM-dd 00:00:00.0"), "url": F.when(k % 6 == 1, "http://x"), "txturl": F.lit("t"),
    }
    return _titled(t).select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("payload_json"), F.when(k % 2 == 0, F.concat(F.lit("P"), text)).otherwise(" ").alias("project_id"), F.when(k % 9 != 2, k).alias("doc_id"), F.lit("2024-01-01").alias("ingested_at"), F.lit("v1").alias("dataset_version_id"))


_TITLE = f"case when {_K} % 13 = 11 then 'inner name' else nullif({_pick(TITLES, _K)}, '') end"
_DOC_ID = f"case {_K} % 3 when 0 then {_K}::varchar when 1 then 'R' || {_K} else case when {_K} % 9 <> 2 then {_K}::varchar end end"
_DOCUMENTS = f"""select {_DOC_ID} as doc_id, case when {_K} % 2 = 0 then 'P' || {_K} end as project_id, coalesce(nullif({_pick(KINDS, _K)}, ''), {_pick(MAJORS, _K)}) as doc_type, {_CLASS} as doc_class, {_DOC_SCORE} as doc_score,
case when {_K} % 5 = 0 then 'fr' else 'en' end as language, {_TITLE} as title, strftime(o_orderdate, '%Y-%m-%dT00:00:00') as publication_date, null::varchar as stored_date, null::varchar as disclosure_date, case when {_K} % 2 = 0 then 'http://x/' || {_K} || '.pdf' else '' end as pdf_url, 't' as txt_url,
case when {_K} % 6 = 1 then 'http://x' end as url, case {_K} % 4 when 1 then 'PUBLIC' when 2 then 'Official' end as security_classification, {_K} % 4 = 1 as is_public, {_K} % 2 = 0 as has_pdf, 'v1' as dataset_version_id, '2024-01-01' as ingested_at from orders where {_K} % 9 <> 2 or {_K} % 3 <> 2"""


@query("prj2_documents", _DOCUMENTS)
def documents(t):
    return X.documents(_document_payloads(t))


@query("flt2_readable", f"select doc_id, doc_class from ({_DOCUMENTS}) where (has_pdf or url is not null) and is_public")
def readable(t):
    return X.readable(X.documents(_document_payloads(t))).select("doc_id", "doc_class")


@query("fn3_lenient_time", "select o_orderkey, case when o_orderkey % 3 = 0 then o_orderdate::timestamp end as at from orders")
def lenient(t):
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.date_format("o_orderdate", "dd MMM yyyy")).when(k % 3 == 1, "31 Feb 2020").otherwise("soon")
    return t("orders").select("o_orderkey", D.lenient_time(raw, "dd MMM yyyy").alias("at"))


@query("srt1_six_keys", """select l_orderkey, l_linenumber from lineitem order by case when l_suppkey % 3 = 0 then null else l_suppkey % 5 end desc nulls last, l_linenumber desc nulls last, case when l_partkey % 4 = 0 then null else l_partkey % 2 end desc nulls last,
l_discount desc nulls last, l_quantity desc nulls last, l_shipdate desc nulls last, l_orderkey, l_linenumber limit 200""")
def six_keys(t):
    ident, hint = F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey") % 5), F.when(F.col("l_partkey") % 4 != 0, F.col("l_partkey") % 2)
    keys = [ident, F.col("l_linenumber"), hint, F.col("l_discount"), F.col("l_quantity"), F.col("l_shipdate")]
    return t("lineitem").orderBy(*[k.desc_nulls_last() for k in keys], "l_orderkey", "l_linenumber").limit(200).select("l_orderkey", "l_linenumber")


@query("srt2_focus_order", """select o_orderkey, 10 * focus + kw + ident + section as score from (select o_orderkey, o_orderkey % 2 as focus, o_orderkey % 3 as kw, case when o_orderkey % 50 = 0 then 22 when o_orderkey % 10 = 0 then 2 else 0 end as ident, o_orderkey % 5 as section from orders)
where 10 * focus + kw + ident + section > 0 order by score desc, o_orderkey limit 40""")
def focus_order(t):
    k = F.col("o_orderkey")
    score = 10 * (k % 2) + k % 3 + F.when(k % 50 == 0, 22).when(k % 10 == 0, 2).otherwise(0) + k % 5
    return t("orders").select("o_orderkey", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "o_orderkey").limit(40)


@query("srt4_recent", "select event_id from events order by ts desc, event_id desc limit 10")
def recent(t):
    return X.ordered_by(t("events"), {"recent": [F.desc("ts"), F.desc("event_id")]}, "recent", 10).select("event_id")


@query("srt5_chosen_order", "select p_partkey from part order by p_retailprice, p_partkey limit 25")
def chosen(t):
    orders = {"name": [F.col("p_name"), F.col("p_partkey")], "price": [F.col("p_retailprice"), F.col("p_partkey")], "size": [F.desc("p_size"), F.col("p_partkey")]}
    return X.ordered_by(t("part"), orders, "price", 25).select("p_partkey")


def _model_json(t):
    """A model's answer for each order: a list of indicators under one of two names, some of them broken."""
    def item(i):
        k = F.col("o_orderkey") + i
        return F.struct(F.when(k % 6 == 0, " ").otherwise(F.concat(F.lit("I"), k.cast("string"))).alias("name"), F.when(k % 2 == 0, "%").otherwise("").alias("unit"), F.when(k % 3 == 0, "1,200.5").alias("baseline"), F.when(k % 4 != 0, "75 %").otherwise("unknown").alias("target"), F.when(k % 5 != 0, (k % 100).cast("string")).alias("achieved"), F.lit("").alias("evidence"))
    items = F.array(*[item(i) for i in range(11)])
    js = F.when(F.col("o_orderkey") % 3 == 0, F.to_json(F.struct(items.alias("results")))).when(F.col("o_orderkey") % 3 == 1, F.to_json(F.struct(items.alias("results_indicators")))).otherwise("{}")
    return t("orders").select("o_orderkey", js.alias("js"))


_ITEMS = """(select o_orderkey, i, o_orderkey + i as k, 'I' || (o_orderkey + i) as name, case when (o_orderkey + i) % 2 = 0 then '%' end as unit, case when (o_orderkey + i) % 3 = 0 then 1200.5 end as baseline, case when (o_orderkey + i) % 4 <> 0 then 75.0 end as target,
case when (o_orderkey + i) % 5 <> 0 then ((o_orderkey + i) % 100)::double end as achieved from orders, (select unnest(range(11)) as i) where o_orderkey % 3 < 2 and (o_orderkey + i) % 6 <> 0)"""


@query("fn23_coerced", f"select o_orderkey, i, name, unit, baseline::double as baseline, target::double as target, achieved from (select *, row_number() over (partition by o_orderkey order by i)::int - 1 as j from {_ITEMS}) t(o_orderkey, i_, k, name, unit, baseline, target, achieved, i)")
def coerced(t):
    items = _model_json(t).select("o_orderkey", F.posexplode(D.coerced_indicators(F.col("js"))).alias("i", "x"))
    return items.select("o_orderkey", "i", "x.name", "x.unit", "x.baseline", "x.target", "x.achieved")


@query("srt10_best_indicators", f"""select o_orderkey, name, place from (select o_orderkey, name, row_number() over (partition by o_orderkey order by 5 * (achieved is not null)::int + 3 * (target is not null)::int + (baseline is not null)::int desc, i)::int as place from {_ITEMS}) where place <= 8""")
def best(t):
    items = _model_json(t).select("o_orderkey", F.posexplode(D.best_indicators(D.coerced_indicators(F.col("js")))).alias("i", "x"))
    return items.select("o_orderkey", "x.name", (F.col("i") + 1).alias("place"))


def _cited_json(t):
    k = F.col("o_orderkey")
    cite = lambda i: F.struct(F.concat(F.lit("D"), (k + i).cast("string")).alias("doc_id"), F.concat(F.lit("K"), ((k + i) % 10).cast("string")).alias("chunk_id"), F.concat(F.lit("q "), F.lit(i).cast("string")).alias("quote"))
    js = F.struct(
        F.struct(F.struct(F.lit("x").alias("value"), F.array(cite(0)).alias("citations")).alias("country"), F.struct(F.lit("y").alias("value"), F.when(k % 2 == 0, F.array(cite(1), cite(2))).alias("citations")).alias("closing")).alias("overview"),
        F.struct(F.array(cite(3)).alias("citations")).alias("objective"), F.array(F.struct(F.lit("n").alias("name"), F.struct(F.array(cite(4)).alias("citations")).alias("target"))).alias("indicators"))
    return t("orders").select("o_orderkey", F.when(k % 10 == 9, "not json").otherwise(F.to_json(js)).alias("js"))


_CITED = "select o_orderkey, i, path, 'D' || (o_orderkey + i) as doc_id, 'K' || ((o_orderkey + i) % 10) as chunk_id, 'q ' || i as quote from orders, (values (0, '{0}'), (1, '{1}'), (2, '{2}'), (3, '{3}'), (4, '{4}')) v(i, path) where o_orderkey % 10 <> 9 and (i not in (1, 2) or o_orderkey % 2 = 0)"


@query("fn24_citations_anywhere", "select o_orderkey, path, doc_id, chunk_id, quote from (" + _CITED.format("overview.country.citations[0]", "overview.closing.citations[0]", "overview.closing.citations[1]", "objective.citations[0]", "indicators[0].target.citations[0]") + ")")
def citations_anywhere(t):
    return _cited_json(t).select("o_orderkey", F.inline(D.citations_anywhere(F.col("js"))))


@query("fn25_citations_in_order", "select o_orderkey, (row_number() over (partition by o_orderkey order by i) - 1)::int as place, path, doc_id, chunk_id, quote from (" + _CITED.format("overview.country", "overview.closing", "overview.closing", "objective", "indicators[0].target") + ")")
def citations_in_order(t):
    paths = ["overview.country", "overview.closing", "ratings.progress", "objective", "theory", "risks", "indicators[0]", "indicators[0].baseline", "indicators[0].target", "indicators[0].achieved"]
    return _cited_json(t).select("o_orderkey", F.posexplode(D.citations_at(F.col("js"), paths)).alias("place", "c")).select("o_orderkey", "place", "c.path", "c.doc_id", "c.chunk_id", "c.quote")


@query("fn41_three_classes", """with e as (select vec_id, embedding, list_max(embedding[1:5]) as m from embeddings), p as (select vec_id, list_position(embedding[1:5], m) - 1 as pos, 1 / (exp(embedding[1]::double - m) + exp(embedding[2]::double - m) + exp(embedding[3]::double - m) + exp(embedding[4]::double - m) + exp(embedding[5]::double - m)) as c from e)
select vec_id, case when pos < 2 then 0 when pos = 2 then 1 else 2 end as label, round(c, 6) as confidence from p""")
def three_classes(t):
    x = D.three_classes(F.transform(F.slice("embedding", 1, 5), lambda v: v.cast("double")))
    return t("embeddings").select("vec_id", x.alias("x")).select("vec_id", "x.label", F.round("x.confidence", 6).alias("confidence"))


@query("joi4_full_merge", "select coalesce(a.k, b.k) as k, n_a, n_b from (select c_nationkey as k, count(*) as n_a from customer where c_nationkey % 3 <> 0 group by 1) a full join (select s_nationkey as k, count(*) as n_b from supplier where s_nationkey % 4 <> 0 group by 1) b on a.k = b.k")
def full_merge(t):
    a = t("customer").where("c_nationkey % 3 <> 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_a"))
    b = t("supplier").where("s_nationkey % 4 <> 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_b"))
    return X.merged_on("k", a, b)


@query("joi12_attributes", """select n_nationkey, coalesce(b.seg, a.seg) as seg, b.bal from nation left join (select c_nationkey as k, min(c_mktsegment) as seg from customer where c_nationkey % 5 <> 0 group by 1) a on a.k = n_nationkey
left join (select s_nationkey as k, min(struct_pack(seg := case when s_suppkey % 2 = 0 then 'S' end, bal := s_acctbal)).seg as seg, min(struct_pack(seg := case when s_suppkey % 2 = 0 then 'S' end, bal := s_acctbal)).bal as bal from supplier where s_suppkey % 2 = 0 group by 1) b on b.k = n_nationkey""")
def attributes(t):
    first = t("customer").where("c_nationkey % 5 <> 0").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("seg"))
    second = t("supplier").where("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("n_nationkey"), F.lit("S").alias("seg"), F.col("s_acctbal").alias("bal"))
    return X.with_attributes(t("nation").select("n_nationkey"), "n_nationkey", first, second).select("n_nationkey", "seg", "bal")


@query("joi13_top_with_flows", """select s_suppkey, coalesce(w, 0) as w from (select s_suppkey from supplier order by s_acctbal desc, s_suppkey limit 20) left join (select l_suppkey, sum(l_quantity) as w from lineitem where l_returnflag = 'R' and l_suppkey % 3 <> 0 group by 1) on l_suppkey = s_suppkey""")
def top_with_flows(t):
    flows = t("lineitem").where("l_returnflag = 'R' and l_suppkey % 3 <> 0").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("l_quantity").alias("w"))
    return t("supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(20).select("s_suppkey").join(flows, "s_suppkey", "left").fillna(0, ["w"])


@query("agg11_profile", "select p_size % 4 as cluster, count(*) as size, round(avg(p_size), 6) as mean_p_size, round(avg(p_retailprice), 6) as mean_p_retailprice from part group by 1")
def profile(t):
    return X.profile(t("part").withColumn("cluster", F.col("p_size") % 4), "cluster", ["p_size", "p_retailprice"]).select("cluster", "size", *[F.round(c, 6).alias(c) for c in ("mean_p_size", "mean_p_retailprice")])


@query("agg14_mode", "select p_brand, p_size as mode, n from (select p_brand, p_size, count(*) as n, row_number() over (partition by p_brand order by count(*) desc, p_size) as r from part group by 1, 2) where r = 1")
def mode(t):
    n = t("part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    return R.top_k(n, ["p_brand"], [F.desc("n"), F.col("p_size")], 1).select("p_brand", F.col("p_size").alias("mode"), "n")


_GUESS = "with r as (select quality as truth, case when doc_id % 7 = 0 then 1 - quality else quality end as guess from labels), c as (select l as label, count(*) filter (truth = l and guess = l) as tp, count(*) filter (truth = l) as support, count(*) filter (guess = l) as guessed from r, (values (0), (1)) v(l) group by 1), p as (select label::varchar as label, tp / guessed as precision, tp / support as recall, 2.0 * tp / (guessed + support) as f1, support from c)"


@query("agg16_full_report", _GUESS + """ select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support::bigint as support from (select * from p union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from p
union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from p union all select 'accuracy', sum(recall * support) / sum(support), sum(recall * support) / sum(support), sum(recall * support) / sum(support), sum(support) from p)""")
def full_report(t):
    rows = t("labels").select(F.col("quality").alias("truth"), F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("guess"))
    r = X.full_report(S.class_report(rows, "truth", "guess"))
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("flt11_three_slices", "select kind, count(*) as n from (select unnest(case when truth = guess then ['right'] when truth = 1 then ['wrong', 'missed'] else ['wrong', 'false'] end) as kind from (select quality as truth, case when doc_id % 7 = 0 then 1 - quality else quality end as guess from labels)) group by 1")
def slices(t):
    rows = t("labels").select(F.col("quality").alias("truth"), F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("guess"))
    kinds = F.array_compact(F.array(F.when(F.col("truth") == F.col("guess"), "right").otherwise("wrong"), F.when((F.col("truth") == 1) & (F.col("guess") == 0), "missed"), F.when((F.col("truth") == 0) & (F.col("guess") == 1), "false")))
    return rows.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("win4_latest_version", "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by floor(value / 10) desc, event_id) as r from events) where r = 1")
def latest_version(t):
    return X.latest_version(t("events").withColumn("version", F.floor(F.col("value") / 10)), ["user_id"], "version", "event_id").select("user_id", "event_id")


@query("win5_last_in_order", "select user_id, event_type, max(event_id) as event_id from events group by 1, 2")
def last_in_order(t):
    return R.latest(t("events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("srt11_grid_order", "select a, b, round(sum(l_extendedprice * (1 - l_discount * a) - l_quantity * b * 100), 2) as profit from lineitem, (values (0.5), (1.0), (1.5)) x(a), (values (1), (5), (9)) y(b) group by 1, 2 order by profit desc, a, b")
def grid_order(t):
    sums = t("lineitem").agg(F.sum("l_extendedprice").alias("p"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("d"), F.sum("l_quantity").alias("q"))  # the grid meets one row
    grid = F.array(*[F.struct(F.lit(a).cast("decimal(2,1)").alias("a"), F.lit(b).alias("b")) for a in (0.5, 1.0, 1.5) for b in (1, 5, 9)])
    return sums.select("p", "d", "q", F.inline(grid)).select("a", "b", F.round(F.col("p") - F.col("d") * F.col("a").cast("double") - F.col("q") * F.col("b") * 100, 2).alias("profit")).orderBy(F.desc("profit"), "a", "b")


@query("set3_intersection", "select l_suppkey from (select l_suppkey from lineitem group by 1 order by sum(l_quantity) desc, l_suppkey limit 30) intersect select l_suppkey from (select l_suppkey from lineitem group by 1 order by count(*) desc, l_suppkey limit 30)")
def intersection(t):
    g = t("lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    return g.orderBy(F.desc("q"), "l_suppkey").limit(30).select("l_suppkey").intersect(g.orderBy(F.desc("n"), "l_suppkey").limit(30).select("l_suppkey"))


@query("set4_both_overlaps", """with g as (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as a, row_number() over (partition by c_nationkey order by c_custkey desc) as b from customer)
select c_nationkey, round(count(*) filter (a <= 9 and b <= 9) / greatest(1, 9)::double, 6) as of_k, round(count(*) filter (a <= 9 and b <= 9) / least(9, count(*))::double, 6) as of_least from g group by 1""")
def both_overlaps(t):
    c = t("customer")
    least = R.overlap(c, "c_acctbal", "c_custkey", "c_custkey", ["c_nationkey"], 9).withColumnRenamed("overlap", "of_least")
    n = c.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    of_k = F.col("of_least") * F.least(F.lit(9), F.col("n")) / 9
    return least.join(n, "c_nationkey").select("c_nationkey", F.round(of_k, 6).alias("of_k"), F.round("of_least", 6).alias("of_least"))


@query("set6_recursive_merge", """select o_orderkey, case when o_orderkey % 2 = 0 then 'old' else 'new' end as name, case when o_orderkey % 3 = 0 then 'in' else 'side' end as inner_name, 1 + (o_orderkey % 4 <> 0)::int + 1 as items from orders""")
def recursive_merge(t):
    k = F.col("o_orderkey")
    item = lambda n, u: F.struct(F.lit(n).alias("name") if isinstance(n, str) else n.alias("name"), F.lit(u).alias("unit"))
    old = F.struct(F.when(k % 2 == 0, "old").otherwise("").alias("name"), F.struct(F.when(k % 3 == 0, "in").alias("name")).alias("inner"))
    new = F.struct(F.lit("new").alias("name"), F.struct(F.lit("side").alias("name")).alias("inner"))
    items = X.merged_items(F.array(item("A", "%")), F.array(item("a ", "%"), item(F.when(k % 4 != 0, "B").otherwise("A"), "%"), item("C", None), item("c", None)), ["name", "unit"])
    return t("orders").select("o_orderkey", X.filled_from(old, new, ["name", ("inner", ["name"])]).alias("x"), F.size(items).alias("items")).select("o_orderkey", "x.name", F.col("x.inner.name").alias("inner_name"), "items")


_SHARE = "(('0x' || substr(md5('{0}' || {1}), 1, 8))::bigint / 4294967296.0)"


@query("set10_hash_split", f"select o_orderkey, case when {_SHARE.format('h', 'o_orderkey')} < 0.7 then 'train' when {_SHARE.format('h', 'o_orderkey')} < 0.85 then 'valid' else 'test' end as split from orders")
def hash_split(t):
    return X.hash_split(t("orders"), {"train": 0.7, "valid": 0.85}, "test", "h", "o_orderkey").select("o_orderkey", "split")


@query("set11_test_flag", f"select c_custkey, {_SHARE.format('f', 'c_custkey')} < 0.99 as is_test from customer")
def test_flag(t):
    return t("customer").select("c_custkey", (X.hash_share("f", "c_custkey") < 0.99).alias("is_test"))


@query("fn38_numbered", "select event_id, 'log_' || (row_number() over (order by ts, event_id) + 5) as id from events")
def numbered(t):
    from lodestrata.operators.review import numbered

    return numbered(t("events"), "log", ["ts", "event_id"], 5).select("event_id", "id")


@query("prj17_relevel", "select o_orderkey, (o_orderstatus = 'F')::int as o_orderstatus_F, (o_orderstatus = 'P')::int as o_orderstatus_P from orders")
def relevel(t):
    return X.relevelled(t("orders"), "o_orderstatus", "O", ["F", "O", "P"]).select("o_orderkey", "o_orderstatus_F", "o_orderstatus_P")


@query("prj13_constant_groups", "select p_partkey, round(case when max(x) over w > min(x) over w then (x - min(x) over w) / (max(x) over w - min(x) over w) else 0 end, 9) as scaled from (select p_partkey, p_brand, case when p_brand like '%1' then 7.0 else p_retailprice end as x from part) window w as (partition by p_brand)")
def constant_groups(t):
    x = F.when(F.col("p_brand").endswith("1"), 7.0).otherwise(F.col("p_retailprice"))
    return S.min_max(t("part").withColumn("scaled", x), ["scaled"], ["p_brand"]).select("p_partkey", F.round("scaled", 9).alias("scaled"))


@query("flt5_anti_pairs", "select l_suppkey, l_linenumber, count(*) as n from lineitem where not exists (select 1 from supplier where s_suppkey = l_suppkey and s_nationkey % 7 + 1 = l_linenumber) group by 1, 2")
def anti_pairs(t):
    own = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % 7 + 1).alias("l_linenumber"))
    return t("lineitem").join(own, ["l_suppkey", "l_linenumber"], "left_anti").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("joi11_pair_shares", """with f as (select s_nationkey as o, c_nationkey as d, o_orderpriority as ind, l_suppkey as sp, c_custkey % 10 as cp, sum(l_quantity) as w from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey group by 1, 2, 3, 4, 5),
x as (select o, d, ind, sp, sum(w) as e, row_number() over (partition by o, d, ind order by sum(w) desc, sp) as r from f group by 1, 2, 3, 4), m as (select o, d, ind, cp, sum(w) as i, row_number() over (partition by o, d, ind order by sum(w) desc, cp) as r from f group by 1, 2, 3, 4), a as (select o, d, ind, sum(w) as total from f group by 1, 2, 3),
xs as (select *, e / sum(e) over (partition by o, d, ind) as se from x where r <= 3), ms as (select *, i / sum(i) over (partition by o, d, ind) as si from m where r <= 3) select o, d, ind, sp, cp, round(total * se * si, 6) as w from xs join ms using (o, d, ind) join a using (o, d, ind)""")
def pair_shares(t):
    """The three largest ports of either side of each (origin, destination, industry), their shares made to sum to one again,
    meet within it: nine rows at most."""
    j = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    of = ["o", "d", "ind"]
    f = j.groupBy(F.col("s_nationkey").alias("o"), F.col("c_nationkey").alias("d"), F.col("o_orderpriority").alias("ind"), F.col("l_suppkey").alias("sp"), (F.col("c_custkey") % 10).alias("cp")).agg(F.sum("l_quantity").alias("w"))

    def side(port, share):
        top = R.top_k(f.groupBy(*of, port).agg(F.sum("w").alias("s")), of, [F.desc("s"), F.col(port)], 3)
        return top.withColumn(share, F.col("s") / F.sum("s").over(Window.partitionBy(*of))).drop("s")

    total = f.groupBy(*of).agg(F.sum("w").alias("total"))
    return side("sp", "se").join(side("cp", "si"), of).join(total, of).select(*of, "sp", "cp", F.round(F.col("total") * F.col("se") * F.col("si"), 6).alias("w"))
