"""Queries over texts: measures, classes, quota selection, retrieval, grounding, cleaning, weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import parsing as P
from lodestrata.functions import text as T
from lodestrata.operators import ranking as R
from lodestrata.operators import stats as S
from lodestrata.plans.registry import query

_CLS = "case " + " ".join(f"when regexp_matches(text, '{T.as_word(p)}') then '{n}'" for n, p in T.CLASSES) + " else 'OTHER' end"
_SCORE = f"(case {_CLS} when 'REPORT' then 20.0 when 'NOTE' then 15.0 when 'LETTER' then 12.0 when 'MEMO' then 14.0 else 1.0 end)::double"
_HINTS = "(" + " + ".join(f"regexp_matches(text, '{T.as_word(w)}')::int" for w in T.SECTION_HINTS) + ")"


def scored(t):
    d = t("documents")
    cls = T.classify(F.col("text"))
    return d.withColumn("cls", cls).withColumn("score", T.class_score(F.col("cls")) + T.hints(F.col("text")))


@query("win2_quota_topk", f"""
with s as (select doc_id, lang, n_chars, {_CLS} as cls, {_SCORE} + {_HINTS} as score from documents),
m as (select *, row_number() over (partition by lang, cls order by score desc, n_chars desc, doc_id) <= (case cls when 'REPORT' then 3 when 'NOTE' then 1 when 'LETTER' then 1 when 'MEMO' then 1 else 0 end) as must_include from s)
select lang, doc_id, cls, score, must_include, rank from (select *, (row_number() over (partition by lang order by must_include desc, score desc, n_chars desc, doc_id))::int as rank from m) where rank <= 8""")
def quota(t):
    quotas = {"REPORT": 3, "NOTE": 1, "LETTER": 1, "MEMO": 1}
    rows = scored(t).select("doc_id", "lang", "n_chars", "cls", "score")
    return R.quota_top_k(rows, "lang", "cls", quotas, [F.desc("score"), F.desc("n_chars"), F.col("doc_id")], 8).select("lang", "doc_id", "cls", "score", "must_include", "rank")


@query("win1_topk_per_group", f"""select source, doc_id, score from (select source, doc_id, {_SCORE} + {_HINTS} as score, row_number() over (partition by source order by {_SCORE} + {_HINTS} desc, doc_id) as r from documents) where r <= 3""")
def topk(t):
    return R.top_k(scored(t).select("source", "doc_id", "score"), ["source"], [F.desc("score"), F.col("doc_id")], 3)


@query("fn4_fn5_class_score", f"select doc_id, {_CLS} as cls, {_SCORE} + {_HINTS} as score from documents")
def class_score(t):
    return scored(t).select("doc_id", "cls", "score")


@query("fn6_text_ratios", """select doc_id, length(text) as text_length, round(case when length(text) > 0 then length(regexp_replace(text, '[^\\p{Nd}]', '', 'g'))::double / length(text) else 0 end, 9) as digit_ratio, round(case when length(text) > 0 then length(regexp_replace(text, '[^\\p{L}]', '', 'g'))::double / length(text) else 0 end, 9) as alpha_ratio, round(case when length(text) > 0 then 1 - length(regexp_replace(text, '[^\\p{L}\\p{Nd}]', '', 'g'))::double / length(text) else 0 end, 9) as non_alnum_ratio from documents""")
def ratios(t):
    x = F.col("text")
    return t("documents").select("doc_id", F.length(x).cast("long").alias("text_length"), F.round(T.digit_ratio(x), 9).alias("digit_ratio"), F.round(T.alpha_ratio(x), 9).alias("alpha_ratio"), F.round(T.non_alnum_ratio(x), 9).alias("non_alnum_ratio"))


@query("fn7_section_hints", f"select doc_id, {_HINTS} as hints from documents")
def hints(t):
    return t("documents").select("doc_id", T.hints(F.col("text")).alias("hints"))


_KEYS = ["the", "token", "license", "with", "and", "por", "est", "und"]


@query("fn8_keyword_score", "select doc_id, " + " + ".join(f"contains(lower(text), '{k}')::int" for k in _KEYS) + " as score from documents")
def keywords(t):
    return t("documents").select("doc_id", T.keyword_score(F.col("text"), _KEYS).alias("score"))


@query("fn9_id_score", "select page_id, (case when contains(html, 'title') then 2 else 0 end + case when list_contains(list_transform(string_split(html, chr(10)), lambda x: trim(x)), 'title') then 20 else 0 end)::int as score from pages")
def ids(t):
    return t("pages").select("page_id", T.id_score(F.col("html"), F.lit("title")).alias("score"))


@query("srt1_ranked_chunks", f"""select doc_id, r from (select doc_id, (row_number() over (partition by lang order by {_HINTS} desc, n_chars desc nulls last, doc_id))::int as r from documents) where r <= 20""")
def ranked(t):
    rows = t("documents").select("lang", "doc_id", "n_chars", T.hints(F.col("text")).alias("hints"))
    from pyspark.sql import Window

    w = Window.partitionBy("lang").orderBy(F.desc_nulls_last("hints"), F.desc_nulls_last("n_chars"), "doc_id")
    return rows.select("doc_id", F.row_number().over(w).alias("r")).where("r <= 20")


@query("srt2_focus_retrieval", "select doc_id, 10 * (contains(lower(text), 'token')::int + contains(lower(text), 'license')::int) + " + " + ".join(f"contains(lower(text), '{k}')::int" for k in _KEYS) + " as score from documents where contains(lower(text), 'token') or contains(lower(text), 'license') order by score desc, doc_id limit 25")
def focus(t):
    x = F.col("text")
    f = T.keyword_score(x, ["token", "license"])
    return t("documents").select("doc_id", (10 * f + T.keyword_score(x, _KEYS)).alias("score"), f.alias("f")).where("f > 0").drop("f").orderBy(F.desc("score"), "doc_id").limit(25)


@query("flt13_agg1_thin_corpus", "select source, count(*) as n_docs, count(distinct lang) as n_langs, sum(n_chars)::bigint as total_chars, count(*) filter (n_chars > 2000) as n_long, (count(*) < 3 or sum(n_chars) < 100000) as thin from documents group by source")
def thin(t):
    g = t("documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.countDistinct("lang").alias("n_langs"), F.sum("n_chars").alias("total_chars"), F.count(F.when(F.col("n_chars") > 2000, 1)).alias("n_long"))
    return g.withColumn("thin", (F.col("n_docs") < 3) | (F.col("total_chars") < 100_000))


_CITED = "select item_id, (item_id * 7) % 100 as chunk_id, text as quote from benchmark"


@query("val1_joi9_grounding", f"""with c as ({_CITED})
select item_id, c.chunk_id, case when d.doc_id is null then 'missing_citation' when contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(quote, '\\s+', ' ', 'g'))) then 'supported' else 'citation_not_supported' end as issue from c left join documents d on d.doc_id = c.chunk_id""")
def grounding(t):
    c = t("benchmark").select("item_id", (F.col("item_id") * 7 % 100).alias("chunk_id"), F.col("text").alias("quote"))
    d = t("documents").select(F.col("doc_id").alias("chunk_id"), "text")
    issue = F.when(F.col("text").isNull(), "missing_citation").when(T.supports(F.col("text"), F.col("quote")), "supported").otherwise("citation_not_supported")
    return c.join(d, "chunk_id", "left").select("item_id", "chunk_id", issue.alias("issue"))


@query("agg22_grounding_metrics", f"""with c as ({_CITED}), s as (select c.*, d.doc_id, coalesce(contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(quote, '\\s+', ' ', 'g'))), false) as ok from c left join documents d on d.doc_id = c.chunk_id)
select count(*) as citations, count(*) filter (ok) as supported, round(count(*) filter (ok) / count(*)::double, 9) as rate, count(distinct doc_id) as docs from s""")
def grounding_metrics(t):
    g = grounding(t)
    ok = F.count(F.when(F.col("issue") == "supported", 1))
    return g.agg(F.count("*").alias("citations"), ok.alias("supported"), F.round(ok / F.count("*"), 9).alias("rate"), F.countDistinct(F.when(F.col("issue") != "missing_citation", F.col("chunk_id"))).alias("docs"))


@query("agg2_issue_counts", f"""with c as ({_CITED}), i as (select lang as severity, case when contains(d.text, quote) then 'supported' else 'citation_not_supported' end as issue_type from c join documents d on d.doc_id = c.chunk_id)
select severity, issue_type, count(*) as n from i group by all order by severity, n desc""")
def issues(t):
    c = t("benchmark").select((F.col("item_id") * 7 % 100).alias("doc_id"), F.col("text").alias("quote"))
    i = t("documents").join(c, "doc_id").select(F.col("lang").alias("severity"), F.when(F.contains("text", "quote"), "supported").otherwise("citation_not_supported").alias("issue_type"))
    return i.groupBy("severity", "issue_type").agg(F.count("*").alias("n")).orderBy("severity", F.desc("n"))


@query("fn27_letters_only", "select page_id, md5(lower(regexp_replace(regexp_replace(html, '<[^\\n]*?>', '', 'g'), '[^A-Za-z\\s]', '', 'g'))) as clean from pages")
def letters(t):
    return t("pages").select("page_id", F.md5(T.letters_only(F.col("html"))).alias("clean"))


@query("fn29_fn30_cleaned", "select doc_id, md5(lower(regexp_replace(text, '[!-@\\[-`{-~]', '', 'g'))) as bare, md5(trim(regexp_replace(text, '[ \\n\\t\\r]+', ' ', 'g'))) as flat from documents")
def cleaned(t):
    return t("documents").select("doc_id", F.md5(T.without_marks(F.col("text"))).alias("bare"), F.md5(T.collapsed(F.col("text"))).alias("flat"))


_STOP = ["the", "of", "and", "de", "la"]
_TOK = "list_filter(string_split_regex(trim(lower(regexp_replace(text, '[!-@\\[-`{-~]', '', 'g'))), '\\s+'), lambda w: w <> '' and w not in ('the', 'of', 'and', 'de', 'la'))"


@query("fn28_agg17_word_counts", f"select term, count(*) as n from (select unnest({_TOK}) as term from documents) group by term order by n desc, term limit 50")
def word_counts(t):
    w = t("documents").select(F.explode(T.tokens(T.without_marks(F.col("text")), _STOP)).alias("term"))
    return w.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(50)


@query("ml4_tfidf", f"""with w as (select item_id, unnest({_TOK}) as term from benchmark), tf as (select item_id, term, count(*) as tf from w group by all), df as (select term, count(*) as df from tf group by term),
r as (select item_id, term, tf * (ln((1 + (select count(*) from benchmark)) / (1 + df)::double) + 1) as raw from tf join df using (term))
select item_id, term, round(raw / sqrt(sum(raw * raw) over (partition by item_id)), 6) as weight from r""")
def tf_idf(t):
    d = t("benchmark").select("item_id", T.tokens(T.without_marks(F.col("text")), _STOP).alias("w"))
    return S.tf_idf(d, "item_id", "w").withColumn("weight", F.round("weight", 6))


@query("fn31_token_index", f"""with w as (select doc_id, unnest({_TOK}) as term, generate_subscripts({_TOK}, 1) as pos from documents), v as (select term, row_number() over (order by count(*) desc, term) as id from w group by term qualify id <= 600)
select doc_id, md5(string_agg(id::varchar, ',' order by pos)) as ids, count(*) as n from (select doc_id, pos, id, row_number() over (partition by doc_id order by pos) as k from w join v using (term)) where k <= 300 group by doc_id""")
def token_index(t):
    from pyspark.sql import Window

    w = t("documents").select("doc_id", F.posexplode(T.tokens(T.without_marks(F.col("text")), _STOP)).alias("pos", "term"))
    v = w.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(600)
    v = v.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "term")))
    j = w.join(v, "term").groupBy("doc_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]), 1, 300).alias("ids"))
    return j.select("doc_id", F.md5(F.array_join("ids", ",")).alias("ids"), F.size("ids").cast("long").alias("n"))


def padded_index(docs, size=6000, width=300):
    """doc_id, ids, n of every document: its first width words among the size most frequent, by rank, padded with 0."""
    from pyspark.sql import Window

    w = docs.select("doc_id", F.posexplode(T.tokens(T.without_marks(F.col("text")), _STOP)).alias("pos", "term"))
    v = w.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(size)
    v = v.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "term"))).drop("n")
    j = w.join(v, "term").groupBy("doc_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]), 1, width).alias("ids"))
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    return docs.select("doc_id").distinct().join(j, "doc_id", "left").select("doc_id", T.padded(ids, width).alias("ids"), F.size(ids).cast("long").alias("n"))


@query("fn31_padded_index", f"""with w as (select doc_id, unnest({_TOK}) as term, generate_subscripts({_TOK}, 1) as pos from documents), v as (select term, row_number() over (order by count(*) desc, term) as id from w group by term qualify id <= 6000),
j as (select doc_id, id, row_number() over (partition by doc_id order by pos) as k from w join v using (term)), p as (select doc_id, unnest(range(1, 301)) as k from (select distinct doc_id from documents))
select p.doc_id, md5(string_agg(coalesce(id, 0)::varchar, ',' order by p.k)) as ids, count(id) as n from p left join j on p.doc_id = j.doc_id and p.k = j.k group by p.doc_id""")
def whole_token_index(t):
    return padded_index(t("documents")).withColumn("ids", F.md5(F.array_join("ids", ",")))


@query("fn32_sha256", "select doc_id, sha256(text) as sha from documents")
def sha(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("fn26_coherence", """select page_id, round(0.2 * contains(lower(html), 'objective')::int + 0.3 * contains(lower(html), 'achieve')::int + 0.2 * contains(lower(html), 'data quality')::int + 0.1 * contains(lower(html), '|')::int + 0.2, 6)::double as score from pages where not contains(lower(html), 'not confirmed')""")
def coherent(t):
    return t("pages").where(~F.lower("html").contains("not confirmed")).select("page_id", F.round(T.coherence(F.col("html")), 6).alias("score"))


@query("val4_set5_stability", """with w as (select conv_id, turn, list_distinct(string_split(lower(text), ' ')) as s from conversations), p as (select conv_id, s, lead(s) over (partition by conv_id order by turn desc) as o from w)
select conv_id, round(avg(case when o is null or len(list_distinct(list_concat(s, o))) = 0 then null else len(list_intersect(s, o))::double / len(list_distinct(list_concat(s, o))) end), 6) as jaccard, count(o) as pairs from p group by conv_id""")
def stability(t):
    from pyspark.sql import Window

    w = t("conversations").select("conv_id", "turn", F.array_distinct(F.split(F.lower("text"), " ")).alias("s"))
    p = w.withColumn("o", F.lead("s").over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    j = F.try_divide(F.size(F.array_intersect("s", "o")), F.size(F.array_union("s", "o")))
    return p.groupBy("conv_id").agg(F.round(F.avg(F.when(F.col("o").isNotNull(), j)), 6).alias("jaccard"), F.count("o").alias("pairs"))


@query("agg15_agg16_class_report", """with g as (select l.quality as y, (n_chars > 900)::int as p from labels l join documents using (doc_id)), c as (select unnest([0, 1]) as label),
m as (select label, count(*) filter (y = label and p = label) as tp, count(*) filter (p = label) as gu, count(*) filter (y = label) as su from c, g group by label)
select label, round(case when gu = 0 then 0 else tp / gu::double end, 6) as precision, round(case when su = 0 then 0 else tp / su::double end, 6) as recall, round(case when gu + su = 0 then 0 else 2 * tp / (gu + su)::double end, 6) as f1, su as support from m""")
def report(t):
    g = t("labels").join(t("documents"), "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") > 900).cast("int").alias("p"))
    return S.class_report(g, "y", "p").select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("flt11_misclassified", "select doc_id, quality, (n_chars > 900)::int as guess from labels join documents using (doc_id) where quality <> (n_chars > 900)::int")
def wrong(t):
    g = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id")
    return g.select("doc_id", "quality", (F.col("n_chars") > 900).cast("int").alias("guess")).where("quality <> guess")


@query("prj9_fn40_labels", "select vec_id, case when label <= 2 then 0 when label = 3 then 1 else 2 end as cls, case when embedding[1] >= 0.5 then 'positive' else 'negative' end as side, round((case when embedding[1] >= 0.5 then embedding[1] else 1 - embedding[1] end)::double, 3) as conf from embeddings")
def labels(t):
    e = F.get("embedding", F.lit(0))
    return t("embeddings").select("vec_id", F.when(F.col("label") <= 2, 0).when(F.col("label") == 3, 1).otherwise(2).alias("cls"), F.when(e >= 0.5, "positive").otherwise("negative").alias("side"), F.round(F.when(e >= 0.5, e).otherwise((1 - e).cast("float")).cast("double"), 3).alias("conf"))


@query("fn41_argmax", "select vec_id, (list_position(embedding[1:5], list_max(embedding[1:5])) - 1)::int as top, list_max(embedding[1:5])::double as conf from embeddings")
def argmax(t):
    five = F.slice("embedding", 1, 5)
    return t("embeddings").select("vec_id", (F.array_position(five, F.array_max(five)) - 1).cast("int").alias("top"), F.array_max(five).cast("double").alias("conf"))


@query("fn13_fn34_paths", "select page_id, string_split('facts[' || page_id || '].value.citations[0].quote', '.citations[')[1] as path, 'https://example.org/project/' || trim(page_id::varchar) as url from pages")
def paths(t):
    p = F.concat(F.lit("facts["), F.col("page_id"), F.lit("].value.citations[0].quote"))
    return t("pages").select("page_id", P.field_path(p).alias("path"), F.format_string("https://example.org/project/%s", F.trim(F.col("page_id").cast("string"))).alias("url"))
