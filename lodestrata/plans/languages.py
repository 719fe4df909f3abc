"""Queries on the words of whole texts, language by language. The dictionary of a language are words that its texts hold three times."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import lemmas as L
from lodestrata.plans.registry import query


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)


_STOP = _values((lang, w) for lang, words in L.STOP.items() for w in words)
_RULES = _values((lang, i, a, b) for lang, rules in L.RULES.items() for i, (a, b) in enumerate(rules))
_ALL = r"""a as (select doc_id, lang, list_filter(string_split_regex(trim(lower(regexp_replace(coalesce(text, ''), '[!-@\[-`{-~]', '', 'g'))), '\s+'), lambda x: x <> '') as ws from documents),
t as (select doc_id, lang, ws[i] as word, i as pos from (select *, unnest(range(1, len(ws) + 1)) as i from a)), """ + f"stop(lang, word) as (values {_STOP})"
_LEMMAS = f"""{_ALL}, k as (select * from t anti join stop using (lang, word)), c as (select lang, word, count(*) as n from k group by all), rules(lang, place, a, b) as (values {_RULES}),
l1 as (select c.lang, word, place, left(word, length(word) - length(a)) || b as form from c join rules r on r.lang = c.lang and ends_with(word, a)),
l2 as (select l1.lang, word, l1.place, r.place as place2, left(form, length(form) - length(a)) || b as form from l1 join rules r on r.lang = l1.lang and ends_with(form, a) where form <> ''),
f as (select lang, word, 0 as step, -1 as p, -1 as q, word as form from c union all select lang, word, 0, place, -1, form from l1 union all select lang, word, 1, place, place2, form from l2),
best as (select f.lang, f.word, f.form as lemma from f join c d on d.lang = f.lang and d.word = f.form and d.n >= 3 qualify row_number() over (partition by f.lang, f.word order by step, length(form), p, q) = 1),
lemmas as (select * from best where lemma <> word)"""


def _docs(t):
    return t("documents").select("doc_id", "lang", L.kept_words(F.col("text"), F.col("lang")).alias("words"))


@query("fn28_fn29_stop_words", f"""with {_ALL}, o as (select doc_id, count(*) as n_own, md5(string_agg(word, ' ' order by pos)) as own from t anti join stop using (lang, word) group by 1),
e as (select doc_id, count(*) as n_every, md5(string_agg(word, ' ' order by pos)) as every from t where word not in (select word from stop) group by 1)
select doc_id, coalesce(n_own, 0) as n_own, coalesce(own, md5('')) as own, coalesce(n_every, 0) as n_every, coalesce(every, md5('')) as every from documents left join o using (doc_id) left join e using (doc_id)""")
def stop_words(t):
    """Words kept by the list of a text's own language, and by those of all languages together."""
    d = t("documents")
    w = d.select("doc_id", *[L.kept_words(d["text"], d["lang"], together=x).alias(n) for n, x in (("own", False), ("every", True))])
    return w.select("doc_id", *[c for n in ("own", "every") for c in (F.size(n).cast("long").alias(f"n_{n}"), F.md5(F.array_join(n, " ")).alias(n))])


@query("fn28_lemma_table", f"with {_LEMMAS} select lang, word, lemma, n from lemmas join c using (lang, word)")
def lemma_table(t):
    c = L.counted(_docs(t))
    return L.lemma_table(c, c.where("n >= 3")).join(c, ["lang", "word"]).select("lang", "word", "lemma", "n")


@query("fn28_lemmatized", f"""with {_LEMMAS}, x as (select doc_id, count(*) as n, md5(string_agg(coalesce(lemma, word), ' ' order by pos)) as lemmas from k left join lemmas using (lang, word) group by 1)
select doc_id, coalesce(n, 0) as n, coalesce(lemmas, md5('')) as lemmas from documents left join x using (doc_id)""")
def lemmatized(t):
    d = _docs(t)
    c = L.counted(d).persist()  # frequent words, dictionary and lemmas all read the counts
    out = L.lemmatized(d, "doc_id", c, L.lemma_table(c, c.where("n >= 3")))
    return out.select("doc_id", F.size("words").cast("long").alias("n"), F.md5(F.array_join("words", " ")).alias("lemmas"))
