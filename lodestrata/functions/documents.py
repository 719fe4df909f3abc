"""Column functions that class, score and read documents of projects, with their word lists as parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lodestrata.functions.text import as_word

#: Classes in order of precedence with the phrases that tell them, and the scores of a document.
CLASSES = {
    "ICR": ["implementation completion and results report", "icr", "implementation completion report"],
    "PAD": ["project appraisal document", "program appraisal document", "pad"],
    "ISR": ["implementation status and results report", "isr"],
    "RESULTS_FRAMEWORK": ["results framework", "results framework and monitoring", "logframe"],
    "RESTRUCTURING": ["restructuring"],
}
CLASS_SCORES = {"ICR": 20.0, "PAD": 15.0, "ISR": 12.0, "RESULTS_FRAMEWORK": 14.0, "RESTRUCTURING": 10.0, "OTHER": 1.0}
HAS_PDF, IS_PUBLIC = 5.0, 3.0
POOR_MAJORS, POOR_KINDS, POOR = ["Publications & Research"], ["Working Paper"], -10.0
TITLE_WORDS = {"project": 1.0, "report": 0.5}
SECTIONS = ["results", "indicator", "baseline", "target"]


def document_class(title: Column, kind: Column, major: Column, classes: dict[str, list[str]] = CLASSES) -> Column:
    """The first class of which a phrase stands in title, kind or major as whole words; OTHER if none does."""
    text = F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in (title, kind, major)])
    out = F.lit("OTHER")
    for name, phrases in reversed(classes.items()):
        out = F.when(text.rlike(as_word("|".join(phrases))), name).otherwise(out)
    return out


def document_score(cls: Column, has_pdf: Column, is_public: Column, title: Column, kind: Column, major: Column, scores: dict[str, float] = CLASS_SCORES) -> Column:
    add = lambda when, x: F.when(when, x).otherwise(0.0)
    of_class = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in scores.items() for x in kv]), cls), F.lit(scores["OTHER"]))
    low = F.lower(F.coalesce(title, F.lit("")))
    words = sum((add(low.contains(w), x) for w, x in TITLE_WORDS.items()), F.lit(0.0))
    return add(has_pdf, HAS_PDF) + add(is_public, IS_PUBLIC) + of_class + add(major.isin(POOR_MAJORS), POOR) + add(kind.isin(POOR_KINDS), POOR) + words


def filled(x: Column) -> Column:
    """x without surrounding white space; null if nothing is left."""
    return F.nullif(F.trim(x), F.lit(""))


def lenient_time(x: Column, pattern: str) -> Column:
    """A time in a pattern; null where the text is none."""
    return F.try_to_timestamp(x, F.lit(pattern)).cast("timestamp_ntz")


def number(x: Column) -> Column:
    """A number out of text with thousands separators, per cent signs or units after it; null if there is none."""
    return F.replace(F.regexp_extract(x, r"^\s*(-?[\d,]*\.?\d+)", 1), F.lit(","), F.lit("")).try_cast("double")


_INDICATORS = "array<struct<name:string,unit:string,baseline:string,target:string,achieved:string,evidence:string>>"


def coerced_indicators(js: Column) -> Column:
    """The indicators of a model's JSON, under either of two names: numbers read out of text, empty texts null, evidence
    always a text. Entries without a name go; no list gives an empty one."""
    found = F.coalesce(F.get_json_object(js, "$.results_indicators"), F.get_json_object(js, "$.results"))
    items = F.coalesce(F.from_json(found, _INDICATORS), F.array().cast(_INDICATORS))
    fixed = lambda x: F.struct(filled(x["name"]).alias("name"), filled(x["unit"]).alias("unit"), *[number(x[c]).alias(c) for c in ("baseline", "target", "achieved")], filled(x["evidence"]).alias("evidence"))
    return F.filter(F.transform(items, fixed), lambda x: x["name"].isNotNull())


def completeness(indicator: Column, weights: dict[str, int] | None = None) -> Column:
    """How much of an indicator is known: 5 for achieved, 3 for target, 1 for baseline."""
    weights = weights or {"achieved": 5, "target": 3, "baseline": 1}
    return sum((F.when(indicator[c].isNotNull(), w).otherwise(0) for c, w in weights.items()), F.lit(0))


def best_indicators(items: Column, n: int = 8) -> Column:
    """The n most complete of an array, ties in order of the array."""
    placed = F.transform(items, lambda x, i: F.struct((-completeness(x)).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(placed), 1, n), lambda p: p["x"])


def _walk(js):
    """Every object of a JSON text with doc_id, chunk_id and quote, in the order of reading."""
    import json

    import pandas as pd

    def walk(x, path, out):
        if isinstance(x, dict):
            if {"doc_id", "chunk_id", "quote"} <= x.keys():
                out.append((path, *[None if x[k] is None else str(x[k]) for k in ("doc_id", "chunk_id", "quote")]))
            for k, v in x.items():
                walk(v, f"{path}.{k}" if path else k, out)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                walk(v, f"{path}[{i}]", out)
        return out

    def one(text):
        try:
            return walk(json.loads(text), "", [])
        except (TypeError, ValueError):
            return []

    return pd.Series([one(x) for x in js])


def citations_anywhere(js: Column) -> Column:
    """array<struct<path, doc_id, chunk_id, quote>>: the citations at any depth of any JSON. The depth is open, so no fixed
    schema and no built-in function can say it."""
    return pandas_udf(_walk, "array<struct<path:string,doc_id:string,chunk_id:string,quote:string>>")(js)


def citations_at(js: Column, paths: list[str]) -> Column:
    """array<struct<path, i, doc_id, chunk_id, quote>>: the citations under known paths, path by path."""
    kind = "array<struct<doc_id:string,chunk_id:string,quote:string>>"
    one = lambda p: F.transform(F.coalesce(F.from_json(F.get_json_object(js, f"$.{p}.citations"), kind), F.array().cast(kind)), lambda c, i: F.struct(F.lit(p).alias("path"), i.alias("i"), c["doc_id"].alias("doc_id"), c["chunk_id"].alias("chunk_id"), c["quote"].alias("quote")))
    return F.flatten(F.array(*[one(p) for p in paths]))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def three_classes(scores: Column) -> Column:
    """struct<label, confidence>: the likeliest of five classes as one of three (0 and 1: 0, 2: 1, 3 and 4: 2), ties to the first."""
    p = softmax(scores)
    at = F.array_position(p, F.array_max(p)).cast("int") - 1
    return F.struct(F.when(at < 2, 0).when(at == 2, 1).otherwise(2).alias("label"), F.array_max(p).alias("confidence"))
