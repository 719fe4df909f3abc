"""Column functions that measure, classify and clean text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that hint at sections, and patterns of document classes in their order.
SECTION_HINTS = ["the", "that", "que", "der"]
CLASSES = [("REPORT", "of the"), ("NOTE", "that"), ("LETTER", "que"), ("MEMO", "der")]
CLASS_SCORE = {"REPORT": 20.0, "NOTE": 15.0, "LETTER": 12.0, "MEMO": 14.0, "OTHER": 1.0}


def share_of(text: Column, kept: str) -> Column:
    """Share of the characters of a class (a regular expression's inside); 0 for an empty text."""
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, f"[^{kept}]", "")) / n).otherwise(0.0)


def digit_ratio(text: Column) -> Column:
    return share_of(text, r"\p{Nd}")


def alpha_ratio(text: Column) -> Column:
    return share_of(text, r"\p{L}")


def non_alnum_ratio(text: Column) -> Column:
    return F.when(F.length(text) > 0, 1 - share_of(text, r"\p{L}\p{Nd}")).otherwise(0.0)


def as_word(pattern: str) -> str:
    """A pattern between the bounds of ASCII words, whatever its case; the same in Java, RE2 and Python."""
    return f"(?i)(^|[^A-Za-z0-9_])({pattern})([^A-Za-z0-9_]|$)"


def hints(text: Column, words: list[str] = SECTION_HINTS) -> Column:
    """How many of the words stand in the text as words, whatever their case."""
    return sum((text.rlike(as_word(w)).cast("int") for w in words), F.lit(0))


def keyword_score(text: Column, keywords: list[str]) -> Column:
    """How many of the keywords are in the text, whatever their case."""
    low = F.lower(text)
    return sum((low.contains(k).cast("int") for k in keywords), F.lit(0))


def id_score(text: Column, ident: Column) -> Column:
    """2 if the id is in the text, 20 more if it stands alone on a line."""
    alone = F.array_contains(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), ident)
    return F.when(F.contains(text, ident), 2).otherwise(0) + F.when(alone, 20).otherwise(0)


def classify(text: Column) -> Column:
    """The first class whose pattern is in the text."""
    out = F.lit("OTHER")
    for name, pattern in reversed(CLASSES):
        out = F.when(text.rlike(as_word(pattern)), name).otherwise(out)
    return out


def class_score(cls: Column) -> Column:
    out = F.lit(CLASS_SCORE["OTHER"])
    for name, value in CLASS_SCORE.items():
        out = F.when(cls == name, value).otherwise(out)
    return out


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def supports(text: Column, quote: Column) -> Column:
    """Whether the quote is in the text, white space aside."""
    return F.contains(collapsed(text), collapsed(quote))


def letters_only(text: Column) -> Column:
    """Tags removed, then all but ASCII letters and white space, in lower case; accented letters go, on purpose."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, "<.*?>", ""), r"[^A-Za-z\s]", ""))


def without_marks(text: Column) -> Column:
    """ASCII punctuation and digits deleted, in lower case."""
    return F.lower(F.regexp_replace(text, r"[!-@\[-`{-~]", ""))


def without_urls(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), r"http\S+|www\S+", "")
    return collapsed(F.regexp_replace(bare, r"(?U)[^\w\s]", ""))


def tokens(text: Column, stop: list[str]) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: (w != "") & ~w.isin(stop))


def padded(ids: Column, width: int) -> Column:
    """An array cut or filled with zeros to a width."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), width)), 1, width)


def coherence(text: Column, doubt: str = "not confirmed") -> Column:
    """Markdown report score: headings .5, tables .1, data .2, and up to .2 as fewer lines hold the words of doubt."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    rate = F.size(F.filter(lines, lambda x: F.lower(x).contains(doubt))) / F.greatest(F.size(lines), F.lit(1))
    has = lambda w: F.lower(text).contains(w).cast("double")
    score = 0.2 * has("objective") + 0.3 * has("achieve") + 0.2 * has("data quality") + 0.1 * has("|") + F.greatest(F.lit(0.0), 0.2 * (1 - F.least(F.lit(1.0), rate / 0.25)))
    return F.when(F.size(lines) > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))).otherwise(0.0)
