"""Column functions that read facts out of the lines of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.parsing import millions_to_usd

#: Glyphs that start an item, and labels of amounts in millions.
BULLETS = "[•■▪●◦‣►]"
AMOUNTS = {"total_cost": r"(?i)Total Operation Cost\s+([\d,]+\.\d+)", "financing": r"(?i)Total Financing\s+([\d,]+\.\d+)", "bank": r"(?i)Total Bank financing:?\s+([\d,]+\.\d+)"}
THIRD = r"(?im)^{label}:\s+[\d,.]+\s+[\d,.]+\s+([\d,.]+)"


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def amount(text: Column, name: str) -> Column:
    """A labelled amount in millions as dollars with separators; null if there is none."""
    return millions_to_usd(F.nullif(F.regexp_extract(text, AMOUNTS[name], 1), F.lit("")))


def third_amount(text: Column, label: str) -> Column:
    """The third number of a labelled row of three."""
    return millions_to_usd(F.nullif(F.regexp_extract(text, THIRD.format(label=label), 1), F.lit("")))


def after_label(lines: Column, label: str, skip: int = 1) -> Column:
    """The line that follows a label's; null if the label or the line is missing."""
    at = F.array_position(F.transform(lines, F.lower), label.lower())
    return F.when(at > 0, F.get(lines, at.cast("int") + skip - 1))


def between(text: Column, start: str, end: str) -> Column:
    """What stands between two marks, its lines joined; null if either is missing or nothing does."""
    low = F.lower(text)
    a, b = F.locate(start, low), F.locate(end, low)
    inside = F.substring(text, a + len(start), b - a - len(start))
    return F.when((a > 0) & (b > a), F.nullif(F.array_join(lines_of(inside), " "), F.lit("")))


def header(line: Column) -> Column:
    """region | practice -> struct, the region in title case."""
    parts = F.split(line, r"\|")
    return F.struct(F.initcap(F.trim(F.get(parts, F.lit(0)))).alias("region"), F.trim(F.get(parts, F.lit(1))).alias("practice"))


def rating(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, BULLETS, " "), r"\s+", " "))


def current_rating(lines: Column, label: str) -> Column:
    """The second of up to two lines after a label, or the first if there is one."""
    return rating(F.coalesce(after_label(lines, label, 2), after_label(lines, label, 1)))


def indicators(text: Column) -> Column:
    """array<struct<name, unit, baseline, achieved, target>> of the bulleted blocks that have four values."""
    def block(b: Column) -> Column:
        ls = lines_of(b)
        head = F.get(ls, F.lit(0))
        values = F.regexp_extract_all(F.regexp_extract(b, r"(?s)Value\s+((?:[\d,.]+\s+){3}[\d,.]+)", 1), F.lit(r"[\d,.]+"), F.lit(0))
        v = lambda k: F.replace(F.get(values, F.lit(k)), F.lit(","), F.lit("")).try_cast("double")
        return F.when(F.size(values) >= 4, F.struct(F.trim(F.regexp_extract(head, r"^([^(]+)", 1)).alias("name"), F.regexp_extract(head, r"\(([^,)]+)", 1).alias("unit"), v(0).alias("baseline"), v(2).alias("achieved"), v(3).alias("target")))
    return F.filter(F.transform(F.split(text, BULLETS), block), lambda x: x.isNotNull())


def rating_of(lines: Column, label: str, labels: list[str]) -> Column:
    """The rating of a label: the second of up to two lines after it that are no labels themselves, or the first if it is
    alone; without any, what stands behind the label in its own line."""
    known = [x.lower() for x in labels]
    own = lambda k: F.when(~F.lower(after_label(lines, label, k)).isin(known), after_label(lines, label, k))
    first = own(1)
    inline = F.array_max(F.filter(F.transform(lines, lambda x: F.nullif(F.regexp_extract(x, rf"(?i)^{label}\s*:\s*(.+)$", 1), F.lit(""))), lambda x: x.isNotNull()))
    return rating(F.coalesce(F.when(first.isNotNull(), own(2)), first, inline))


def dates_of(lines: Column, labels: list[str]) -> Column:
    """map<label, yyyy-MM-dd>: labels that stand in a row of lines, with the lines after them in the same order; a line that
    is no day (d-Mon-yyyy) gives null."""
    last = F.array_max(F.array(*[F.array_position(F.transform(lines, F.lower), x.lower()) for x in labels]))
    day = lambda i: F.date_format(F.try_to_timestamp(F.get(lines, (last + i).cast("int")), F.lit("d-MMM-yyyy")), "yyyy-MM-dd")
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.array(*[day(i) for i in range(len(labels))]))
