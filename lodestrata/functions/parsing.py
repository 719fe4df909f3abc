"""Column functions that parse loosely typed text; what cannot be parsed is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a missing amount, and the accepted date formats in order.
MISSING = ["", "na", "n/a", "null", "none"]
DATE_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss.S", "M/d/yyyy hh:mm:ss a", "yyyy-MM-dd"]


def money(x: Column) -> Column:
    bare = F.replace(F.trim(x), F.lit(","), F.lit(""))
    return F.when(~F.lower(F.trim(x)).isin(MISSING), bare.try_cast("double"))


def moment(x: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in DATE_FORMATS]).cast("timestamp_ntz")


def first_filled(*xs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in xs])


def first_of(x: Column) -> Column:
    """First element of a JSON list, or the scalar itself."""
    return F.when(x.startswith("["), F.get(F.from_json(x, "array<string>"), 0)).otherwise(x)


def compact_date(x: Column) -> Column:
    """YYYYMMDD -> YYYY-MM-DD; other lengths as they are."""
    return F.when(F.length(x) == 8, F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2))).otherwise(x)


def number_key(x: Column) -> Column:
    return F.replace(F.trim(x), F.lit(","), F.lit("")).try_cast("double")


def date_key(x: Column) -> Column:
    return F.substring(x.cast("string"), 1, 10)


def field_path(x: Column) -> Column:
    return F.substring_index(x, ".citations[", 1)


def json_path(doc: Column, path: Column) -> Column:
    """Value at a dotted path with [i]; null where there is none."""
    return F.call_function("get_json_object", doc, F.concat(F.lit("$."), path))


def millions_to_usd(x: Column) -> Column:
    return F.format_number(F.round(F.replace(x, F.lit(","), F.lit("")).try_cast("double") * 1_000_000), 0)


def repaired_json(x: Column) -> Column:
    """The text if it is a JSON object, else its outermost braces if they hold one, else null."""
    outer = F.regexp_extract(x, r"(?s)\{.*\}", 0)
    whole = F.trim(x)
    is_object = lambda t: t.startswith("{") & F.try_parse_json(t).isNotNull()
    return F.when(is_object(whole), whole).when(is_object(outer), outer)


def sorted_params(m: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
