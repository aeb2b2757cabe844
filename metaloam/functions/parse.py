"""Fields of loosely formatted answers, candidate lists and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def loose_fields(text: Column, names: tuple[str, ...]) -> Column:
    """``key: value`` pairs in braces, quoted or not, to a struct; fields go by position, N/A where one is missing."""
    body = F.regexp_extract(text, r"(?s)\{(.*?)\}", 1)
    found = F.regexp_extract_all(body, F.lit(r"[\"']?\w[\w -]*[\"']?\s*:\s*[\"']?([^\"',}]*)"), F.lit(1))
    return F.struct(*(F.coalesce(F.nullif(F.trim(F.get(found, F.lit(i))), F.lit("")), F.lit("N/A")).alias(n) for i, n in enumerate(names)))


def json_fields(text: Column, fields: dict[str, tuple[str, ...]]) -> Column:
    """A struct of JSON fields that may go by several names; null if the text is no JSON or a field is missing."""
    values = {n: F.coalesce(*(F.get_json_object(text, f"$.{k}") for k in keys)) for n, keys in fields.items()}
    whole = None
    for v in values.values():
        whole = v.isNotNull() if whole is None else whole & v.isNotNull()
    return F.when(whole, F.struct(*(v.alias(n) for n, v in values.items())))


def candidates(text: Column) -> Column:
    """``id:p;id:p`` to an array of structs; an id may hold colons, the last one parts."""
    parts = F.filter(F.split(text, ";"), lambda x: F.contains(x, F.lit(":")))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, "^(.*):[^:]*$", 1).alias("term"), F.regexp_extract(x, ":([^:]*)$", 1).try_cast("double").alias("p")))


def grouped_integer(text: Column) -> Column:
    """``1,234`` to 1234."""
    return F.replace(F.regexp_extract(text, r"(\d{1,3}(?:,\d{3})+|\d+)", 1), F.lit(","), F.lit("")).try_cast("bigint")


def seed_of(label: Column) -> Column:
    """The number after ``seed`` in a name."""
    return F.regexp_extract(label, r"(?i)seed[_-]?(\d+)", 1).try_cast("int")


def named_parts(name: Column, pattern: str, names: tuple[str, ...]) -> Column:
    """A map of the groups of a pattern; empty where a file name does not fit."""
    entries = [F.struct(F.lit(n).alias("k"), F.regexp_extract(name, pattern, i + 1).alias("v")) for i, n in enumerate(names)]
    return F.when(name.rlike(pattern), F.map_from_entries(F.array(*entries))).otherwise(F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>")))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scaled to 0 to 1; all 1 where the range is empty."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(1.0))


def rescaled(value: Column, low: Column, high: Column, new_low: float, new_high: float) -> Column:
    return F.when(high > low, F.lit(new_low) + (value - low) / (high - low) * (new_high - new_low)).otherwise(F.lit(new_high))


def right_closed_bin(x: Column, edges: tuple[float, ...]) -> Column:
    """``(a,b]`` labels, ``else`` outside all of them."""
    out = F
    for a, b in zip(edges, edges[1:], strict=False):
        out = out.when((x > a) & (x <= b), F.lit(f"({a:g},{b:g}]"))
    return out.otherwise("else")
