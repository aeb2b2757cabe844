"""Numbers with units, coordinates, distances and bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metaloam.functions.text import is_missing

EARTH_KM = 6371.0


def unit_class(value: Column) -> Column:
    """The first class that fits, in the order of the tests."""
    v = F.lower(F.trim(value))
    return (
        F.when(is_missing(value), "missing")
        .when(v.rlike(r"^sea[ _-]?level\.?$"), "sea_level")
        .when(v.rlike(r"\bm\.?a\.?s\.?l\b|masl"), "masl")
        .when(v.rlike(r"\d\s*(ft|feet|foot)\b"), "feet")
        .when(v.rlike(r"\d\s*km\b"), "km")
        .when(v.rlike(r"\d\s*cm\b"), "cm")
        .when(v.rlike(r"\d\s*(m|meters?|metres?)\b"), "meters")
        .when(v.rlike(r"^[+-]?\d+([.,]\d+)*$"), "bare_number")
        .when(v.rlike(r"\d\s*(-| to )\s*\d"), "range_or_composite")
        .otherwise("other")
    )


def parse_number(value: Column) -> Column:
    """The first number. A comma without a dot is a decimal comma, so 12,000 is 12; else commas are dropped."""
    first = F.nullif(F.regexp_extract(value, r"([+-]?\d[\d.,]*)", 1), F.lit(""))
    plain = F.when(F.contains(first, F.lit(",")) & ~F.contains(first, F.lit(".")), F.replace(first, F.lit(","), F.lit("."))).otherwise(F.replace(first, F.lit(","), F.lit("")))
    return plain.try_cast("double")


def to_metres(value: Column, unit: Column) -> Column:
    x = parse_number(value)
    return F.when(unit == "sea_level", F.lit(0.0)).when(unit == "feet", x * 0.3048).when(unit == "km", x * 1000).when(unit == "cm", x / 100).when(unit.isin("meters", "masl", "bare_number"), x)


def depth_to_metres(value: Column, unit: Column) -> Column:
    """As to_metres, for the classes of depth_class; an unknown unit leaves the number."""
    x = parse_number(value)
    return F.when(unit == "inches", x * 0.0254).when(unit == "mm", x / 1000).when(unit.isin("mbsl", "mbsf", "bgs"), x).otherwise(F.coalesce(to_metres(value, unit), x))


def plausible(metres: Column, most: float = 10_000) -> Column:
    return metres.between(0, most)


def dms_to_decimal(text: Column) -> Column:
    """Degrees, minutes and seconds, or decimal degrees with a hemisphere, to signed degrees; decimal commas count.

    A hemisphere is one of N, S, E, W, or its word, that stands alone or beside a number.
    """
    t = F.regexp_replace(F.upper(text), r"(\d),(\d)", "$1.$2")
    n = F.regexp_extract_all(t, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    part = [F.coalesce(F.get(n, i).try_cast("double"), F.lit(0.0)) for i in range(3)]
    size = part[0] + part[1] / 60 + part[2] / 3600
    negative = t.rlike(r"(^|[^A-Z])(S|W|SOUTH|WEST)([^A-Z]|$)|^\s*-")
    return F.when(F.size(n) == 0, None).otherwise(F.when(negative, -size).otherwise(size))


def depth_class(value: Column) -> Column:
    """As unit_class, with inches, millimetres and depths below the sea's level, its floor or the ground; glued units count."""
    v = F.lower(F.trim(value))
    return (
        F.when(v.rlike(r"\d\s*mbsl\b"), "mbsl")
        .when(v.rlike(r"\d\s*mbsf\b"), "mbsf")
        .when(v.rlike(r"\bbgs\b"), "bgs")
        .when(v.rlike(r"\d\s*(in|inch|inches)\b"), "inches")
        .when(v.rlike(r"\d\s*mm\b"), "mm")
        .otherwise(unit_class(value))
    )


def key_group(key: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """The group whose list has the key, null for none."""
    return F.coalesce(*(F.when(key.isin(*keys), F.lit(name)) for name, keys in groups.items()))


def valid_coordinate(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def left_closed_bin(x: Column, edges: list[float]) -> Column:
    """``[a,b)`` labels; null outside all of them."""
    out = None
    for a, b in zip(edges, edges[1:], strict=False):
        own = (x >= a) & (x < b)
        out = F.when(own, F.lit(f"[{a:g},{b:g})")) if out is None else out.when(own, F.lit(f"[{a:g},{b:g})"))
    return out


def clock_seconds(text: Column) -> Column:
    """``3' 17''`` to seconds."""
    return F.regexp_extract(text, r"(\d+)\s*'(?!')", 1).try_cast("int") * 60 + F.coalesce(F.regexp_extract(text, r"(\d+)\s*''", 1).try_cast("int"), F.lit(0))
