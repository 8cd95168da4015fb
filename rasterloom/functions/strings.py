"""Names, keys and hashes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that mean a switch is on or off.
TRUE_WORDS, FALSE_WORDS = ("1", "true", "yes", "y", "on"), ("0", "false", "no", "n", "off")


def sanitized(s: Column) -> Column:
    """Letters, digits and single underscores; ``item`` for what has none."""
    t = F.regexp_replace(F.regexp_replace(s, r"[^0-9a-zA-Z_]+", "_"), r"_+", "_")
    t = F.regexp_replace(t, r"^_+|_+$", "")
    return F.when(F.coalesce(t, F.lit("")) == "", "item").otherwise(t)


def dim_suffix(s: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(s, r"[^0-9a-zA-Z]", "_"), r"^_+|_+$", "")
    return F.when(F.coalesce(t, F.lit("")) == "", "var").otherwise(t)


def canonical(s: Column, aliases: dict[str, str]) -> Column:
    """Trimmed, lower case, an alias replaced."""
    k = F.lower(F.trim(s))
    if not aliases:
        return k
    m = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(m[k], k)


def or_auto(s: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(s)), F.lit("")), F.lit("auto"))


def csv_list(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")


def wanted_list(s: Column, what: str) -> Column:
    """:func:`csv_list`, and an error where nothing is listed."""
    items = csv_list(s)
    return F.when(F.size(items) > 0, items).otherwise(F.raise_error(F.lit(f"no {what}")).cast("array<string>"))


def value_range(s: Column) -> Column:
    """``lo,hi`` as ``struct(lo, hi)``; null unless there are two numbers."""
    p = csv_list(s)
    n = lambda i: F.try_element_at(p, F.lit(i)).try_cast("double")
    return F.when((F.size(p) == 2) & n(1).isNotNull() & n(2).isNotNull(), F.struct(n(1).alias("lo"), n(2).alias("hi")))


def switch(s: Column) -> Column:
    k = F.lower(F.trim(s))
    number = k.try_cast("int")
    return F.when(k.isin(*TRUE_WORDS), True).when(k.isin(*FALSE_WORDS), False).when(number.isNotNull(), number != 0)


def wanted_switch(s: Column, key: str) -> Column:
    """:func:`switch`, and an error for a text that is none; null stays null."""
    return F.when(s.isNull() | switch(s).isNotNull(), switch(s)).otherwise(F.raise_error(F.concat(F.lit(f"{key} is no switch: "), s)).cast("boolean"))


def sensor_key(fields: list[str]) -> Column:
    """12 hex digits of the sha1 of the fields' JSON, sorted by name."""
    return F.substring(F.sha1(F.to_json(F.struct(*sorted(fields)))), 1, 12)


def input_key(sensor: Column, semantics: Column) -> Column:
    return F.when(F.coalesce(semantics, F.lit("single")) == "single", sensor).otherwise(F.concat(sensor, F.lit("--"), sanitized(semantics)))


def fingerprint(*parts: Column) -> Column:
    """What a request is, for resuming: sha1 over its parts, null told apart from empty."""
    return F.sha1(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]))


def point_key(lon: Column, lat: Column, decimals: int = 4) -> Column:
    return F.format_string(f"%.{decimals}f|%.{decimals}f", lon, lat)
