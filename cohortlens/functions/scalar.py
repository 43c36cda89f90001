"""Scalar column functions: guarded logarithms, missing values, names and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the layout of archive members; the groups are group, condition, subject and channel.
MEMBER = r"^EEG_data/(AD|Healthy)/(Eyes_closed|Eyes_open)/(Paciente\d+)/([^/]+)\.txt$"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def is_finite(x: Column) -> Column:
    """True for a finite number, false for NaN and infinities, null for null."""
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def safe_log10(x: Column) -> Column:
    """log10 of a positive finite number, else null."""
    return F.when((x > 0) & is_finite(x), F.log10(x))


def safe_log_ratio(a: Column, b: Column) -> Column:
    """log10(a / b) where both are positive and finite, else null."""
    return F.when((a > 0) & (b > 0) & is_finite(a) & is_finite(b), F.log10(a / F.when(b > 0, b)))


def label_or_raw(column: Column, mapping: dict[str, str]) -> Column:
    """The mapped label, or the value itself if the mapping does not have it."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), column), column) if pairs else column


def without_prefix(column: Column, prefix: str) -> Column:
    return F.when(column.startswith(prefix), F.substr(column, F.lit(len(prefix) + 1))).otherwise(column)


def is_safe_member(name: Column) -> Column:
    """Whether an archive member's name is relative, has no \\ or :, and no empty, . or .. segment."""
    bad = F.exists(F.split(name, "/"), lambda s: s.isin("", ".", ".."))
    return F.coalesce((F.length(name) > 0) & ~name.contains("\\") & ~name.contains(":") & ~bad, F.lit(False))


def member_parts(name: Column) -> Column:
    """group, condition, subject and channel of a member's name; null if it has another layout."""
    fields = [F.regexp_extract(name, MEMBER, k + 1).alias(n) for k, n in enumerate(("group", "condition", "subject", "channel"))]
    return F.when(name.rlike(MEMBER), F.struct(*fields))


def natural_number(name: Column) -> Column:
    """The first run of digits as a number, for natural order; null without one."""
    return F.nullif(F.regexp_extract(name, r"\d+", 0), F.lit("")).cast("long")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1)))


def collapsed(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def emails(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({EMAIL})"), F.lit(1)))


def numeric_tokens(text: Column) -> Column:
    """Distinct numbers of a text as written: digits with an optional decimal part."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1))))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """The Wilson interval of k successes in n as a struct (low, high); null where n is not positive."""
    n = F.when(n > 0, n.cast("double"))
    p = k / n
    mid = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.struct(((mid - half) / scale).alias("low"), ((mid + half) / scale).alias("high"))


def fixed(x: Column, places: int = 3) -> Column:
    """A number as text with that many places."""
    return F.format_string(f"%.{places}f", x.cast("double"))


def scientific(x: Column, places: int = 2) -> Column:
    """A number as text with one digit before the point and an exponent of two digits at least."""
    return F.format_string(f"%.{places}e", x.cast("double"))


def title_of(name: Column) -> Column:
    """A feature's name for people: blanks for underscores, each word with a capital letter."""
    return F.initcap(F.regexp_replace(name, "_+", " "))


def json_equal(a: Column, b: Column, ignore: tuple[str, ...] = ()) -> Column:
    """Whether two JSON objects have the same top-level keys with the same values as text, but for the ignored keys."""
    of = lambda c: F.map_filter(F.from_json(c, "map<string,string>"), lambda k, _: ~k.isin(*ignore))
    entries = lambda c: F.array_sort(F.map_entries(of(c)))
    return entries(a).eqNullSafe(entries(b))
