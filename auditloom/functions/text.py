"""String, list and message functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_name(c: Column) -> Column:
    """Lower case with single spaces; null where blank."""
    out = F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    return F.when(out != "", out)


def quoted_name(c: Column, before: str = "named ") -> Column:
    """The first text in single quotes after ``before``, normalized; null if there is none."""
    return normalized_name(F.regexp_extract(c, rf"(?i){before}'([^']+)'", 1))


def word_set(c: Column) -> Column:
    """Distinct words of lower-case letters, digits and underscores, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9_]+)"), F.lit(1))))


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty; the last may be either."""
    return F.coalesce(*[F.when(c != "", c) for c in cols[:-1]], cols[-1])


def safe_divide(n: Column, d: Column) -> Column:
    """n / d, and 0.0 where d is 0 or null."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def share(flag: Column) -> Column:
    """Mean of a boolean, 0.0 over no rows."""
    return F.coalesce(F.avg(flag.cast("double")), F.lit(0.0))


def class_label(c: Column, allowed: list[int] | None = None) -> Column:
    """``IP`` and three digits; an error outside the allowed ids."""
    text = F.format_string("IP%03d", c)
    if allowed is None:
        return text
    return F.when(c.isin(allowed), text).otherwise(F.raise_error(F.concat(F.lit("class outside the frozen set: "), c.cast("string"))))


def image_size(c: Column) -> Column:
    """Struct of width and height from ``<w>x<h>``; null for any other text."""
    w, h = (F.regexp_extract(c, r"^(\d+)x(\d+)$", k) for k in (1, 2))
    return F.when(w != "", F.struct(w.cast("int").alias("width"), h.cast("int").alias("height")))


def has_media_suffix(url: Column, suffixes: tuple[str, ...] = ("jpg", "jpeg", "png", "webp")) -> Column:
    """The URL's path ends with one of the suffixes; the query does not count; null URLs give null."""
    return F.lower(F.try_parse_url(url, F.lit("PATH"))).rlike(r"\.(" + "|".join(suffixes) + ")$")


def keyword_bucket(c: Column, groups: dict[str, tuple[str, ...]], other: str = "other") -> Column:
    """Name of the first group of which a keyword occurs."""
    out = None
    for name, words in groups.items():
        hit = F.lower(c).rlike("|".join(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def name_at_id(ids: Column, names: Column, wanted: Column) -> Column:
    """In two ``|``-joined lists, the name at the place of ``wanted``; null if absent."""
    place = F.array_position(F.split(ids, r"\|"), wanted.cast("string"))
    return F.when(place > 0, F.try_element_at(F.split(names, r"\|"), place.cast("int")))


def strip_fence(c: Column) -> Column:
    """The inside of a text that is one code fence, else the trimmed text."""
    inner = F.regexp_extract(F.trim(c), r"(?s)^```[a-zA-Z]*\s*\n(.*?)\n?```$", 1)
    return F.when(inner != "", F.trim(inner)).otherwise(F.trim(c))


def mentions(c: Column, pattern: str = r"\b(IP[0-9]{3,9})\b") -> Column:
    """Sorted distinct matches of a bounded pattern."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(1))))


def message_text(messages: Column, roles: tuple[str, ...]) -> Column:
    """Text items of the messages of the given roles, joined by line breaks."""
    parts = F.flatten(F.transform(F.filter(messages, lambda m: m["role"].isin(*roles)), lambda m: F.transform(F.filter(m["content"], lambda c: (c["type"] == "text") & c["text"].isNotNull()), lambda c: c["text"])))
    return F.array_join(parts, "\n")


def value_span(text: Column, key: str) -> Column:
    """Start and end offsets (from 0) of a JSON key's scalar value; null unless the key occurs exactly once."""
    mark = f'"{key}":'
    once = F.regexp_count(text, F.lit(mark)) == 1
    start = F.locate(mark, text) + len(mark) - 1
    value = F.regexp_extract(text, mark + r'\s*("(?:[^"\\]|\\.)*"|[^,}\]\s]+)', 1)
    at = F.call_function("locate", value, text, start + 1) - 1
    return F.when(once & (value != ""), F.struct(at.alias("start"), (at + F.length(value)).alias("end")))


def unique_subsequence(items: Column, part: Column) -> Column:
    """Start (from 0) of the only place where ``part`` occurs in ``items``; null unless there is exactly one."""
    n, m = F.size(items), F.size(part)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(n - m + 1, F.lit(1))), lambda i: F.slice(items, i, m) == part)
    return F.when((m > 0) & (n >= m) & (F.size(starts) == 1), starts[0] - 1)


def render_prompt(template: Column, name: Column) -> Column:
    """A template with ``{name}`` replaced."""
    return F.replace(template, F.lit("{name}"), name)


def padded(text: Column, length: int) -> Column:
    """A text filled with blanks to a length; longer texts stay whole."""
    return F.when(F.length(text) >= length, text).otherwise(F.rpad(text, length, " "))
