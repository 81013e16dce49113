"""Problem 3: text values that were cut off.

A stack automaton reads each text: brackets, quoted strings with escapes, code
fences and tags. What it cannot decide alone (a last sentence without a full stop,
an open tag, a value that ends inside a word) is held against baselines of the whole table: how
often texts of the same source that open alike end with a terminator, and which words
and values the same field holds elsewhere.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, salted_join
from ..session import checkpoint

PAD = " \t\r\n\f\v\x00 ­​‌‍⁠　﻿"
_EOS = re.compile(r"(?:</s>|<\|[a-z_]+\|>|<eos>|<end_of_turn>)$")
# What marks of a missing rest say between their brackets.
_STRONG_MARK = re.compile(r"\s*(?:\+\s*\d+\b.*|(?:cut|snip|length)\s*(?:[:=].*)?|(?:max[_ ]?tokens|token limit)\b.*|(?:(?:text|output|answer|response|message)\s+)?(?:truncated|cut off|cut short|snipped|clipped)\s*(?:(?:[:;,.=–-]|\d|at|after|by|because|due to|here)\b.*|[:;,.=–-].*)?|(?:finish|stop)[_ ]reason\s*[:=]\s*\W?length\W?)\s*", re.I | re.S)
_TOKEN = re.compile(r"```|\\.|[\"'{}\[\]]|</?[A-Za-z][\w-]*>", re.S)
_NEXT = re.compile(r"\s*(```|.)?", re.S)
_KEY_AHEAD = re.compile(r"\s*(?:[\"'{}\[\]]|[\w-]+\s*[:=]|$)")
_ITEM_AHEAD = re.compile(r"\s*(?:[\"'{\[]|$)")
_HALF_OPEN = re.compile(r"\[\s*[^\s,\[\](){}\"']+\s*,\s*[^\s,\[\](){}\"']+\s*\)")
_TERMINATORS = frozenset(".!?:。！？：؟।")
_CLOSERS = "\"'”’»」』)]}）*_`"
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_AFTER_STRING = frozenset(",:]}")
_BEFORE_STRING = frozenset("{[,:")
_BEFORE_STRUCTURE = frozenset(":={([,>`\n")

#: An unfinished sentence is a cut if at least this share of the texts that open alike end with a terminator.
ENDED_SHARE = 0.3
#: A source with at least so many texts that open alike has a baseline of its own; fewer are held against all sources.
SOURCE_TEXTS = 20
#: Source key under which the texts of all sources are counted.
POOLED = "*"
#: A value is cut if longer words or values that begin with it are this many times as frequent in its field.
LONGER_RATIO = 5
#: Fields under which first words are counted: of all running texts, and of those that are one word.
FIRST, ALONE = "^", "^1"
#: Up to this length every beginning of a value is counted; longer beginnings at the lengths of values only.
HEAD_CHARS = 64


def _without_mark(text: str) -> str | None:
    """The text before a bracketed mark at its end that says something is missing, or None."""
    at = max(text.rfind("["), text.rfind("<"), text.rfind("("))
    return text[:at] if at >= 0 and _STRONG_MARK.fullmatch(text, at + 1, len(text) - 1) else None


def _without_dots(text: str) -> str | None:
    """The text before marks of omission at its end (dots, also in brackets), or None."""
    if text.endswith("…"):
        return text[:-1]
    bare = text.rstrip(".")
    if len(text) - len(bare) >= 3:
        return bare
    at = text.rfind("[") if text.endswith("]") else -1
    inner = text[at + 1 : -1].strip() if at >= 0 else ""
    return text[:at] if inner and not inner.strip("….") and ("…" in inner or len(inner) >= 3) else None


def strip_end(text: str) -> tuple[str, bool, bool]:
    """The text without padding and marks at its end; whether a mark says outright that something was cut, or hints at it."""
    strong = weak = False
    while True:
        text = text.rstrip(PAD)
        last = text[-1:]
        if last == ">" and (m := _EOS.search(text)):
            text = text[: m.start()]
        elif last in (">", "]", ")") and (before := _without_mark(text)) is not None:
            text, strong = before, True
        elif last in (".", "…", "]") and (before := _without_dots(text)) is not None:
            text, weak = before, True
        else:
            return text, strong, weak


def _opening(text: str) -> tuple[str, str]:
    """(key of the first word, key used for the text): two words where the text has at least three."""
    if _CJK.match(text):
        return text[:2], text[:4]
    words = [_DIGITS.sub("0", w.lower()) for w in text.split(None, 3)[:3]]
    return (words[0], " ".join(words[:2]) if len(words) > 2 else words[0]) if words else ("", "")


def _sentence_ended(text: str) -> bool:
    core = text.rstrip(_CLOSERS)
    return bool(core) and core[-1] in _TERMINATORS


class _Members(list):
    """The members of an object, repeats and order kept."""


_DECODER = json.JSONDecoder(object_pairs_hook=_Members, strict=False)


def _parsed(text: str) -> list[tuple[str, str]] | None:
    """The string values by field of a text that is one sound JSON value; None for any other."""
    if text[:1] not in ("{", "[") or text[-1:] not in ("}", "]"):
        return None
    try:
        todo = [("", _DECODER.decode(text))]
    except (ValueError, RecursionError):
        return None
    values = []
    while todo:
        field, x = todo.pop()
        if isinstance(x, str):
            values.append((field, x))
        elif isinstance(x, _Members):
            todo.extend(reversed(x))
        elif isinstance(x, list):
            todo.extend((field, y) for y in reversed(x))
    return values


def _last_sign(text: str, end: int) -> str:
    """The last sign before ``end`` that is no blank (a line break counts as a sign); empty at the beginning."""
    while end and text[end - 1] in " \t\r":
        end -= 1
    return text[end - 1] if end else ""


def _opens(text: str, at: int) -> bool:
    """A bracket in running text opens a structure: it stands where one begins, or keys or values follow."""
    if text[at] == "[" and _HALF_OPEN.match(text, at):
        return False
    before = _last_sign(text, at)
    return not before or before in _BEFORE_STRUCTURE or (_KEY_AHEAD if text[at] == "{" else _ITEM_AHEAD).match(text, at + 1) is not None


class Structure(NamedTuple):
    """What the stack automaton finds in a text."""

    left_open: bool
    end: int  # of the last structure that was closed
    values: list[tuple[str, str]]  # string values by field
    tags: list[tuple[str, bool]]  # markup tags by name, and whether they were closed


def structure(text: str) -> Structure:
    """Runs the stack automaton over the whole text.

    Left open may be a bracket, a string, an escape or a code fence. Brackets of
    running text (half-open intervals, placeholders) open nothing. Tags are reported
    with their fate, since some are never closed: it takes the baseline of the source
    to tell. A text that is one sound JSON value needs no automaton.
    """
    whole = _parsed(text.strip())
    if whole is not None:
        return Structure(False, len(text), whole, [])
    stack: list[str] = []  # the field in which each open bracket stands
    tags: list[str] = []
    closed: set[str] = set()
    values: list[tuple[str, str]] = []
    quote, start, end, fence, field = "", 0, 0, False, ""
    for m in _TOKEN.finditer(text):
        t = m.group()
        if quote:
            if t == quote:
                after = _NEXT.match(text, m.end()).group(1)
                if not after or after in _AFTER_STRING or after == "```":
                    body = text[start : m.start()]
                    if "\\" in body:
                        try:
                            body = json.loads(f'"{body}"')
                        except ValueError:
                            pass
                    if after == ":":
                        field = body
                    else:
                        values.append((field, body))
                    quote = ""
        elif t[0] == "\\":
            continue
        elif stack:
            if t == '"' or t == "'" and _last_sign(text, m.start()) in (*_BEFORE_STRING, "\n"):
                quote, start = t, m.end()
            elif t in "{[":
                stack.append(field)
            elif t in "}]":
                field = stack.pop()
                if not stack:
                    end = m.end()
        elif t in "{[":
            if _opens(text, m.start()):
                stack.append(field)
        elif t == "```":
            fence, end = not fence, m.end()
        elif t[0] == "<":
            name = t.strip("</>").lower()
            if t[1] != "/":
                tags.append(name)
            elif name in tags:
                end = m.end()
                closed.add(name)
    return Structure(bool(stack or quote or fence), end, values, [(n, n in closed) for n in dict.fromkeys(tags)])


def scan(text: str) -> tuple[bool, list[tuple[str, str, bool]], list[tuple[str, str]]]:
    """(cut for certain, what should end as (first-word key, opening key, ended), values as (field, value)).

    What should end are the running text, each text value inside, and each tag (under
    its name as key).
    """
    core, strong, weak = strip_end(text)
    if not core:
        return False, [], []
    if strong or core[-1] == "�":
        return True, [], []
    found = structure(core)
    if found.left_open:
        return True, [], []
    prose, short = [(f"<{name}", f"<{name}", closed) for name, closed in found.tags], []
    end = found.end
    tail = core[end:].strip(PAD)
    if end and core[end:].strip(PAD + "`") == "":
        tail = ""
    if tail:
        first, key = _opening(tail)
        prose.append((first, key, _sentence_ended(tail)))
        word = re.sub(r"\W+$", "", first)
        short.append((FIRST, word))
        if end == 0 and not _SPACE.search(tail):
            short.append((ALONE, word))
    for field, value in found.values:
        inner, inner_strong, _ = strip_end(value)
        if inner_strong or inner[-1:] == "�":
            return True, [], []
        if not inner:
            continue
        if " " in inner or _CJK.match(inner):
            first, key = _opening(inner)
            prose.append((first, key, _sentence_ended(inner)))
        short.append((field, inner))
    return False, prose, [x for x in short if x[1]]


_SCHEMA = "text_id string, sources array<string>, counts array<long>, cut boolean, prose array<struct<first string, opening string, ended boolean>>, short array<struct<field string, value string>>"


def _scan_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [scan(t) for t in pdf.raw_text]
        yield pd.DataFrame({"text_id": pdf.text_id, "sources": pdf.sources, "counts": pdf.counts, "cut": [x[0] for x in found], "prose": [[{"first": a, "opening": b, "ended": c} for a, b, c in x[1]] for x in found], "short": [[{"field": a, "value": b} for a, b in x[2]] for x in found]})


def text_id() -> F.Column:
    return F.sha2(F.col("raw_text").cast("binary"), 256)


def source_key() -> F.Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))


def _prefixes(name: str) -> F.Column:
    """The proper prefixes of a string column, up to HEAD_CHARS."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.length(name) - 1, F.lit(HEAD_CHARS)), F.lit(1))), lambda k: F.substring(F.col(name), F.lit(1), k))


def _long_beginnings(vals: DataFrame) -> DataFrame:
    """(field, value) of the values over HEAD_CHARS that begin values LONGER_RATIO times as frequent.

    Beginnings are compared by digest, at the lengths that values of the same field
    and head have; values of a head that many share are spread over tasks.
    """
    long = checkpoint(vals.filter(F.length("value") > HEAD_CHARS).select(F.struct("field", F.substring("value", 1, HEAD_CHARS).alias("head")).alias("k"), "value", "n", F.length("value").alias("size")))
    lengths = long.groupBy("k").agg(F.collect_set("size").alias("sizes"), F.count("*").alias("rows")).filter(F.size("sizes") > 1)
    lengths = checkpoint(lengths)
    met = salted_join(long, lengths.select("k", "sizes"), "k", hot_keys(lengths, "k", "rows"), F.col("value"))
    digest = lambda size: F.sha2(F.substring("value", F.lit(1), size).cast("binary"), 256)
    longer = met.filter("n >= 3").select("k", "value", "n", F.explode(F.filter("sizes", lambda x: x < F.col("size"))).alias("at")).select("k.field", digest(F.col("at")).alias("d"), "n").groupBy("field", "d").agg(F.sum("n").alias("longer"))
    return met.select("k.field", "value", "n", digest(F.col("size")).alias("d")).join(longer, ["field", "d"]).filter(F.col("longer") >= LONGER_RATIO * F.col("n")).select("field", "value")


def _cut_values(vals: DataFrame) -> DataFrame:
    """(field, value) whose text is the beginning of far more frequent values, or whose last word is that of words."""

    def longer(counts: DataFrame, what: str) -> DataFrame:
        return counts.filter((F.col("n") >= 3) & (F.length(what) > 1)).select("field", F.explode(_prefixes(what)).alias(what), "n").groupBy("field", what).agg(F.sum("n").alias("longer"))

    # a text of one word is cut if that is the beginning of words with which texts begin
    prefixes = longer(vals, "value")
    alone = prefixes.filter(F.col("field") == FIRST).withColumn("field", F.lit(ALONE))
    whole = vals.filter(F.col("field") != FIRST).join(prefixes.filter(F.col("field") != ALONE).union(alone), ["field", "value"]).filter(F.col("longer") >= LONGER_RATIO * F.col("n")).select("field", "value")
    words = vals.filter(~F.col("field").isin(FIRST, ALONE)).select("field", F.explode(F.array_distinct(F.split("value", " "))).alias("word"), "n").filter("word <> ''").groupBy("field", "word").agg(F.sum("n").alias("n"))
    broken = words.join(longer(words, "word"), ["field", "word"]).filter(F.col("longer") >= LONGER_RATIO * F.col("n")).select("field", "word")
    last = vals.filter(F.col("value").contains(" ") & ~F.col("field").isin(FIRST, ALONE)).select("field", "value", F.substring_index("value", " ", -1).alias("word"))
    return whole.union(last.join(broken, ["field", "word"], "left_semi").select("field", "value")).union(_long_beginnings(vals)).distinct()


def cut_texts(answers: DataFrame) -> DataFrame:
    """(text_id, source, n) of each distinct raw_text that was cut off, per source_key; n is the number of the source's rows that bear it.

    Padding, end-of-sequence tokens and marks of omission at the end are taken off
    first. Cut are: an open bracket of a structure, string, escape or fence; half a
    character (the replacement sign) or a mark that says so at the end; a tag left
    open that is usually closed in that source, or a last sentence without terminator
    whose opening usually ends with one there (in all sources, where that one has
    fewer than SOURCE_TEXTS such texts); a value inside that ends in such a sentence,
    or in the beginning of a word or value that its field holds at least LONGER_RATIO
    times as often, whatever its length. Null, empty and blank texts
    are not cut. All counts are over all distinct texts; an empty table gives no rows.
    """
    texts = answers.filter("raw_text IS NOT NULL").groupBy("raw_text", source_key().alias("source")).agg(F.count("*").alias("n"))
    distinct = texts.groupBy("raw_text").agg(F.collect_list(F.struct("source", "n")).alias("by")).select(text_id().alias("text_id"), F.col("by.source").alias("sources"), F.col("by.n").alias("counts"), "raw_text")
    seen = checkpoint(distinct.mapInPandas(_scan_batches, _SCHEMA))
    per_source = lambda df: df.select("text_id", F.explode(F.arrays_zip("sources", "counts")).alias("_by")).select("text_id", "_by.sources", "_by.counts").toDF("text_id", "source", "n")
    prose = seen.filter("NOT cut").select("text_id", "sources", "counts", F.explode("prose").alias("p"))
    keys = prose.select(F.explode(F.array_distinct(F.array("p.first", "p.opening"))).alias("opening"), "p.ended", "sources").select("opening", "ended", F.explode(F.array_append("sources", POOLED)).alias("source"))
    openings = checkpoint(keys.groupBy(F.struct("opening", "source").alias("k")).agg(F.count_if("ended").alias("ended"), F.count_if(~F.col("ended")).alias("unended")))
    pooled = openings.filter(F.col("k.source") == POOLED).select(F.col("k.opening").alias("opening"), F.col("ended").alias("all_ended"), F.col("unended").alias("all_unended"))
    own = F.col("ended") + F.col("unended") >= SOURCE_TEXTS
    base = checkpoint(openings.filter(F.col("k.source") != POOLED).withColumn("opening", F.col("k.opening")).join(pooled, "opening").select("k", "unended", F.when(own, F.col("ended")).otherwise(F.col("all_ended")).alias("e"), F.when(own, F.col("unended")).otherwise(F.col("all_unended")).alias("u")))
    runs_on = base.filter((F.col("e") > 0) & (F.col("e") >= ENDED_SHARE * (F.col("e") + F.col("u"))))
    unended = prose.filter("NOT p.ended").select("text_id", F.col("p.opening").alias("opening"), F.explode(F.arrays_zip("sources", "counts")).alias("by")).select("text_id", F.col("by.sources").alias("source"), F.col("by.counts").alias("n"), F.struct("opening", F.col("by.sources").alias("source")).alias("k"))
    by_prose = salted_join(unended, runs_on.select("k"), "k", hot_keys(base, "k", "unended"), F.col("text_id"), "left_semi").select("text_id", "source", "n")
    short = seen.filter("NOT cut").select("text_id", "sources", "counts", F.explode(F.array_distinct("short")).alias("s")).select("text_id", "sources", "counts", F.struct("s.field", "s.value").alias("s"))
    vals = checkpoint(short.groupBy("s").agg(F.count("*").alias("n")).select("s.field", "s.value", "n"))
    bad = checkpoint(_cut_values(vals).join(vals, ["field", "value"]).select(F.struct("field", "value").alias("s"), "n"))
    by_value = salted_join(short, bad.select("s"), "s", hot_keys(bad, "s", "n"), F.col("text_id"), "left_semi")
    return per_source(seen.filter("cut")).union(by_prose).union(per_source(by_value)).distinct()


def cut_answers(predictions: DataFrame) -> DataFrame:
    """(id, attempt, source) of each delivered answer that was cut off, repeats included."""
    bad = checkpoint(cut_texts(predictions).select(F.struct("text_id", "source").alias("k"), "n"))
    rows = predictions.filter("raw_text IS NOT NULL").select("id", "attempt", "source", F.struct(text_id().alias("text_id"), source_key().alias("source")).alias("k"))
    return salted_join(rows, bad.select("k"), "k", hot_keys(bad, "k", "n"), F.concat_ws("/", "id", "attempt"), "left_semi").select("id", "attempt", "source")


def truncation_report(predictions: DataFrame) -> DataFrame:
    """Answers ((id, attempt) once per source) and the share cut off, per source; null sources are a group."""
    cut = cut_answers(predictions).distinct().withColumn("cut", F.lit(1))
    all_ = predictions.filter("raw_text IS NOT NULL").select("id", "attempt", "source", F.lit(0).alias("cut"))
    return all_.union(cut).groupBy("source", "id", "attempt").agg(F.max("cut").alias("cut")).groupBy("source").agg(F.count("*").alias("answers"), F.sum("cut").alias("cut_answers"), F.avg("cut").alias("cut_rate"))
