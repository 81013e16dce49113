"""Plain spellings of the ids, digests, components and splits of the image tables.

All functions are column expressions that stay in the JVM. A value that names
nothing (null, blank, a stand-in for "not known", or no known spelling) gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: SHA-256 of no bytes, which stands for a file that was not read.
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
#: A shortened digest has at least so many digits. Fewer name no image: among n digests about n * n / 2^(4k + 1)
#: pairs share their first k digits by chance, which for seven digits is one pair at 23,000 digests and for eight one at 93,000.
SHORTEST_DIGEST = 8

_EDGE = " \t\n\x0b\f\r\xa0\u3000\u200b\ufeff"
SPLITS = {"train": ("train", "training"), "val": ("val", "valid", "validation"), "dev": ("dev", "development", "test"), "excluded": ("excluded", "exclude")}


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(_EDGE))


def plain_id(c: Column) -> Column:
    """Lower case without outer blanks."""
    return _or_null(F.lower(_trim(c)))


def plain_split(c: Column) -> Column:
    """train, val, dev or excluded."""
    word, out = F.lower(_trim(c)), None
    for name, spellings in SPLITS.items():
        out = (F.when if out is None else out.when)(word.isin(*spellings), F.lit(name))
    return out


def plain_image(c: Column) -> Column:
    """``IP`` and nine digits, whatever folder, case or file type surrounds them."""
    return _or_null(F.regexp_extract(F.upper(c), r"(?:^|[^0-9A-Z])(IP[0-9]{9})(?![0-9])", 1))


def plain_component(c: Column) -> Column:
    """24 lower-case hex digits or an image id; one repeated digit is a stand-in."""
    found = F.regexp_extract(F.lower(_trim(c)), r"(?:^|[^0-9a-z])([0-9a-f]{24}|ip[0-9]{9})$", 1)
    return F.when(found.startswith("ip"), F.upper(found)).when((found != "") & ~found.rlike(r"^(.)\1*$"), found)


def plain_digest(c: Column) -> Column:
    """Lower-case hex digits of a SHA-256: 64, or fewer where it was shortened.

    Prefixes, base64 and marks of omission are taken off. Stand-ins (one repeated
    digit, the digest of no bytes, in full or shortened) give null.
    """
    text = _trim(c)
    base64 = F.translate(F.regexp_extract(text, r"(?i)^sha-?256[-:=]([A-Za-z0-9+/_-]{43})=?$", 1), "-_", "+/")
    hexed = F.regexp_extract(F.lower(text), rf"^(?:sha-?256\s*[-:=]\s*|0x)?([0-9a-f]{{{SHORTEST_DIGEST},64}})(?:\x{{2026}}|\.\.\.)?$", 1)
    found = F.when(base64 != "", F.lower(F.hex(F.try_to_binary(F.concat(base64, F.lit("=")), F.lit("base64"))))).otherwise(hexed)
    return F.when((found != "") & ~found.rlike(r"^(.)\1*$") & ~F.lit(EMPTY_SHA256).startswith(found), found)
