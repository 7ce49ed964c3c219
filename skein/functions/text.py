"""Scalar functions over text, as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Hashable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters with marks, and what they become.
MARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿąćęłńśźżÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝĄĆĘŁŃŚŹŻ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyacelnszzAAAAAACEEEEIIIINOOOOOOUUUUYACELNSZZ"
PUNCTUATION = ".,?!:;"
_BLANKS = re.compile(r"[ \t\r\n]+")


def normalize(text: Column) -> Column:
    """Lower case without marks; other characters than letters and digits of any script and : / . _ - become one space for each run."""
    plain = F.replace(strip_marks(F.lower(text)), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}:/._ -]+", " "))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def canonical(text: Column) -> Column:
    """For duplicate checks: letters and digits in lower case, one space between words."""
    return collapse(F.regexp_replace(strip_marks(F.lower(text)), r"[^\p{L}\p{N}]+", " "))


def strip_marks(text: Column) -> Column:
    """Without combining marks; the Latin letters that have one built in become plain."""
    return F.regexp_replace(F.translate(text, MARKED, PLAIN), r"\p{M}+", "")


@F.pandas_udf(T.StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def unaccented(text: Column) -> Column:
    """Compatibility decomposition without combining marks; letters with a stroke stay. Plain ASCII takes no part in the Python step."""
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(_decomposed(F.when(~text.rlike(r"^\p{ASCII}*$"), text)))


@F.pandas_udf(T.StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x.casefold().replace("ł", "l")) if not unicodedata.combining(c)))


def folded(text: Column) -> Column:
    """Case folded, l for the l with a stroke, canonical decomposition without marks; then runs of all but letters, digits, ``:/._-`` and space become one space each."""
    plain = F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(_folded(F.when(~text.rlike(r"^\p{ASCII}*$"), text)))
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}:/._ -]+", " "))


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def composed(text: Column) -> Column:
    """Canonical composition, and one space for each run of white space. What lies under U+0300 is composed already."""
    other = text.rlike(r"[^\x{0}-\x{2FF}]")
    return collapse(F.when(~other, text).otherwise(_composed(F.when(other, text))))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\r\n]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def shingles(text: Column, width: int = 5) -> Column:
    """The distinct runs of ``width`` words; none of fewer words."""

    def runs(w: Column) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.array_join(F.slice(w, i, width), " "))
        return F.when(F.size(w) >= width, F.array_distinct(joined)).otherwise(F.array().cast("array<string>"))

    # The array around the words binds them, so that they are split once and not for every run.
    return F.flatten(F.transform(F.array(words(text)), runs))


def shingle_hashes(text: Column, width: int = 5) -> Column:
    """The same runs, as 64 bits each: of the words, which are hashed once."""

    def runs(h: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(F.slice(h, i, width)))
        return F.when(F.size(h) >= width, F.array_distinct(hashed)).otherwise(F.array().cast("array<bigint>"))

    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    return F.flatten(F.transform(F.array(hashes), runs))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Levenshtein distance by the reference's length; of an empty reference 0 if the other is empty too, else 1."""
    return F.when(F.length(reference) == 0, F.when(F.length(hypothesis) == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(F.levenshtein(reference, hypothesis) / F.length(reference))


def edit_distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Levenshtein distance of two sequences of any length: a column of the table at a time, its differences in the bits of two integers."""
    if not a or not b:
        return max(len(a), len(b))
    where: dict[Hashable, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    every, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rises, falls, distance = every, 0, len(a)
    for y in b:
        same = where.get(y, 0)
        level = same | falls
        carried = (((same & rises) + rises) ^ rises) | same
        up, down = (falls | ~(carried | rises)) & every, rises & carried
        distance += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & every, (down << 1) & every
        rises, falls = (down | ~(level | up)) & every, up & level
    return distance


@F.pandas_udf(T.DoubleType())
def word_error_rate(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Levenshtein distance over words by the reference's words; of an empty reference 0 if the other is empty too, else 1. Null of a null."""

    def rate(r: str | None, h: str | None) -> float | None:
        if r is None or h is None:
            return None
        r, h = ([w for w in _BLANKS.split(x) if w] for x in (r, h))
        return edit_distance(r, h) / len(r) if r else float(bool(h))

    return pd.Series([rate(r, h) for r, h in zip(reference, hypothesis)], dtype="float64")


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def punctuation_f1(reference: Column, hypothesis: Column) -> Column:
    """F1 over the multiset of . , ? ! : ; — 1 where neither has any."""
    same, total = F.lit(0), F.lit(0)
    for mark in PUNCTUATION:
        a, b = _count(reference, mark), _count(hypothesis, mark)
        same, total = same + F.least(a, b), total + a + b
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * same / total)


def content_id(prefix: str, text: Column, digits: int = 24) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(prefix + ":"), text), 256), 1, digits)


def keyword_hits(text: Column, markers: list[str]) -> Column:
    """How many of the markers the text contains."""
    return sum((F.contains(text, F.lit(m)).cast("int") for m in markers), F.lit(0))


def rank_fusion_weight(rank: Column, weight: Column, k: int = 60) -> Column:
    return weight / (F.lit(k) + rank)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """RFC 4122 version 5: the first 16 bytes of SHA-1, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def set_fingerprint(entry: Column) -> Column:
    """Aggregate: a hash of the multiset of entries, whatever their order; two sums of hash parts, so nothing is gathered. Nulls don't count."""
    h = F.sha2(entry, 256)
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return F.sha2(F.concat_ws(":", part(1), part(16)), 256)


def set_fingerprint_sql(entry: str) -> str:
    part = lambda at: f"CAST(coalesce(sum(CAST(concat('0x', substr(sha256({entry}), {at}, 15)) AS BIGINT)) FILTER (WHERE {entry} IS NOT NULL), 0) AS VARCHAR)"
    return f"sha256(concat({part(1)}, ':', {part(16)}))"
