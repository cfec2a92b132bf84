"""Names, distances and similarities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def plain_name(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(F.btrim(F.coalesce(name, F.lit("")))), "[-_]+", " "), r"\s+", " "))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, grams)))


def similarity(a: Column, b: Column) -> Column:
    ta, tb = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(ta, tb)) / F.greatest(F.size(F.array_union(ta, tb)), F.lit(1))


#: The scripts of names and the first and last code points of their blocks (fixed values).
SCRIPTS = [
    ("hi", 0x0900, 0x097F), ("bn", 0x0980, 0x09FF), ("pa", 0x0A00, 0x0A7F), ("gu", 0x0A80, 0x0AFF), ("or", 0x0B00, 0x0B7F),
    ("ta", 0x0B80, 0x0BFF), ("te", 0x0C00, 0x0C7F), ("kn", 0x0C80, 0x0CFF), ("ml", 0x0D00, 0x0D7F),
]


def script_language(text: Column) -> Column:
    """The language that the first letter of an Indic block stands for; null without one."""
    first = F.regexp_extract(text, r"([\x{0900}-\x{0D7F}])", 1)
    return F.coalesce(*[F.when(first.rlike(rf"[\x{{{a:04X}}}-\x{{{b:04X}}}]"), F.lit(k)) for k, a, b in SCRIPTS])
