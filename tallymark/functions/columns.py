"""Scalar functions over columns: text, identifiers, time, numbers."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


# --- text ---


def squeezed(x: Column) -> Column:
    """White space collapsed and trimmed; null if nothing is left."""
    s = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(s != "", s)


def comparable(x: Column) -> Column:
    return F.lower(squeezed(x))


def first_text(*xs: Column) -> Column:
    """The first of xs that is not empty once squeezed."""
    return F.coalesce(*map(squeezed, xs))


def stable_id(x: Column) -> Column:
    s = squeezed(x)
    return F.when(s.rlike(r"^[A-Za-z0-9][A-Za-z0-9:._/-]{2,255}$"), s)


def text_list(x: Column) -> Column:
    """Sorted distinct parts of a text split at comma, semicolon or bar."""
    parts = F.filter(F.transform(F.split(x, r"[,;|]"), squeezed), lambda p: p.isNotNull())
    return F.array_sort(F.array_distinct(parts))


def entity_key(x: Column) -> Column:
    """Upper case, only A-Z and 0-9; null if nothing is left."""
    s = F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")
    return F.when(s != "", s)


def identifier_key(kind: Column, x: Column) -> Column:
    """An identifier in its kind's normal form, or null where it cannot be one."""
    compact = entity_key(x)
    digits = F.regexp_replace(compact, "[^0-9]", "")
    return (
        F.when(kind.isin("ein", "duns"), F.when(F.length(digits) == 9, digits))
        .when(kind == "cik", F.when((F.length(digits) >= 1) & (F.length(digits) <= 10), F.lpad(digits, 10, "0")))
        .when(kind == "uei", F.when(F.length(compact) == 12, compact))
        .otherwise(compact)
    )


def identifier_kind(source: Column) -> Column:
    """Which identifier a source's ids are, by the source's name."""
    s = F.lower(source)
    known = [("ein", ("ein", "irs", "propublica", "nonprofit")), ("cik", ("cik", "sec", "edgar")), ("uei", ("uei", "sam_gov", "usaspending")), ("duns", ("duns",))]
    out = F.lit("generic")
    for kind, words in reversed(known):
        out = F.when(reduce(lambda a, b: a | b, (s.contains(w) for w in words)), F.lit(kind)).otherwise(out)
    return out


def award_recipient(title: Column) -> Column:
    """The recipient that an award's title names before its last spaced dash."""
    got = F.regexp_extract(title, r"(?i)^(?:contract|award|grant)\s*:\s*(.+)\s+[\x{2014}\x{2013}-]\s+\$", 1)
    plain = F.regexp_extract(title, r"(?i)^(?:contract|award|grant)\s*:\s*(.+?)(?:\s+[\x{2014}\x{2013}-]\s+|$)", 1)
    return F.coalesce(squeezed(got), squeezed(plain))


def geography_key(x: Column) -> Column:
    s = F.upper(F.trim(x))
    return F.when(s != "", s)


def state_alias(geography: Column) -> Column:
    s = F.regexp_extract(geography_key(geography), r"^US_([A-Z]{2})$", 1)
    return F.when(s != "", s)


def web_address(x: Column) -> Column:
    """A url without trailing punctuation, fragment and slash, with scheme and lower-case host."""
    s = F.regexp_replace(F.trim(x), r"""[\s.,;:!?)\]}'"]+$""", "")
    s = F.when(s.rlike(r"(?i)^https?://"), s).otherwise(F.concat(F.lit("https://"), s))
    scheme, host = F.lower(F.regexp_extract(s, r"^([A-Za-z]+)://([^/?#]*)", 1)), F.lower(F.regexp_extract(s, r"^([A-Za-z]+)://([^/?#]*)", 2))
    rest = F.regexp_replace(F.regexp_extract(s, r"^[A-Za-z]+://[^/?#]*([^#]*)", 1), "/+$", "")
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, rest))


def base64url(x: Column) -> Column:
    return F.translate(F.rtrim(F.base64(F.encode(x, "UTF-8")), F.lit("=")), "+/\r\n", "-_")


# --- numbers ---


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def half_up(x: Column, places: int) -> Column:
    """Rounded half towards plus infinity."""
    s = 10.0**places
    return F.floor(x * s + 0.5) / s


def bounded_rate(part: Column, whole: Column) -> Column:
    """part / whole within [0, 1]; null where whole is not positive: nothing seen is not zero."""
    return F.when(whole > 0, clamp(part / whole, 0, 1))


def severity_by_z(z: Column) -> Column:
    return F.when(z >= 3, "critical").when(z >= 2, "high").otherwise("medium")


def severity_by_confidence(c: Column) -> Column:
    return F.when(c >= 0.9, "critical").when(c >= 0.8, "high").when(c >= 0.7, "medium").when(c >= 0.5, "low").otherwise("info")


# --- space and time ---


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(EARTH_KM) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def gaussian(distance: Column, sigma: float) -> Column:
    """exp(-d^2 / 2 sigma^2); null stays null."""
    if not sigma > 0 or not math.isfinite(sigma):
        raise ValueError("sigma must be positive and finite")
    return F.exp(-(distance * distance) / (2 * sigma * sigma))


def time_bucket(ms: Column, bucket_ms: int) -> Column:
    return F.floor(ms / bucket_ms).cast("long")


def recency(as_of_ms: int, newest_ms: Column, window_ms: int) -> Column:
    return F.coalesce(clamp(1 - (F.lit(as_of_ms) - newest_ms) / F.lit(float(window_ms)), 0, 1), F.lit(0.0))


def euclidean(x: Column, y: Column) -> Column:
    """Distance of two arrays; null where their lengths differ."""
    d = F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(x) == F.size(y), F.sqrt(d))
