"""Address text as native Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The matching conventions depend on these very tables.
STREET_SUFFIXES = {
    "STREET": "ST", "ROAD": "RD", "AVENUE": "AVE", "BOULEVARD": "BLVD", "DRIVE": "DR", "LANE": "LN", "COURT": "CT", "PLACE": "PL",
    "TERRACE": "TER", "CRESCENT": "CRES", "SQUARE": "SQ", "GATE": "GTE", "CIRCLE": "CIR", "WAY": "WAY", "TRAIL": "TRL", "PARKWAY": "PKWY",
    "HIGHWAY": "HWY", "EXPRESSWAY": "EXPY", "CRT": "CT", "CRCL": "CIR", "GT": "GTE", "AV": "AVE", "CR": "CRES", "BV": "BLVD", "WY": "WAY",
    "GARDENS": "GDNS", "GROVE": "GRV", "HEIGHTS": "HTS", "PATHWAY": "PTWY", "CIRCUIT": "CRCT", "BRIDGE": "BDGE", "LAWN": "LWN",
    "PARK": "PK", "ROADWAY": "RDWY", "CLOSE": "CS", "WOODS": "WDS", "GREEN": "GRN",
}
DIRECTIONS = {"NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W"}
LONG_SUFFIXES = {
    "ST": "Street", "RD": "Road", "AVE": "Avenue", "BLVD": "Boulevard", "DR": "Drive", "LN": "Lane", "CT": "Court", "CRT": "Court",
    "PL": "Place", "TER": "Terrace", "CRES": "Crescent", "SQ": "Square", "GTE": "Gate", "GT": "Gate", "CIR": "Circle", "CRCL": "Circle",
    "TRL": "Trail", "PKWY": "Parkway", "HWY": "Highway", "EXPY": "Expressway", "AV": "Avenue", "CR": "Crescent", "BV": "Boulevard", "WY": "Way",
    "GDNS": "Gardens", "GRV": "Grove", "HTS": "Heights", "PTWY": "Pathway", "CRCT": "Circuit", "BDGE": "Bridge", "LWN": "Lawn",
    "PK": "Park", "RDWY": "Roadway", "CS": "Close", "WDS": "Woods", "GRN": "Green",
}
LONG_DIRECTIONS = {"N": "North", "S": "South", "E": "East", "W": "West"}
STREET_OVERRIDES = {
    "Deane Field Cres": "Deanefield Cres", "Golfcrest Rd": "Golf Crest Rd", "Forest View Rd": "Forestview Rd", "Greenhouse Rd": "Green House Rd",
    "Kathleen Ave": "Kathleen Cres", "Meadow Crest Rd": "Meadowcrest Rd", "Posthorn Grv": "Post Horn Grv", "Scenic Millway": "Scenic Mill Way",
    "Mac Gregor Ave": "MacGregor Ave", "Governor's Rd": "Governors Road", "St Andrews Gdns": "St. Andrew's Gardens",
    "St Leonard's Ave": "Saint Leonard's Avenue", "Sunnyslope Ave": "Sunny Slope",
}


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(table.items())))


def tokens(name: Column) -> Column:
    return F.filter(F.split(name, r"\s+"), lambda t: t != "")


def _look(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(_map(table), key)


def normalize_street(name: Column) -> Column:
    """Upper case, dots out, every suffix and direction token in its short form; '' for null."""
    parts = tokens(F.upper(F.replace(F.coalesce(name, F.lit("")), F.lit("."), F.lit(""))))
    return F.array_join(F.transform(parts, lambda t: F.coalesce(_look(STREET_SUFFIXES | DIRECTIONS, t), t)), " ")


def glue_mc(name: Column) -> Column:
    """A token Mc and the alphabetic token behind it become one, unless that is a suffix or direction."""
    words = "|".join(sorted({*STREET_SUFFIXES, *LONG_SUFFIXES, *DIRECTIONS, *LONG_DIRECTIONS}, key=lambda w: (-len(w), w)))
    return F.regexp_replace(name, rf"(?i)(?<!\S)M\.*C\.*\s+(?!(?:{words})(?:\s|$))(\p{{L}}+)(?=\s|$)", "Mc$1")


def expand_street(name: Column) -> Column:
    """The trailing direction and the suffix before it in their long forms; earlier tokens stay; null and '' pass."""
    parts = tokens(glue_mc(name))
    key = lambda t: F.upper(F.replace(t, F.lit("."), F.lit("")))
    n = F.size(parts)
    direction = _look(LONG_DIRECTIONS, key(F.get(parts, n - 1)))
    at = F.when(direction.isNotNull(), n - 2).otherwise(n - 1)
    suffix = _look(LONG_SUFFIXES, key(F.get(parts, at)))
    out = F.transform(parts, lambda t, i: F.when((i == n - 1) & direction.isNotNull(), direction).when((i == at) & suffix.isNotNull(), suffix).otherwise(t))
    return F.when(name.isNull() | (n == 0), name).otherwise(F.array_join(out, " "))


def override_street(name: Column) -> Column:
    """Known spelling variants, looked up without regard to case and white space; others unchanged."""
    key = F.array_join(tokens(F.upper(name)), " ")
    return F.coalesce(_look({k.upper(): v for k, v in STREET_OVERRIDES.items()}, key), name)


def street_fallback(full: Column, name: Column, kind: Column, direction: Column) -> Column:
    """The full street name, else its parts that aren't empty; '' without any."""
    parts = F.filter(F.array(name, kind, direction), lambda p: F.coalesce(p != "", F.lit(False)))
    return F.coalesce(F.nullif(full, F.lit("")), F.trim(F.array_join(parts, " ")))


def first_int(text: Column) -> Column:
    """The first run of digits as a number, 0 without one."""
    return F.coalesce(F.regexp_extract(text, r"(\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def sqlite_int(text: Column) -> Column:
    """Numeric prefix of a text, 0 without one, null for null."""
    return F.when(text.isNotNull(), F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint")))


def parity_range(lo: Column, hi: Column) -> Column:
    """Lo..hi by 2 if both have the same parity, else by 1; empty if reversed."""
    step = F.when(lo % 2 == hi % 2, 2).otherwise(1).cast("bigint")
    return F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi), step)).otherwise(F.array().cast("array<bigint>"))


def housenumber_tokens(hn: Column) -> Column:
    """The single numbers of a feature's house number: fractions whole, lists split, short ranges expanded."""
    hn = F.coalesce(hn, F.lit(""))

    def one(part: Column) -> Column:
        m = lambda g: F.regexp_extract(part, r"^\s*(\d+)\s*-\s*(\d+)\s*$", g).try_cast("bigint")
        span = m(2) - m(1)
        return F.when((span > 0) & (span <= 100), F.transform(parity_range(m(1), m(2)), lambda x: x.cast("string"))).otherwise(F.array(F.upper(part)))

    parts = F.filter(F.transform(F.split(hn, "[;,/]"), lambda p: F.trim(p)), lambda p: p != "")
    fraction = hn.rlike(r"^\s*\d+\s+\d+/\d+\s*$|^\s*\d+/\d+\s*$")
    return F.when(fraction, F.array(F.upper(F.trim(hn)))).otherwise(F.flatten(F.transform(parts, one)))


def split_housenumbers(hn: Column) -> Column:
    """Parts of a list in first-seen order; whole tokens like 586/586a are split too, fractions aren't."""
    parts = F.filter(F.transform(F.split(hn, "[,;]"), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+[A-Za-z]*(/\d+[A-Za-z]*)+$"), F.split(p, "/")).otherwise(F.array(p)))))


def normalize_list(hn: Column) -> Column:
    """Parts sorted by (leading integer, text) and joined by commas; null where that changes nothing or there is one part."""
    keyed = F.transform(split_housenumbers(hn), lambda p: F.struct(F.coalesce(F.regexp_extract(p, r"^\s*(\d+)", 1).try_cast("bigint"), F.lit(0)).alias("n"), p.alias("p")))
    out = F.array_join(F.transform(F.array_sort(keyed), lambda s: s["p"]), ",")
    return F.when((F.size(keyed) >= 2) & (out != hn), out)


def reverse_range(hn: Column) -> Column:
    """A descending range in ascending order; null for all else."""
    a, b = (F.regexp_extract(hn, r"^\s*(\d+)\s*-\s*(\d+)\s*$", g).try_cast("bigint") for g in (1, 2))
    return F.when(a > b, F.concat_ws("-", b.cast("string"), a.cast("string")))


def suspicious_suffix(suffix: Column, number: Column) -> Column:
    """I, O or Q behind a house number, from the suffix field or else the number; '' without one."""
    found = F.upper(F.coalesce(F.nullif(F.trim(suffix), F.lit("")), F.regexp_extract(number, r"^\d+\s*([A-Za-z])\b", 1)))
    return F.when(found.isin("I", "O", "Q"), found).otherwise("")


def slugify(text: Column) -> Column:
    """N10"""
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("tile"))


def merge_codes(a: Column, b: Column) -> Column:
    """The sorted union of two comma-separated lists."""
    parts = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")
    return F.array_join(F.array_sort(F.array_union(parts(a), parts(b))), ",")


def id_order(key: Column) -> Column:
    """Ids in numeric order, if they are digits (of any number), before all others in text order; equal numbers by their text."""
    digits = F.regexp_replace(key, "^0+", "")
    number = F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 10, "0"), digits, F.lit(" "), key)
    return F.when(key.rlike(r"^\d+$"), number).otherwise(F.concat(F.lit("1"), key))
