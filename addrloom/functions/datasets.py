"""Number and street out of combined address texts of many datasets, as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from addrloom.functions.text import DIRECTIONS, tokens

NUMBER = r"^\d+[A-Za-z]?(-\d+[A-Za-z]?)?$"


def split_full(full: Column) -> tuple[Column, Column]:
    """Leading number ('' without one) and the rest of the text before the first comma."""
    words = tokens(F.substring_index(full, ",", 1))
    first = F.coalesce(F.get(words, F.lit(0)), F.lit(""))
    numbered = first.rlike(NUMBER)
    whole = F.trim(F.substring_index(full, ",", 1))
    return F.when(numbered, first).otherwise(""), F.when(numbered, F.array_join(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), " ")).otherwise(whole)


def strip_places(street: Column, places: Column, rounds: int = 3) -> Column:
    """Cuts place names (an array, earlier ones first) off a street's end, one each round; their case doesn't matter."""

    def cut(s: Column, _: Column) -> Column:
        place = F.get(F.filter(places, lambda p: (p != "") & F.endswith(F.upper(s), F.concat(F.lit(" "), F.upper(p)))), F.lit(0))
        return F.when(place.isNull(), s).otherwise(F.trim(F.substring(s, F.lit(1), F.length(s) - F.length(place) - 1)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), street, cut)


def suffix_token(street: Column) -> Column:
    """The last token that isn't a direction, in upper case without dots; '' without one."""
    known = [*DIRECTIONS, *DIRECTIONS.values()]
    return F.aggregate(tokens(F.upper(F.replace(F.coalesce(street, F.lit("")), F.lit("."), F.lit("")))), F.lit(""), lambda last, t: F.when(t.isin(*known), last).otherwise(t))


def resolve(number: Column, full: Column, street: Column, parts: list[Column], places: Column, use_street: bool = False) -> tuple[Column, Column]:
    """Number and street of a row: ``parts`` of the name or the street itself where told, else from the combined text, else the street as it is."""
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    told = clean(street) if use_street else F.array_join(F.filter(F.array(*map(clean, parts)), lambda p: p != ""), " ") if parts else F.lit("")
    in_full, rest = split_full(clean(full))
    found = F.when(told != "", told).when(clean(full) != "", strip_places(rest, places)).otherwise("")
    return F.coalesce(F.nullif(F.upper(clean(number)), F.lit("")), F.upper(in_full)), F.when(found != "", found).otherwise(clean(street))
