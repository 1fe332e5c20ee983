"""Audit of a source's range rows: counts by kind, extremes, and how single rows or map features cover their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrloom.functions.text import expand_street
from addrloom.operators.coverage import numbers_within
from addrloom.operators.sums import ordered

# Fixed values
DASHES = "-‐‑‒–—―"
#: A house number's own range counts up to this span.
FEATURE_SPAN = 200


def _suffix(name: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("None")), F.lit(""))


def ranges_of(src: DataFrame) -> DataFrame:
    """Rows whose two numbers are known and differ, reversed ones included."""
    return src.where("lo_num <> hi_num")


def audit_counts(src: DataFrame) -> DataFrame:
    """(section, item, n) of all rows in one aggregation.

    ``src``: lo_num, hi_num, lo_num_suf, hi_num_suf, cls, address_full. Spans of reversed ranges are negative and count as 3-10.
    """
    is_range = F.coalesce(F.col("lo_num") != F.col("hi_num"), F.lit(False))
    lo_suf, hi_suf, span = _suffix("lo_num_suf"), _suffix("hi_num_suf"), F.col("hi_num") - F.col("lo_num")
    odd = F.abs(F.col("lo_num") % 2) + F.abs(F.col("hi_num") % 2)
    dash = F.nullif(F.regexp_extract("address_full", f"([{DASHES}])", 1), F.lit(""))
    row = lambda section, item, when: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(section).alias("section"), item.alias("item")))
    found = F.array(
        row("rows", F.lit("active"), F.lit(True)), row("rows", F.lit("range"), is_range), row("rows", F.lit("suffix_only"), (F.col("lo_num") == F.col("hi_num")) & (lo_suf != hi_suf)),
        row("rows", F.lit("reversed"), F.col("lo_num") > F.col("hi_num")), row("class", F.coalesce("cls", F.lit("?")), is_range),
        row("form", F.when((lo_suf != "") | (hi_suf != ""), "lettered").otherwise("numeric"), is_range),
        row("span", F.when(span == 1, "1").when(span == 2, "2").when(span <= 10, "3-10").when(span <= 100, "11-100").otherwise(">100"), is_range),
        row("parity", F.when(odd == 0, "both even").when(odd == 2, "both odd").otherwise("mixed"), is_range), row("dash", dash, is_range & dash.isNotNull()),
    )
    return src.select(F.explode(F.filter(found, lambda r: r.isNotNull())).alias("r")).groupBy("r.section", "r.item").agg(F.count("*").alias("n"))


def suffix_pairs(src: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent pairs of letters of lettered ranges, ties by letters."""
    r = ranges_of(src).select(_suffix("lo_num_suf").alias("lo_suf"), _suffix("hi_num_suf").alias("hi_suf")).where("lo_suf <> '' OR hi_suf <> ''")
    return r.groupBy("lo_suf", "hi_suf").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lo_suf", "hi_suf").limit(top)


def widest(src: DataFrame, top: int = 10) -> DataFrame:
    """The ranges with the largest span, ties by address, municipality and id."""
    r = ranges_of(src).select((F.col("hi_num") - F.col("lo_num")).alias("span"), "address_full", "muni", "identity_key")
    return r.orderBy(F.desc("span"), "address_full", F.asc_nulls_first("muni"), "identity_key").limit(top)


def with_suffix(src: DataFrame, suffix: str = "1/2") -> DataFrame:
    """Rows whose first number has this suffix, with their place by street and number, null first, then id: running numbers, no task holds them all."""
    rows = src.where(F.col("lo_num_suf") == suffix).select("identity_key", "street", "lo_num", "muni")
    return ordered(rows, [F.asc_nulls_first("street"), F.asc_nulls_first("lo_num"), F.col("identity_key")]).withColumnRenamed("rank", "place")


def busiest_streets(src: DataFrame, top: int = 5) -> DataFrame:
    """Streets of a municipality with most ranges."""
    return ranges_of(src).groupBy("street", "muni").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("street"), F.asc_nulls_first("muni")).limit(top)


def _covered(ranges: DataFrame, keys: DataFrame) -> DataFrame:
    """``ranges``: identity_key, street, area, lo_num, hi_num; ``keys``: distinct street, area, n. A reversed range has no numbers and no cover."""
    lo, hi = F.col("lo_num"), F.col("hi_num")
    step = F.when(F.pmod(lo, F.lit(2)) == F.pmod(hi, F.lit(2)), 2).otherwise(1)
    r = ranges.where("street is not null").select("identity_key", "street", "area", lo.alias("lo"), hi.alias("hi"), step.alias("step"))
    count = F.when(lo <= hi, F.floor((hi - lo) / step) + 1).otherwise(0).cast("bigint")
    g = ranges.groupBy("identity_key").agg(F.sum(count).alias("expected")).join(numbers_within(r, keys, ["street", "area"], "identity_key"), "identity_key", "left")
    g = g.select("identity_key", F.coalesce("present", F.lit(0)).alias("present"), "expected")
    return g.withColumn("cover", F.when(F.col("present") == 0, "none").when(F.col("present") == F.col("expected"), "full").otherwise("partial"))


def sibling_cover(src: DataFrame) -> DataFrame:
    """Each range by the share of its numbers (by parity) that single rows of its street and municipality carry; null equals null there.

    identity_key must be unique among ``src``'s ranges, as it is in one snapshot.
    """
    singles = src.where("lo_num = hi_num AND street <> ''").select("street", F.col("muni").alias("area"), F.col("lo_num").alias("n")).distinct()
    return _covered(ranges_of(src).withColumn("area", F.col("muni")), singles)


def feature_numbers(features: DataFrame) -> DataFrame:
    """Distinct (street, n) of map features: the parts of a list, ranges in full, else the leading number."""

    def one(part: Column) -> Column:
        m = lambda g: F.regexp_extract(part, r"^(\d+)\s*[-–]\s*(\d+)$", g).try_cast("bigint")
        a, b = m(1), m(2)
        whole = F.when((a <= b) & (b - a < FEATURE_SPAN), F.sequence(a, F.greatest(a, F.least(b, a + FEATURE_SPAN)))).otherwise(F.array().cast("array<bigint>"))
        lead = F.regexp_extract(part, r"^(\d+)", 1).try_cast("bigint")
        return F.when(part.rlike(r"^\d+\s*[-–]\s*\d+$"), whole).when(lead.isNotNull(), F.array(lead)).otherwise(F.array().cast("array<bigint>"))

    parts = F.transform(F.split("housenumber", "[;,]"), lambda p: F.trim(p))
    return features.where("housenumber <> '' AND street <> ''").select("street", F.explode(F.flatten(F.transform(parts, one))).alias("n")).distinct()


def feature_cover(src: DataFrame, features: DataFrame) -> DataFrame:
    """As ``sibling_cover``, with the numbers that features carry on the street in its long form, or as written where that has none."""
    keys = feature_numbers(features)
    known = keys.select(F.col("street").alias("_known")).distinct()
    r = ranges_of(src).withColumn("_long", F.coalesce(F.nullif(expand_street(F.col("street")), F.lit("")), F.col("street")))
    r = r.join(known, F.col("_long") == F.col("_known"), "left")
    street = F.when(F.col("_known").isNotNull(), F.col("_long")).otherwise(F.col("street"))
    return _covered(r.select("identity_key", street.alias("street"), F.lit("").alias("area"), "lo_num", "hi_num"), keys.withColumn("area", F.lit("")))
