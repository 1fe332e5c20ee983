"""Profiles of datasets and of tagging habits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrloom.functions.text import tokens

FRACTION = r"^\s*\d+\s+\d+/\d+\s*$|^\s*\d+/\d+\s*$"
CELL_DEG = 0.0045


def anchor_class(tags: Column) -> Column:
    """what an address hangs on: house name, place, street or nothing."""
    has = lambda k: F.coalesce(F.try_element_at(tags, F.lit(k)) != "", F.lit(False))
    street, house, place = has("addr:street"), has("addr:housename"), has("addr:place")
    named = F.when(house & street, "housename_with_street").when(house & ~place, "housename_only")
    return named.when(place & street, "place_and_street").when(place, "place_only").when(street, "street_only").otherwise("no_anchor")


def entrance_class(is_poi: Column, tags: Column) -> Column:
    """entrance, POI, both or neither."""
    door = F.coalesce(F.map_contains_key(tags, "entrance"), F.lit(False))
    return F.when(door & is_poi, "entrance + poi").when(door, "entrance only").when(is_poi, "poi only").otherwise("pure address")


def tag_combinations(features: DataFrame) -> DataFrame:
    """How often each set of keys occurs."""
    return features.groupBy(F.array_join(F.array_sort(F.map_keys("tags")), ",").alias("keys")).agg(F.count("*").alias("n"))


def separators(features: DataFrame, top: int = 10) -> DataFrame:
    """For each separator of house numbers its count, most frequent values (ties by value) and the parts of its lists."""
    hn = F.col("housenumber")
    fraction = hn.rlike(FRACTION)
    kinds = [("semicolon", F.contains(hn, F.lit(";"))), ("comma", F.contains(hn, F.lit(","))), ("range", hn.rlike(r"^\d+-\d+$")), ("slash_multi", F.contains(hn, F.lit("/")) & ~fraction), ("slash_fraction", fraction)]
    kind = F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in kinds]), lambda k: k.isNotNull()))
    values = features.where("housenumber is not null").select(kind.alias("separator"), "housenumber").groupBy("separator", "housenumber").agg(F.count("*").alias("_n"))
    best = values.withColumn("_r", F.row_number().over(Window.partitionBy("separator").orderBy(F.desc("_n"), "housenumber"))).where(F.col("_r") <= top)
    best = best.groupBy("separator").agg(F.array_sort(F.collect_list(F.struct("_r", "housenumber"))).alias("_t"))
    total = values.groupBy("separator").agg(F.sum("_n").alias("n"), F.count("*").alias("n_values"))
    return total.join(best, "separator").select("separator", "n", "n_values", F.array_join(F.col("_t.housenumber"), "|").alias("top_values"))


def list_lengths(features: DataFrame, separator: str) -> DataFrame:
    """The number of house numbers by the number of their non-blank parts."""
    parts = F.size(F.filter(F.split("housenumber", separator), lambda p: F.trim(p) != ""))
    return features.where(F.contains(F.col("housenumber"), F.lit(separator))).groupBy(parts.alias("parts")).agg(F.count("*").alias("n"))


def place_cell(lat: Column, lon: Column) -> tuple[Column, Column]:
    """About 500 m, longitudes scaled by latitude, cut towards zero."""
    return (lat / CELL_DEG).cast("bigint"), (lon / (F.lit(CELL_DEG) / F.cos(F.radians(lat)))).cast("bigint")


def datasets(src: DataFrame, known_suffixes: tuple[str, ...]) -> DataFrame:
    """For each dataset its rows, distinct keys, unresolved rows, share of units, rows with an unknown last token, and box.

    ``src``: dataset, number, street, street_norm, unit, lat, lon. Keys are counted after a distinct, not within a task.
    """
    resolved = F.coalesce((F.col("number") != "") & (F.col("street") != ""), F.lit(False))
    suffix = F.element_at(tokens(F.col("street")), -1)
    unit = F.coalesce(F.trim("unit") != "", F.lit(False))
    s = src.withColumns({"_ok": resolved, "_unit": unit, "_odd": resolved & ~F.coalesce(F.upper(suffix).isin(*known_suffixes), F.lit(True))})
    a = s.groupBy("dataset").agg(F.count("*").alias("active_rows"), F.count_if(~F.col("_ok")).alias("unresolved_rows"), F.count_if("_unit").alias("_u"), F.count_if("_odd").alias("unknown_suffix_rows"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))
    keys = s.where(F.col("_ok") & (F.col("street_norm") != "")).select("dataset", "number", "street_norm").distinct().groupBy("dataset").agg(F.count("*").alias("distinct_keys"))
    j = a.join(keys, "dataset", "left")
    return j.select("dataset", "active_rows", F.coalesce("distinct_keys", F.lit(0)).alias("distinct_keys"), "unresolved_rows", (F.col("_u") * 100 / F.col("active_rows")).alias("unit_pct"), "unknown_suffix_rows", "min_lat", "max_lat", "min_lon", "max_lon")


def concentration(missing: DataFrame, top: int = 20) -> DataFrame:
    """For each dataset the cells with missing keys and the share of its ``top`` fullest cells in percent."""
    y, x = place_cell(F.col("lat"), F.col("lon"))
    cells = missing.where("lat is not null and lon is not null").groupBy("dataset", y.alias("y"), x.alias("x")).agg(F.count("*").alias("n"))
    r = cells.withColumn("_r", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("n"))))
    return r.groupBy("dataset").agg(F.sum("n").alias("missing"), F.count("*").alias("cells"), (F.sum(F.when(F.col("_r") <= top, F.col("n")).otherwise(0)) * 100 / F.sum("n")).alias("top_pct"))


def singles_in_ranges(ranges: DataFrame, singles: DataFrame) -> DataFrame:
    """Single addresses inside a range of their street and municipality, ends included.

    A number lies in a range where the highest end of all ranges that start at or below it reaches it: a running maximum over
    distinct numbers of a street, so neither side is multiplied.
    """
    key = ["muni", "street_norm"]
    lo, hi = F.least("lo_num", "hi_num"), F.greatest("lo_num", "hi_num")
    r = ranges.groupBy(*key, lo.alias("n")).agg(F.max(hi).alias("_hi")).select(*key, "n", "_hi", F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_c"))
    s = singles.where("lo_num is not null").groupBy(*key, F.col("lo_num").alias("n")).agg(F.count("*").alias("_c")).select(*key, "n", F.lit(None).cast("bigint").alias("_hi"), F.lit(1).alias("_kind"), "_c")
    r = r.withColumns({"_hi": F.col("_hi").cast("bigint"), "n": F.col("n").cast("bigint")})
    u = r.unionByName(s.withColumn("n", F.col("n").cast("bigint")))
    w = Window.partitionBy(*key).orderBy("n", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = u.withColumn("_reach", F.max("_hi").over(w)).where("_kind = 1")
    return u.groupBy("muni").agg(F.sum("_c").alias("singles"), F.sum(F.when(F.col("_reach") >= F.col("n"), F.col("_c")).otherwise(0)).alias("inside"))
