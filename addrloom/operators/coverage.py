"""Ranges, streets and the reverse sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrloom.functions.text import first_int, housenumber_tokens, normalize_street, sqlite_int
from addrloom.operators.orphans import NODE, index_counts, number_nodes, number_places, plain_number
from addrloom.operators.streets import with_streets
from addrloom.operators.sums import ordered
from addrloom.plans.stage import materialize


def span_bucket(span: Column) -> Column:
    """A13"""
    return F.when(span <= 1, "1").when(span == 2, "2").when(span <= 9, "3-9").when(span <= 49, "10-49").when(span <= 99, "50-99").otherwise("100+")


def numbers_within(ranges: DataFrame, numbers: DataFrame, group: list[str], key: str) -> DataFrame:
    """(key, present): for each range (key, group, lo, hi, step of 1 or 2) how many of ``numbers`` (group, n; distinct) lie in it, by its step.

    Two marks for each range in the sorted numbers of its group and parity: the running count at its end less that before its start.
    So a range costs the same however long it is.
    """
    parity = lambda c: F.pmod(F.col(c), F.lit(2)).cast("int")
    shape = lambda df, n, at, c, k: df.select(*group, "p", n.cast("bigint").alias("n"), F.lit(at).alias("at"), c.alias("c"), k.alias("key"))
    none, kind = F.lit(0).cast("bigint"), ranges.schema[key].dataType
    marks = ranges.where("lo <= hi").withColumn("p", F.explode(F.when(F.col("step") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(parity("lo")))))
    u = shape(numbers.withColumn("p", parity("n")), F.col("n"), 1, F.lit(1).cast("bigint"), F.lit(None).cast(kind))
    u = u.union(shape(marks, F.col("lo"), 0, none, F.col(key))).union(shape(marks, F.col("hi"), 2, none, F.col(key)))
    w = Window.partitionBy(*group, "p").orderBy("n", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = u.withColumn("seen", F.sum("c").over(w)).where("at <> 1")
    return u.groupBy(F.col("key").alias(key)).agg(F.sum(F.when(F.col("at") == 2, F.col("seen")).otherwise(-F.col("seen"))).alias("present"))


def range_coverage(ranges: DataFrame, singles: DataFrame) -> DataFrame:
    """How many of a range's numbers, always by 2 from its low end, are single addresses of its street and municipality."""
    r = ranges.select("candidate_id", "muni", "street_norm", F.least("lo_num", "hi_num").alias("lo"), F.greatest("lo_num", "hi_num").alias("hi"), F.lit(2).alias("step"))
    s = singles.where("lo_num is not null").select("muni", "street_norm", F.col("lo_num").alias("n")).distinct()
    g = r.groupBy("candidate_id").agg(F.sum(F.floor((F.col("hi") - F.col("lo")) / 2) + 1).cast("bigint").alias("parity_total"))
    g = g.join(numbers_within(r, s, ["muni", "street_norm"], "candidate_id"), "candidate_id", "left").select("candidate_id", F.coalesce("present", F.lit(0)).alias("parity_present"), "parity_total")
    return g.withColumn("category", F.when(F.col("parity_present") == 0, "uncovered").when(F.col("parity_present") == F.col("parity_total"), "full").otherwise("partial"))


def range_hits(ranges: DataFrame, features: DataFrame) -> DataFrame:
    """For each range the numbers that features carry (hits) of all (total), and the missing ones as runs: structs (first, last, step).

    Ranges and numbers meet in the nodes of a tree; a range costs some rows for each digit and one for each hit, and
    gives one run more than hits at most, however long it is.
    """
    numbers = features.select("street_norm", F.explode(housenumber_tokens(F.col("housenumber"))).alias("token")).distinct()
    numbers = numbers.select("street_norm", plain_number(F.col("token")).alias("n")).where("n IS NOT NULL")
    r = ranges.where("lo_num <= hi_num").select("candidate_id", "street_norm", F.col("lo_num").cast("bigint").alias("lo"), F.col("hi_num").cast("bigint").alias("hi"))
    placed = materialize(number_nodes(r), "range-nodes")
    top = placed.agg(F.max("level")).first()[0] or 0
    hits = placed.join(number_places(numbers, top), ["street_norm", *NODE]).groupBy("candidate_id").agg(F.array_sort(F.collect_list("n")).alias("found"))
    j = r.join(hits, "candidate_id", "left").withColumn("step", F.when(F.pmod("lo", F.lit(2)) == F.pmod("hi", F.lit(2)), 2).otherwise(1).cast("bigint"))
    ends = F.concat(F.array(F.col("lo") - F.col("step")), F.coalesce("found", F.array().cast("array<bigint>")), F.array(F.col("hi") + F.col("step")))
    gap = lambda i: F.struct((F.get("ends", i) + F.col("step")).alias("first"), (F.get("ends", i + 1) - F.col("step")).alias("last"), F.col("step"))
    runs = F.filter(F.transform(F.sequence(F.lit(0), F.size("ends") - 2), gap), lambda g: g["first"] <= g["last"])
    j = j.withColumn("ends", ends)
    return j.select("candidate_id", (F.size("ends") - 2).cast("bigint").alias("hits"), (F.floor((F.col("hi") - F.col("lo")) / F.col("step")) + 1).cast("bigint").alias("total"), runs.alias("missing"))


def run_list(runs: Column) -> Column:
    """The numbers of missing runs, separated by commas."""
    return F.array_join(F.flatten(F.transform(runs, lambda g: F.transform(F.sequence(g["first"], g["last"], g["step"]), lambda n: n.cast("string")))), ",")


def street_match(cands: DataFrame, features: DataFrame) -> DataFrame:
    """Streets of both sides with counts and a spelling: matched, missing or extra."""
    a = cands.where("street_norm <> ''").groupBy("street_norm").agg(F.count("*").alias("n_source"), F.min("street").alias("source_name"))
    b = features.where("street_norm <> ''").groupBy("street_norm").agg(F.count("*").alias("n_osm"), F.min("street").alias("osm_name"))
    j = a.join(b, "street_norm", "full_outer")
    kind = F.when(F.col("n_osm").isNull(), "missing").when(F.col("n_source").isNull(), "extra").otherwise("matched")
    return j.select("street_norm", F.coalesce("n_source", F.lit(0)).alias("n_source"), F.coalesce("n_osm", F.lit(0)).alias("n_osm"), "source_name", "osm_name", kind.alias("kind"))


def street_lists(streets: DataFrame) -> DataFrame:
    """The streets of ``street_match`` with their place in the list of their kind: most addresses first, then by name."""
    most = F.greatest("n_source", "n_osm")
    ranked = ordered(streets.withColumn("_most", -most), [F.col("kind"), F.col("_most"), F.col("street_norm")])
    first = streets.groupBy("kind").agg(F.count("*").alias("_n"))
    before = first.select("kind", F.coalesce(F.sum("_n").over(Window.orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each kind
    return ranked.join(F.broadcast(before), "kind").withColumn("place", (F.col("rank") - F.col("_before")).cast("int")).drop("rank", "_most", "_before")


def in_list_order(rows: DataFrame) -> DataFrame:
    """Entries by lower-case street, leading number and number as written: a range sort, so no task holds them all."""
    return rows.withColumns({"street_key": F.lower(F.coalesce("street", F.lit(""))), "number_key": first_int(F.col("housenumber"))}).orderBy("street_key", "number_key", "housenumber")


def in_drift_order(rows: DataFrame) -> DataFrame:
    """Flags of a street by run, numeric start of the number (0 without one) and number."""
    return rows.withColumn("number_key", sqlite_int(F.col("housenumber"))).orderBy("run_id", "number_key", "housenumber")


def reverse_sweep(features: DataFrame, index: DataFrame) -> DataFrame:
    """Node features by the share of their numbers that the source's index knows, and the unknown ones."""
    t = features.where((F.col("osm_type") == "node") & ~F.col("is_poi") & (F.col("street_norm") != "")).select("osm_id", "street_norm", F.posexplode(housenumber_tokens(F.col("housenumber"))).alias("pos", "token"))
    keys = index_counts(index, t.select("street_norm", "token").distinct())
    j = t.join(keys.select("street_norm", "token", F.lit(True).alias("known")), ["street_norm", "token"], "left")
    unknown = F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.struct("pos", "token"))))
    return j.groupBy("osm_id").agg(F.count("known").alias("matched"), F.count("*").alias("parts"), F.array_join(F.transform(unknown, lambda u: u["token"]), ";").alias("missing_parts"))


def categories(features: DataFrame) -> DataFrame:
    """The overlapping kinds of multi-valued numbers and corner lots, a row for each."""
    hn, street = F.col("housenumber"), F.col("street")
    kinds = [
        (F.contains(hn, F.lit(";")), "semicolon"), (F.contains(hn, F.lit(",")), "comma"), (F.contains(hn, F.lit("/")) & ~hn.rlike(r"^\s*\d+\s+\d+/\d+\s*$|^\s*\d+/\d+\s*$"), "slash"),
        (hn.rlike(r"^\s*\d+\s*-\s*\d+\s*$"), "range"), (hn.rlike(r"^\s*\d+[A-Za-z]+\s*-\s*\d+[A-Za-z]+\s*$"), "letter_range"),
        (hn.rlike(r"^\s*\d+\s+\d+/\d+\s*$|^\s*\d+/\d+\s*$"), "fraction"), (F.contains(street, F.lit(";")) | F.contains(street, F.lit(",")), "corner_lot"),
    ]
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for c, k in kinds]), lambda k: k.isNotNull())
    return features.select("osm_id", "osm_type", F.explode(found).alias("category"))


def with_street(osm: DataFrame) -> DataFrame:
    return with_streets(osm, {"street_norm": normalize_street})
