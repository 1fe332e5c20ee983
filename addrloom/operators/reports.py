"""Reports over candidates, runs, features, histories and the audit log."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from addrloom.functions.geo import box_overlap, haversine_asin


def counts(df: DataFrame, *by: str) -> DataFrame:
    """A01, A03"""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def address_collisions(cands: DataFrame) -> DataFrame:
    """Addresses under more than one municipality."""
    return cands.groupBy("address_full").agg(F.countDistinct("muni").alias("munis")).where("munis > 1")


def drift_by_street(results: DataFrame, cands: DataFrame | None = None) -> DataFrame:
    """Flags of the drift check for each street, with runs and a spelling.

    ``cands``: candidates with street_norm and street; none where the results stand beside these columns, a null street included.
    """
    flags = results.where("check_id = 'match_number_drift' AND verdict = 'FLAG'")
    j = flags if cands is None else flags.select("run_id", "candidate_id").hint("merge").join(cands.select("run_id", "candidate_id", "street_norm", "street"), ["run_id", "candidate_id"])
    return j.groupBy("street_norm").agg(F.count("*").alias("flags"), F.countDistinct("run_id").alias("runs"), F.max("street").alias("spelling"))


def systemic_runs(results: DataFrame, min_flags: int) -> DataFrame:
    """Runs with many drift flags."""
    return results.where("check_id = 'match_number_drift' AND verdict = 'FLAG'").groupBy("run_id").agg(F.count("*").alias("flags")).where(F.col("flags") >= min_flags)


def idle_gaps(events: DataFrame, minutes: float = 15) -> DataFrame:
    """Gaps of more than ``minutes`` between a key's successive events, before each event that ends one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))
    return events.select("user_id", "event_id", gap.alias("gap_s")).where(F.col("gap_s") > minutes * 60)


def activity(events: DataFrame) -> DataFrame:
    """Events, first and last time and clicks of each key."""
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def changed_versions(versions: DataFrame) -> DataFrame:
    """For each element its versions, editors, and versions whose tags differ from the one before."""
    w = Window.partitionBy("element_id").orderBy("version")
    v = versions.withColumn("_before", F.lag("tags").over(w))
    changed = F.col("_before").isNotNull() & ~F.col("tags").eqNullSafe(F.col("_before"))
    return v.groupBy("element_id").agg(F.count("*").alias("n_versions"), F.countDistinct("editor").alias("editors"), F.count_if(changed).alias("tag_changes"))


def latest_per(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """The latest row of each key, as an aggregation."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_l")).select(*keys, "_l.*")


def top_per(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def suffixed_ids(df: DataFrame, slug: str, order: list[str]) -> DataFrame:
    """Unique ids in order: the slug, or it with -2, -3 ..., whichever no row before has taken.

    Only slugs that differ in such endings can collide, so each family of them is numbered in turn, in one task; a family has as
    many rows as there are tiles of one name.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("tile_id", T.StringType())])

    def number(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*order, slug], kind="stable")
        used, after, ids = set(), {}, []
        for base in rows[slug]:
            name, i = base, after.get(base, 2)
            while name in used:
                name, i = f"{base}-{i}", i + 1
            used.add(name)
            after[base] = i
            ids.append(name)
        return rows.assign(tile_id=ids)

    return df.groupBy(F.regexp_replace(slug, r"(-\d+)+$", "").alias("_family")).applyInPandas(number, schema)


def overlap_census(points: DataFrame, colocated_m: float = 150.0, least_overlap: float = 0.001, labels: int = 3) -> DataFrame:
    """Pairs of datasets whose boxes overlap and that share colocated keys.

    ``points``: dataset, number, street_norm, muni, lat, lon. A key counts by one point of its dataset, the one with the largest
    (lat, lon). shared: keys of both; colocated: those less than ``colocated_m`` apart; labels: the most frequent pairs of
    municipalities among these. Keys meet in an equi join, a row for each dataset and key.
    """
    own = points.where("number <> '' AND street_norm <> '' AND lat IS NOT NULL AND lon IS NOT NULL")
    keys = own.groupBy("dataset", "number", "street_norm").agg(F.max(F.struct("lat", "lon", "muni")).alias("p"))
    boxes = keys.groupBy("dataset").agg(F.struct(F.min("p.lat").alias("min_lat"), F.min("p.lon").alias("min_lon"), F.max("p.lat").alias("max_lat"), F.max("p.lon").alias("max_lon")).alias("box"))
    other = keys.select(F.col("dataset").alias("other"), "number", "street_norm", F.col("p").alias("q"))
    pairs = keys.join(other, ["number", "street_norm"]).where("dataset < other")
    near = F.coalesce(haversine_asin(F.col("p.lat"), F.col("p.lon"), F.col("q.lat"), F.col("q.lon")) < colocated_m, F.lit(False))
    by = ["dataset", "other"]
    found = pairs.withColumns({"near": near, "label": F.concat_ws("=", F.coalesce("p.muni", F.lit("?")), F.coalesce("q.muni", F.lit("?")))}).groupBy(*by, "label").agg(F.count("*").alias("n"), F.count_if("near").alias("c"))
    top = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("c"), "label"))
    found = found.withColumn("_top", top).groupBy(*by).agg(F.sum("n").alias("shared"), F.sum("c").alias("colocated"), F.array_sort(F.collect_list(F.when((F.col("_top") <= labels) & (F.col("c") > 0), F.struct("_top", "label", "c")))).alias("_l"))
    box = lambda c: boxes.select(F.col("dataset").alias(c), F.col("box").alias(f"_{c}"))
    found = found.join(box("dataset"), "dataset").join(box("other"), "other").withColumn("overlap", box_overlap("_dataset", "_other"))
    listed = F.array_join(F.transform("_l", lambda x: F.concat_ws(":", x["label"], x["c"].cast("string"))), ", ")
    return found.where((F.col("overlap") >= least_overlap) & (F.col("colocated") > 0)).select(*by, "shared", "colocated", "overlap", listed.alias("labels"))


def flag_reasons(results: DataFrame) -> DataFrame:
    """The distinct reasons of each run's flags."""
    return results.where("verdict = 'FLAG' AND reason_code <> ''").select("run_id", "reason_code").distinct()


def last_events(events: DataFrame, where: Column | None = None, most: int = 500) -> DataFrame:
    """The newest events that pass the filter, a top-k."""
    return (events if where is None else events.where(where)).orderBy(F.desc("ts"), F.desc("event_id")).limit(most)


def gap(cands: DataFrame, features: DataFrame) -> DataFrame:
    """Source keys without a feature, and how many of those are on a known street."""
    s = cands.select("housenumber", "street_norm").where("housenumber is not null").distinct()
    f = features.select(F.col("num").alias("housenumber"), "street_norm").distinct()
    missing = s.join(f, ["housenumber", "street_norm"], "left_anti")
    known = f.select("street_norm").distinct().withColumn("known", F.lit(True))
    return missing.join(known, "street_norm", "left").agg(F.count("*").alias("missing"), F.count("known").alias("on_known_street"))
