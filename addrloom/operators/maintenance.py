"""Maintenance between snapshots: the delta, features near it, retired points and their provenance, the publish gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrloom.operators.sums import counts_between

from addrloom.functions.geo import haversine, with_cells
from addrloom.sources import history

HALO, MIN_AROUND_M = 1.5, 150.0
#: From harmless to the one that asks for most care.
VERDICTS = ("already_deleted", "pristine_ours", "community_touched", "community_node", "unknown")


def delta(src: DataFrame, watermark: int, snapshot: int) -> DataFrame:
    """Rows that are new or retired in the window (watermark, snapshot]."""
    cols = ["identity_key", "number", "street", "lat", "lon"]
    new = history.new_since(src, watermark, snapshot).select(F.lit("new").alias("change"), *cols)
    return new.unionByName(history.retired_since(src, watermark, snapshot).select(F.lit("retired").alias("change"), *cols))


def around(features: DataFrame, points: DataFrame, match_m: float) -> DataFrame:
    """Features within max(1.5 x match radius, 150 m) of any point.

    Points are reduced to distinct places first, and each meets only the features of the grid cells about it.
    """
    reach = max(match_m * HALO, MIN_AROUND_M)
    p = points.where("lat is not null and lon is not null").select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).distinct()
    p = with_cells(p, reach, "_lat", "_lon", around=True)
    near = haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")) <= reach
    f = with_cells(features, reach)
    return f.join(p.withColumnsRenamed({"cy": "_cy", "cx": "_cx"}), (F.col("cy") == F.col("_cy")) & (F.col("cx") == F.col("_cx")) & near, "left_semi").drop("cy", "cx")


def provenance(versions: DataFrame, ours: tuple[str, ...]) -> DataFrame:
    """For each element who made and edited it, and what follows for its deletion.

    ``versions``: element_id, version, editor, visible, is_feature, geometry. First and last versions are minima by version, so
    long histories combine map-side.
    """
    mine = F.coalesce(F.col("editor").isin(*ours), F.lit(False))
    first = lambda c: F.min_by(c, "version")
    last = lambda c: F.max_by(c, "version")
    g = versions.withColumn("_mine", mine).groupBy("element_id").agg(
        F.count("*").alias("n_versions"), first("_mine").alias("created_by_import"), F.every("_mine").alias("_only"), F.count_if(~F.col("_mine")).alias("_others"),
        last("visible").alias("_visible"), last("is_feature").alias("is_feature"), (~first(F.struct("geometry")).eqNullSafe(last(F.struct("geometry")))).alias("geometry_changed"))
    verdict = F.when(~F.coalesce("_visible", F.lit(True)), "already_deleted").when(F.col("is_feature"), "keep_feature").when(F.col("_only"), "pristine_ours")
    verdict = verdict.when(F.col("created_by_import"), "community_touched").otherwise("community_node")
    edits = F.col("_others") - F.when(F.col("created_by_import"), 0).otherwise(1)
    return g.select("element_id", "n_versions", "created_by_import", edits.alias("n_community_edits"), "geometry_changed", "is_feature", verdict.alias("verdict"))


def retirements(retired: DataFrame, features: DataFrame, known: DataFrame, radius_m: float) -> DataFrame:
    """Retired points with the features that still carry their number and street nearby, and the most careful verdict over those that are no features of their own.

    ``retired``: candidate_id, housenumber, street_norm, lat, lon; ``known``: osm_id, verdict, is_feature (no row: unknown).
    """
    f = features.where("street_norm <> ''").select("osm_id", "num", F.col("street_norm").alias("_s"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    pairs = retired.join(f, (F.col("housenumber") == F.col("num")) & (F.col("street_norm") == F.col("_s")) & (haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")) <= radius_m))
    hits = pairs.select("candidate_id", "osm_id").distinct().join(known.select("osm_id", "verdict", "is_feature"), "osm_id", "left")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict")), F.lit(len(VERDICTS)))
    rank = F.when(~F.coalesce("is_feature", F.lit(False)), F.when(rank == 0, len(VERDICTS)).otherwise(rank))
    g = hits.groupBy("candidate_id").agg(F.count("*").alias("_n"), F.max(rank).alias("_rank"))
    j = retired.select("candidate_id").join(g, "candidate_id", "left")
    verdict = F.when(F.col("_n").isNull(), "no_match").when(F.col("_rank").isNull(), "keep_feature").otherwise(F.get(F.array(*map(F.lit, VERDICTS)), F.col("_rank").cast("int") - 1))
    j = j.select("candidate_id", F.coalesce("_n", F.lit(0)).alias("matches"), verdict.alias("verdict"))
    group = F.when(F.col("verdict") == "no_match", "no_match").when(F.col("verdict") == "keep_feature", "feature").when(F.col("verdict") == "pristine_ours", "safe").otherwise("caution")
    return j.withColumn("summary", group)


def window_counts(src: DataFrame, windows: DataFrame) -> DataFrame:
    """New and retired rows of each maintenance run's window: ``windows`` is a table (run_id, low, high) of the windows (low, high].

    Rows are counted by the snapshots that matter; windows and counts meet in sweeps, each window as two marks. Retired are
    the rows last seen in the window, less those whose address another identity has at its end: counted likewise, by that end.
    """
    forever = F.lit((1 << 62)).cast("bigint")
    seen = src.groupBy("identity_key").agg(F.min("min_snapshot_id").alias("_first"), F.max("max_snapshot_id").alias("_last"))
    rows = src.join(seen, "identity_key")
    firsts = rows.groupBy(F.col("max_snapshot_id").cast("bigint").alias("grp"), F.col("_first").alias("at")).agg(F.count("*").alias("n"))
    new = counts_between(firsts, windows.select("run_id", F.col("high").cast("bigint").alias("grp"), "low", forever.alias("high")), "run_id")

    lasting = lambda grp: windows.select("run_id", grp.cast("bigint").alias("grp"), (F.col("low") - 1).alias("low"), (F.col("high") - 1).alias("high")).where("high >= low")
    gone = rows.where(F.col("max_snapshot_id") == F.col("_last")).select("identity_key", "number", "street", "_last")
    lasts = gone.groupBy(F.lit(0).cast("bigint").alias("grp"), F.col("_last").alias("at")).agg(F.count("*").alias("n"))
    all_gone = counts_between(lasts, lasting(F.lit(0)), "run_id")
    # Who else has an address at a snapshot: the least and the greatest identity tell whether there is another one.
    ends = windows.select(F.col("high").alias("max_snapshot_id")).distinct()
    now = src.join(ends, "max_snapshot_id", "left_semi").groupBy("number", "street", F.col("max_snapshot_id").alias("_s")).agg(F.min("identity_key").alias("_a"), F.max("identity_key").alias("_b"))
    again = gone.join(now, ["number", "street"]).where((F.col("_s") > F.col("_last")) & ((F.col("_a") != F.col("identity_key")) | (F.col("_b") != F.col("identity_key"))))
    again = again.groupBy(F.col("_s").cast("bigint").alias("grp"), F.col("_last").alias("at")).agg(F.count("*").alias("n"))
    reissued = counts_between(again, lasting(F.col("high")), "run_id").withColumnRenamed("n", "_again")

    out = windows.select("run_id").join(new.withColumnRenamed("n", "_new"), "run_id", "left").join(all_gone, "run_id", "left").join(reissued, "run_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return out.select("run_id", zero("_new").alias("new_count"), (zero("n") - zero("_again")).alias("retired_count"))


def lagging(watermark_date: str | None, published_date: str | None) -> bool:
    """Whether the published snapshot is older than the watermark; an unknown watermark date never blocks, a missing publication does."""
    if watermark_date is None:
        return False
    return published_date is None or published_date[:10] < watermark_date[:10]


def advance(watermark: int, snapshot: int, watermark_date: str | None, published_date: str | None, force: bool = False) -> int:
    """The new watermark once a window is confirmed; raises while its publication is due."""
    if lagging(watermark_date, published_date) and not force:
        raise ValueError("the published snapshot is older than the watermark")
    return max(watermark, snapshot)
