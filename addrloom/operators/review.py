"""Review: the queue, lists by stage, the map view about a candidate, interpolation lines, runs and their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrloom.functions.geo import in_box
from addrloom.functions.text import id_order, normalize_street
from addrloom.operators.features import tag_diff

KEYS = ["run_id", "candidate_id"]
SPAN_DEG, VIEW_ROWS = 0.03, 500


def conditions(poi_ack: bool = False, postcode: bool = False, verdicts: tuple[str, ...] = (), door_only: bool = False) -> Column:
    """the filters that all lists share."""
    found = F.lit(True)
    if poi_ack:
        found &= F.col("poi_id").isNotNull()
    if postcode:
        found &= F.coalesce(F.col("proposed_postcode") != "", F.lit(False))
    if verdicts:
        found &= F.col("verdict").isin(*verdicts)
    if door_only:
        found &= F.col("cls") == "Structure Entrance"
    return found


def has_reason(codes: Column, reasons: tuple[str, ...]) -> Column:
    """whether a comma-separated list holds any of the codes, as whole items."""
    return F.coalesce(F.arrays_overlap(F.split(codes, ","), F.array(*map(F.lit, reasons))), F.lit(False))


def queue(cands: DataFrame, items: DataFrame, statuses: tuple[str, ...] = ("OPEN",), auto: bool = False, reasons: tuple[str, ...] = (), offset: int = 0, limit: int | None = None, **filters) -> DataFrame:
    """Review items and, if asked for, approved candidates without one, by time of opening within a run.

    ``cands`` are conflated candidates with stage and stage_updated_at. Null times come first. Reasons leave no automatic rows.
    """
    shown = ["reason_code", "status", "opened_at", "address_full", "verdict"]
    c = cands.where(conditions(**filters))
    rows = items.where(F.col("status").isin(*statuses))
    rows = (rows.where(has_reason(F.col("reason_code"), reasons)) if reasons else rows).join(c, KEYS).select(*KEYS, *shown)
    if auto and not reasons:
        clean = c.where("stage = 'APPROVED'").join(items, KEYS, "left_anti")
        rows = rows.unionByName(clean.select(*KEYS, F.lit("auto_clean").alias("reason_code"), F.lit("AUTO_APPROVED").alias("status"), F.col("stage_updated_at").alias("opened_at"), "address_full", "verdict"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.coalesce("opened_at", F.lit("")), id_order(F.col("candidate_id"))))
    rows = rows.withColumn("position", place).where(F.col("position") > offset)
    return rows if limit is None else rows.where(F.col("position") <= offset + limit)


def detail(cands: DataFrame, results: DataFrame, features: DataFrame) -> DataFrame:
    """For each candidate what its page shows: its checks, its sibling's verdict, and the tags that differ from the feature it is compared with.

    That is its match, or, for a missing one with a neighbour on another street, the nearest of these. ``cands`` are conflated
    candidates, ``results`` those of all checks with details, ``features`` have osm_id, osm_type and tags.
    """
    told = results.groupBy(*KEYS).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "check_id", "verdict"))), ",").alias("checks"),
        F.max(F.when((F.col("check_id") == "nearby_street_mismatch") & (F.col("verdict") == "FLAG"), F.col("details"))).alias("_near"))
    first = F.substring_index(F.col("_near"), "@", 1)
    # sort-merge joins: a side that looks small on disk may fill the driver as a broadcast table
    other = cands.select("run_id", F.col("candidate_id").alias("sibling_id"), F.col("verdict").alias("sibling_verdict"))
    c = cands.hint("merge").join(told, KEYS, "left").hint("merge").join(other, ["run_id", "sibling_id"], "left")
    kind = F.coalesce("osm_type", F.when(F.col("verdict") == "MISSING", F.substring_index(first, "/", 1)))
    no = F.coalesce("osm_id", F.when(F.col("verdict") == "MISSING", F.substring_index(first, "/", -1).try_cast("bigint")))
    c = c.withColumns({"compared_type": kind, "compared_id": no, "_p": F.map_from_arrays(F.array(*map(F.lit, ("addr:housenumber", "addr:street"))), F.array("housenumber", "street"))})
    f = features.select(F.col("osm_type").alias("compared_type"), F.col("osm_id").alias("compared_id"), F.col("tags").alias("_o"))
    j = c.select(*KEYS, "compared_type", "compared_id", "_p").hint("merge").join(f, ["compared_type", "compared_id"])
    diff = tag_diff(j, "_p", "_o").where("status <> 'SAME'").groupBy(*KEYS).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "tag", "status"))), ",").alias("differs"))
    return c.hint("merge").join(diff, KEYS, "left").select(*KEYS, "verdict", "stage", "compared_type", "compared_id", "sibling_id", "sibling_verdict", "checks", "differs")


def listed(cands: DataFrame, items: DataFrame, stage: str, **filters) -> DataFrame:
    """Candidates of a stage with the status of their review, if there was one."""
    c = cands.where((F.col("stage") == stage) & conditions(**filters))
    return c.join(items.select(*KEYS, F.col("status").alias("review_status")), KEYS, "left")


def clamp(box: tuple[float, float, float, float], span: float = SPAN_DEG) -> tuple[float, float, float, float]:
    """a box wider or higher than the span becomes a square of that span about its middle."""
    if box[2] - box[0] <= span and box[3] - box[1] <= span:
        return box
    y, x = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    return y - span / 2, x - span / 2, y + span / 2, x + span / 2


def viewport(cands: DataFrame, items: DataFrame, features: DataFrame, run_id: int, focus: str, box: tuple[float, float, float, float], most: int = VIEW_ROWS) -> DataFrame:
    """The run's other candidates and the features within the box, up to ``most`` of either kind by id, without the focus and its match."""
    view = clamp(box)
    here = in_box(F.col("lat"), F.col("lon"), view)
    run = cands.where(F.col("run_id") == run_id)
    match = run.where((F.col("candidate_id") == focus) & F.col("osm_id").isNotNull()).select("osm_id", "osm_type")
    c = run.where(here & (F.col("candidate_id") != focus)).join(items.select(*KEYS, F.col("status").alias("review_status")), KEYS, "left")
    c = c.select(F.lit("candidate").alias("kind"), F.col("candidate_id").alias("id"), "verdict", "review_status").orderBy(id_order(F.col("id"))).limit(most)
    f = features.where(here).join(F.broadcast(match.limit(1)), ["osm_id", "osm_type"], "left_anti").orderBy("osm_id", "osm_type").limit(most)
    f = f.select(F.when(F.col("is_poi"), "poi").otherwise("address").alias("kind"), F.concat_ws("/", "osm_type", "osm_id").alias("id"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("review_status"))
    return c.unionByName(f)


def interpolation_lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each way by its first and last node: street (its own, else that of the first end that has one), the normalised streets of way and ends, ends found."""
    ends = ways.select("osm_id", "street", F.posexplode(F.array("n1", "n2")).alias("pos", "node"))
    n = nodes.where("osm_type = 'node' and lat is not null and lon is not null").select(F.col("osm_id").alias("node"), F.col("street").alias("_s"), "lat", "lon")
    j = ends.join(n, "node", "left").withColumn("_s", F.nullif("_s", F.lit("")))
    g = j.groupBy("osm_id").agg(F.max("street").alias("_w"), F.min_by("_s", F.when(F.col("_s").isNotNull(), F.col("pos"))).alias("_e"), F.collect_set(normalize_street(F.col("_s"))).alias("_n"),
                                F.count("lat").cast("int").alias("n_ends"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))
    own = F.when(F.coalesce(F.col("_w"), F.lit("")) != "", F.array(normalize_street(F.col("_w")))).otherwise(F.array())
    streets = F.array_sort(F.filter(F.array_union(own, "_n"), lambda s: s != ""))
    return g.select("osm_id", F.coalesce(F.nullif("_w", F.lit("")), "_e").alias("street"), streets.alias("streets"), "n_ends", "min_lat", "max_lat", "min_lon", "max_lon")


def pending_by_run(runs: DataFrame, cands: DataFrame) -> DataFrame:
    """All runs with the number of candidates that wait for review, 0 included."""
    n = cands.where("stage = 'REVIEW_PENDING'").groupBy("run_id").agg(F.count("*").alias("_n"))
    return runs.join(n, "run_id", "left").withColumn("pending", F.coalesce("_n", F.lit(0))).drop("_n")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest run (by created_at, then run_id) of each box, its corners rounded to 6 places."""
    corner = [F.round(c, 6).alias(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")]
    rest = [c for c in runs.columns if c not in ("min_lat", "min_lon", "max_lat", "max_lon")]
    g = runs.select(*corner, *rest).groupBy("min_lat", "min_lon", "max_lat", "max_lon").agg(F.max_by(F.struct(*rest), F.struct("created_at", "run_id")).alias("_r"))
    return g.select("min_lat", "min_lon", "max_lat", "max_lon", "_r.*")


def extremes(latest: DataFrame) -> DataFrame:
    """Of runs not uploaded with pending rows the hardest (most pending) and the easiest; the lower run_id on ties."""
    open_ = latest.where("upload_status is distinct from 'uploaded' and pending > 0")
    return open_.agg(F.max_by("run_id", F.struct("pending", -F.col("run_id"))).alias("hardest"), F.min_by("run_id", F.struct("pending", "run_id")).alias("easiest"))


def neighbours(latest: DataFrame, tiles: DataFrame) -> DataFrame:
    """For each tile with a run not uploaded the previous and next such run in the order of the tiles of its city."""
    w = Window.partitionBy("city").orderBy("tile_no")
    j = tiles.join(latest.where("upload_status is distinct from 'uploaded'"), ["min_lat", "min_lon", "max_lat", "max_lon"])
    return j.select("city", "tile_no", "run_id", F.lag("run_id").over(w).alias("prev_run"), F.lead("run_id").over(w).alias("next_run"))
