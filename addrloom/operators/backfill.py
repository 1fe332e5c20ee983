"""A later check run over older runs, the dashboard of its flags, and manifests of uploads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from addrloom.functions.text import merge_codes
from addrloom.plans.stage import materialize

# Fixed values
DECIDED_STAGES = ("APPROVED", "REJECTED", "UPLOADED")
DECIDED_REVIEW = ("APPROVED", "REJECTED")
KEY = ["run_id", "candidate_id"]


def check_input(cands: DataFrame, conflation: DataFrame) -> DataFrame:
    """Every candidate with what conflation found, null where it hasn't run."""
    return cands.join(conflation, KEY, "left")


def fresh(results: DataFrame, stored: DataFrame) -> DataFrame:
    """Results of candidates that the check and version haven't seen; those it doesn't apply to aren't recorded."""
    return results.where("verdict <> 'SKIP'").hint("merge").join(stored, [*KEY, "check_id", "version"], "left_anti")


RESULT_PARTS = ["check_id", "version"]
RESULTS = "run_id bigint, candidate_id string, verdict string, severity string, reason_code string, n_details bigint, details string, check_id string, version int"


def store(results: DataFrame, path: str) -> None:
    """Appends results to those at ``path``, in a folder for each check and version."""
    results.where("verdict <> 'SKIP'").write.mode("append").partitionBy(*RESULT_PARTS).parquet(path)


def stored(spark: SparkSession, path: str, check: str, version: int) -> DataFrame:
    """What is stored for a check's version (RESULTS; columns that were not stored are null): the only folder that is read."""
    try:
        rows = spark.read.schema(RESULTS).parquet(path)
    except AnalysisException:  # nothing is stored yet
        rows = spark.createDataFrame([], RESULTS)
    return rows.where((F.col("check_id") == check) & (F.col("version") == version))


def lagging_runs(runs: DataFrame, spark: SparkSession, path: str, check: str, version: int) -> DataFrame:
    """The runs (run_id) that have no result of this version of the check."""
    return runs.select("run_id").distinct().join(stored(spark, path, check, version).select("run_id").distinct(), "run_id", "left_anti")


def backscan(c: DataFrame, features: DataFrame, path: str, check: str) -> DataFrame:
    """The check over all runs whose stored version lags, stored; returns what is new.

    ``c``: conflated candidates of all runs. Runs that are up to date are left out before anything is joined; the others are
    worked out together. Doing it again adds nothing.
    """
    from addrloom.operators.checks import VERSIONS, run_checks

    spark = c.sparkSession
    runs = materialize(lagging_runs(c, spark, path, check, VERSIONS[check]), "lagging-runs")
    new = materialize(run_checks(c.join(runs, "run_id", "left_semi"), features, (check,)).where("verdict <> 'SKIP'"), "backscan")
    store(new, path)
    return new


def route(results: DataFrame, cands: DataFrame | None, items: DataFrame, uploaded: DataFrame) -> DataFrame:
    """Where each result goes: passed, recorded_only (the run is uploaded or the row decided), new or merged into an open item.

    ``cands``: key and stage, None where the results have their candidate's stage; ``items``: key, status, reason_code; ``uploaded``: distinct run_id. reason_code is the item's afterwards, null
    where no item changes.
    """
    found = [*KEY, "check_id", "verdict"]
    j = results.select(*found, "stage") if cands is None else results.select(*found).hint("merge").join(cands.select(*KEY, "stage"), KEY, "left")
    j = j.hint("merge").join(items.select(*KEY, F.col("status").alias("_status"), F.col("reason_code").alias("_old")), KEY, "left").join(uploaded.select("run_id", F.lit(True).alias("_up")), "run_id", "left")
    decided = F.coalesce(F.col("_up") | F.col("stage").isin(*DECIDED_STAGES), F.col("stage").isin(*DECIDED_STAGES), F.lit(False)) | F.coalesce(F.col("_status").isin(*DECIDED_REVIEW), F.lit(False))
    way = F.when(F.col("verdict") != "FLAG", "passed").when(decided, "recorded_only").when(F.col("_status").isNull(), "new").otherwise("merged")
    reason = F.when(F.col("route") == "new", F.col("check_id")).when(F.col("route") == "merged", merge_codes(F.col("_old"), F.col("check_id")))
    return j.withColumn("route", way).select(*KEY, "route", reason.alias("reason_code"))


def dashboard(flags: DataFrame, cands: DataFrame, uploaded: DataFrame, status: DataFrame) -> DataFrame:
    """For each street its flags, how many are uploaded or pending, its runs, a spelling and its status (open unless set)."""
    j = flags.select(*KEY).hint("merge").join(cands.select(*KEY, "street_norm", "street"), KEY).join(uploaded.select("run_id", F.lit(1).alias("_up")), "run_id", "left")
    g = j.groupBy("street_norm").agg(F.count("*").alias("flags"), F.count("_up").alias("uploaded_flags"), F.countDistinct("run_id").alias("run_count"), F.max("street").alias("street"))
    g = g.join(status.select("street_norm", "status"), "street_norm", "left")
    return g.select("street_norm", "street", "flags", "uploaded_flags", (F.col("flags") - F.col("uploaded_flags")).alias("pending_flags"), "run_count", F.coalesce("status", F.lit("open")).alias("status"))


def dashboard_totals(streets: DataFrame) -> DataFrame:
    """Streets and flags for each status."""
    return streets.groupBy("status").agg(F.count("*").alias("streets"), F.sum("flags").alias("flags"), F.sum("uploaded_flags").alias("uploaded_flags"))


def street_detail(flags: DataFrame, conflated: DataFrame, features: DataFrame, uploaded: DataFrame) -> DataFrame:
    """Each flag with its street, number, matched feature, the closest other feature that the flag names and, if that is on the street, its place.

    ``flags``: key and details (id@metres, with bars between); ``features`` are those of all runs, each once (``first_of_runs``).
    A place is null where the closest one has another street.
    """
    c = conflated.select(*KEY, "street_norm", "housenumber", "verdict", "lat", "lon", F.col("osm_type").alias("matched_type"), F.col("osm_id").alias("matched_id"), F.col("dist").alias("matched_dist"))
    closest = F.substring_index(F.substring_index("details", "|", 1), "@", 1)
    j = flags.select(*KEY, closest.alias("closest")).hint("merge").join(c, KEY).join(uploaded.select("run_id", F.lit(True).alias("_up")), "run_id", "left")
    f = features.select(F.concat_ws("/", "osm_type", F.col("osm_id").cast("string")).alias("closest"), "street_norm", F.col("lat").alias("closest_lat"), F.col("lon").alias("closest_lon"))
    return j.hint("merge").join(f, ["closest", "street_norm"], "left").withColumn("uploaded", F.coalesce("_up", F.lit(False))).drop("_up")


def street_centres(detail: DataFrame) -> DataFrame:
    """The middle of each street's flagged points."""
    return detail.groupBy("street_norm").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("flags"))


def first_of_runs(elements: DataFrame, order: Column) -> DataFrame:
    """Elements of several runs, the first of each (osm_type, osm_id) by ``order``; a minimum, so copies combine before the shuffle."""
    rest = [c for c in elements.columns if c not in ("osm_type", "osm_id")]
    g = elements.groupBy("osm_type", "osm_id").agg(F.min_by(F.struct(*rest), order).alias("_e"))
    return g.select("osm_type", "osm_id", "_e.*")


def upload_items(cands: DataFrame, conflation: DataFrame) -> DataFrame:
    """Approved candidates with their conflation, ready for an upload."""
    return check_input(cands.where("stage = 'APPROVED'"), conflation)


def manifest(cands: DataFrame, runs: DataFrame) -> DataFrame:
    """Uploaded candidates with both their node and their run's changeset."""
    j = cands.where("stage = 'UPLOADED' AND osm_node_id IS NOT NULL").join(runs.where("changeset_id IS NOT NULL").select("run_id", "changeset_id"), "run_id")
    return j.select("run_id", "candidate_id", F.coalesce("address_full", F.lit("")).alias("address_full"), "osm_node_id", "changeset_id")


def pending_work(partials: DataFrame, threshold: int = 2) -> DataFrame:
    """Ranges with some but not all numbers on the map, split at the number missing; sort_key puts the few upwards and the many downwards.

    ``partials``: hits, total.
    """
    missing = F.col("total") - F.col("hits")
    kept = partials.where((F.col("hits") > 0) & (missing > 0)).withColumn("missing_count", missing)
    few = F.col("missing_count") <= threshold
    return kept.withColumns({"part": F.when(few, "few").otherwise("many"), "sort_key": F.when(few, F.col("missing_count")).otherwise(-F.col("missing_count"))})


def tile_of_run(run_name: Column) -> Column:
    """A run's name without its batch mark and date."""
    return F.regexp_replace(run_name, r"(-batch)?-\d{4}-\d{2}-\d{2}$", "")
