"""Before and after an upload: guards against duplicates, changeset tags, outcome of a run, and whether a run is still valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrloom.operators.state import cross_run_duplicates, intra_run_duplicates

KEY = ["run_id", "candidate_id"]
# Fixed values
SOFTWARE_TAGS = {"import": "yes", "bot": "no", "created_by": "addrloom"}
STALE_DAYS = 14


def guarded(candidates: DataFrame) -> DataFrame:
    """The stage of each candidate after both guards, and which one skipped it.

    First approved rows go whose id another run has uploaded, then, of those left, all but the lowest id at an address of a run.
    """
    crossed = cross_run_duplicates(candidates).select(*KEY, F.lit("cross_run").alias("skipped_as"))
    c = candidates.join(crossed, KEY, "left")
    c = c.withColumn("stage", F.when(F.col("skipped_as").isNotNull(), "SKIPPED").otherwise(F.col("stage")))
    twins = intra_run_duplicates(c).select(*KEY, F.lit(True).alias("_twin"))
    c = c.join(twins, KEY, "left")
    twin = F.coalesce("_twin", F.lit(False))
    return c.withColumns({"stage": F.when(twin, "SKIPPED").otherwise(F.col("stage")), "skipped_as": F.when(twin, "intra_run").otherwise(F.col("skipped_as"))}).drop("_twin")


def uploaded_outside(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """Candidates after their runs were uploaded by other means: guarded first, then all approved ones count as uploaded."""
    c = guarded(candidates).join(runs.select("run_id", F.lit(True).alias("_up")), "run_id", "left")
    return c.withColumn("stage", F.when(F.col("_up") & (F.col("stage") == "APPROVED"), "UPLOADED").otherwise(F.col("stage"))).drop("_up")


def outcome(approved: DataFrame, mapping: DataFrame) -> DataFrame:
    """The status of each run after an upload: uploaded, or needs_attention with a message where items have no new id.

    ``approved``: run_id, local_node_id; ``mapping``: run_id, old_id, new_id. Items count by what was sent and what came back.
    """
    back = mapping.groupBy("run_id").agg(F.count("*").alias("_back"))
    missing = approved.join(mapping.select("run_id", F.col("old_id").alias("local_node_id")), ["run_id", "local_node_id"], "left_anti").groupBy("run_id").agg(F.count("*").alias("_missing"))
    j = approved.select("run_id").distinct().join(back, "run_id", "left").join(missing, "run_id", "left")
    n, k = F.coalesce("_back", F.lit(0)), F.coalesce("_missing", F.lit(0))
    message = F.when(k > 0, F.concat(F.lit("partial upload: "), k.cast("string"), F.lit(" of "), (n + k).cast("string"), F.lit(" items unmapped")))
    return j.select("run_id", F.when(k > 0, "needs_attention").otherwise("uploaded").alias("upload_status"), message.alias("message"))


def changeset_tags(runs: DataFrame, template: str, city: str, source: str, plan: str) -> DataFrame:
    """run_id and the seven tags of its changeset as a map; ``template`` may name {run_name} and {city}. No plan is an error."""
    if not plan:
        raise ValueError("a changeset must name the page of its import plan")
    comment = F.replace(F.replace(F.lit(template), F.lit("{run_name}"), F.col("name")), F.lit("{city}"), F.lit(city))
    tags = {"comment": comment, "source": F.lit(source), **{k: F.lit(v) for k, v in SOFTWARE_TAGS.items()}, "import:client_token": F.col("client_token"), "import_plan": F.lit(plan)}
    return runs.select("run_id", F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), v)]).alias("tags"))


def extract_status(downloaded: Column, now: Column, days: float = STALE_DAYS) -> Column:
    """Missing without an extract, stale if older than ``days`` or of unknown age, else fresh."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(downloaded))) / 86400.0
    return F.when(downloaded.isNull(), "missing").when(age.isNull() | (age > days), "stale").otherwise("fresh")


def runnable(runs: DataFrame, snapshots: DataFrame, now: Column) -> DataFrame:
    """For each run (run_id, snapshot_id, extract_at) whether its snapshot is still the latest and its extract recent enough to conflate."""
    latest = snapshots.where("skipped = 0").agg(F.max("id").alias("_latest"))
    j = runs.join(F.broadcast(latest), F.lit(True), "left")  # one row
    status = extract_status(F.col("extract_at"), now)
    changed = ~F.col("snapshot_id").eqNullSafe(F.col("_latest"))
    return j.select("run_id", changed.alias("snapshot_changed"), status.alias("extract"), (~changed & (status == "fresh")).alias("may_run"))
