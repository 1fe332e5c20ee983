"""Tables with state: insert-if-absent, replace, partial upserts, review transitions, duplicate guards, upload acknowledgement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrloom.functions.text import id_order


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The first write of a key wins."""
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"))


def replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The last write of a key wins."""
    return old.join(new, keys, "left_anti").unionByName(new)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], only: list[str]) -> DataFrame:
    """Of rows that exist only the columns ``only`` change; others are added."""
    fresh = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_new"))
    j = old.withColumn("_old", F.lit(True)).join(fresh, keys, "full_outer")
    cols = [F.when(F.col("_new") & F.col("_old"), F.col(f"_{c}")).when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) if c in only else F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_{c}")) for c in old.columns if c not in keys]
    return j.select(*keys, *[e.alias(c) for e, c in zip(cols, [c for c in old.columns if c not in keys])])


#: States of a drifting street.
STREET_STATES = ("open", "dismissed", "fixed")


def put(old: DataFrame, new: DataFrame, key: str, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """Settings, toggles and states of streets (key, value, updated_at): the last value of ``new`` (by updated_at, then value) takes the place of the old.

    With ``allowed`` any other value is an error.
    """
    last = new.groupBy(key).agg(F.max(F.struct("updated_at", "value")).alias("_l")).select(key, F.col("_l.value").alias("value"), F.col("_l.updated_at").alias("updated_at"))
    if allowed:
        bad = F.raise_error(F.concat(F.lit("not a state: "), F.coalesce("value", F.lit("null"))))
        last = last.withColumn("value", F.when(F.col("value").isin(*allowed), F.col("value")).otherwise(bad))
    return replace(old.select(key, "value", "updated_at"), last, [key])


def upsert_verdicts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A changed verdict takes effect and clears exported_at; an equal one changes nothing."""
    fresh = new.select(*keys, F.col("verdict").alias("_v"), F.col("updated_at").alias("_t"))
    j = old.join(fresh, keys, "full_outer")
    changed = F.col("_v").isNotNull() & ~F.col("verdict").eqNullSafe(F.col("_v"))
    return j.select(*keys, F.coalesce("_v", "verdict").alias("verdict"), F.when(changed, F.col("_t")).otherwise(F.col("updated_at")).alias("updated_at"), F.when(~changed, F.col("exported_at")).alias("exported_at"))


def mark_exported(verdicts: DataFrame, exported: DataFrame, keys: list[str]) -> DataFrame:
    """Verdicts that an export (keys, at) took along; the first export's time stays."""
    j = verdicts.join(exported.select(*keys, F.col("at").alias("_at")), keys, "left")
    return j.withColumn("exported_at", F.coalesce("exported_at", "_at")).drop("_at")


def resolve(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions to stages; uploaded rows never change; an override is a decision against an automatic approval."""
    stage = F.create_map(*map(F.lit, ("APPROVED", "APPROVED", "REJECTED", "REJECTED", "DEFERRED", "REVIEW_PENDING", "OPEN", "REVIEW_PENDING")))
    j = candidates.join(decisions, ["run_id", "candidate_id"], "left")
    moves = F.col("decision").isNotNull() & (F.col("stage") != "UPLOADED")
    return j.select("run_id", "candidate_id", F.when(moves, F.try_element_at(stage, F.col("decision"))).otherwise(F.col("stage")).alias("stage"), (moves & (F.col("stage") == "APPROVED") & (F.col("decision") != "APPROVED")).alias("overrides_auto"))


def cross_run_duplicates(candidates: DataFrame) -> DataFrame:
    """Approved rows whose id is uploaded in another run, with the winner (the lowest run). Uploads are aggregated before the join."""
    won = candidates.where("stage = 'UPLOADED'").groupBy("candidate_id").agg(F.array_sort(F.collect_set("run_id")).alias("_runs"))
    j = candidates.where("stage = 'APPROVED'").join(won, "candidate_id")
    other = F.filter("_runs", lambda r: r != F.col("run_id"))
    return j.where(F.size(other) > 0).select("run_id", "candidate_id", F.get(other, F.lit(0)).alias("won_run"))


def intra_run_duplicates(candidates: DataFrame) -> DataFrame:
    """Approved rows of one run at one address and municipality (null equals null) but the lowest id; a null address is no duplicate."""
    a = candidates.where((F.col("stage") == "APPROVED") & F.col("address_full").isNotNull()).withColumn("_o", id_order(F.col("candidate_id")))
    keep = a.groupBy("run_id", "address_full", "muni").agg(F.min(F.struct("_o", "candidate_id")).alias("_k"), F.count("*").alias("_n")).where("_n > 1")
    keep = keep.select(F.col("run_id").alias("_r"), F.col("address_full").alias("_a"), F.col("muni").alias("_m"), F.col("_k.candidate_id").alias("kept"))
    j = a.join(keep, (F.col("run_id") == F.col("_r")) & (F.col("address_full") == F.col("_a")) & F.col("muni").eqNullSafe(F.col("_m")))
    return j.where(F.col("candidate_id") != F.col("kept")).select("run_id", "candidate_id", "kept")


def acknowledge(approved: DataFrame, mapping: DataFrame) -> DataFrame:
    """Uploads with their new ids; rows without one need attention."""
    j = approved.join(mapping.withColumnRenamed("old_id", "local_node_id"), "local_node_id", "left")
    return j.withColumn("upload_status", F.when(F.col("new_id").isNull(), "needs_attention").otherwise("uploaded"))


def without_unuploaded(runs: DataFrame, children: DataFrame, uploaded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs without uploads go, and all rows that hang on them."""
    kept = runs.join(uploaded, "run_id", "left_semi")
    return kept, children.join(kept, "run_id", "left_semi")
