"""Snapshot history of a source: freshness, active rows, deltas since a watermark, unit election."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrloom.functions.text import id_order


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The largest id that wasn't skipped, in one row; an error where there is none."""
    found = snapshots.where(F.col("skipped") == 0).agg(F.max("id").alias("snapshot_id"))
    kind = found.schema["snapshot_id"].dataType
    return found.select(F.coalesce("snapshot_id", F.raise_error(F.lit("no snapshot that wasn't skipped")).cast(kind)).alias("snapshot_id"))


def snapshot_age(snapshots: DataFrame, now: Column, stale_after_days: float = 14) -> DataFrame:
    """Age in days and whether it is over the limit; unknown times give no age and aren't stale."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(F.col("downloaded")))) / 86400.0
    return snapshots.where(F.col("skipped") == 0).orderBy(F.col("id").desc()).limit(1).select("id", "downloaded", age.alias("age_days"), F.coalesce(age > stale_after_days, F.lit(False)).alias("is_stale"))


def snapshot_date(filename: Column, downloaded: Column) -> Column:
    """S04"""
    return F.coalesce(F.nullif(F.regexp_extract(filename, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), downloaded)


def active(src: DataFrame, snapshot: int) -> DataFrame:
    return src.where(F.col("max_snapshot_id") == snapshot)


def has_status(src: DataFrame, values: list[str]) -> DataFrame:
    """an unknown status is out; goes before any ranking."""
    return src.where(F.col("status").isin(values))


def unit_of(df: DataFrame) -> Column:
    return F.nullif(F.nullif(F.col("unit"), F.lit("None")), F.lit(""))


def collapse_units(df: DataFrame, keys: tuple[str, ...] = ("number", "street", "muni")) -> DataFrame:
    """One row for each civic address, the one without unit first, then the lowest identity. An aggregation, so large stacks combine map-side."""
    first = F.struct(unit_of(df).isNotNull().alias("has_unit"), id_order(F.col("identity_key")).alias("o"), F.struct(*df.columns).alias("row"))
    return df.withColumn("_f", first).groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min("_f").alias("_f")).select("_f.row.*")


def new_since(src: DataFrame, watermark: int, snapshot: int) -> DataFrame:
    """Active rows of identities that first appear after the watermark."""
    first = src.groupBy("identity_key").agg(F.min("min_snapshot_id").alias("first_seen")).where(F.col("first_seen") > watermark)
    return active(src, snapshot).join(first, "identity_key")


def retired_since(src: DataFrame, watermark: int, snapshot: int) -> DataFrame:
    """Last rows of identities that ended within the window, without those re-issued under another identity.

    A null number or street equals nothing, so such rows stay.
    """
    last = src.groupBy("identity_key").agg(F.max("max_snapshot_id").alias("last_seen")).where((F.col("last_seen") >= watermark) & (F.col("last_seen") < snapshot))
    gone = src.join(last, (src["identity_key"] == last["identity_key"]) & (src["max_snapshot_id"] == last["last_seen"])).select(src["*"], "last_seen")
    now = active(src, snapshot).select(F.col("number").alias("_n"), F.col("street").alias("_s"), F.col("identity_key").alias("_k"))
    return gone.join(now, (F.col("number") == F.col("_n")) & (F.col("street") == F.col("_s")) & (F.col("identity_key") != F.col("_k")), "left_anti")


def first_seen_window(src: DataFrame) -> DataFrame:
    """First and last snapshot of each identity."""
    return src.groupBy("identity_key").agg(F.min("min_snapshot_id").alias("first_seen"), F.max("max_snapshot_id").alias("last_seen"))
