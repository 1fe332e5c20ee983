"""A lattice of addresses and map features derived from ``orders``, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

LATTICE = Path(__file__).with_name("lattice.sql").read_text().strip()
RUN_BLOCKS = 25


def lattice(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """src (address history), osm (features) or interp (interpolation ways)."""
    return spark.sql(f"{LATTICE} SELECT * FROM {name}".replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
