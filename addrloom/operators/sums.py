"""Running numbers and sums over any number of rows: within ranges of the order first, then over the ranges' totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrloom.plans.stage import materialize


def ordered(rows: DataFrame, order: list[Column], sums: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with rank (from 1 on) in ``order`` and, for each of ``sums`` (name: column), the sum over the rows before.

    A range shuffle, numbers within each range, and what the ranges before hold: only the totals, a row for each
    partition, meet in one task. Rows that are equal in ``order`` stay together.
    """
    sums = sums or {}
    parts = materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    totals = parts.groupBy("_part").agg(F.count("*").alias("_rows"), *[F.sum(c).alias(f"_all_{k}") for k, c in sums.items()])
    totals = totals.select("_part", *[zero(F.sum(c).over(earlier)).alias(f"_before{c}") for c in totals.columns[1:]])
    own = {"_n": F.count("*").over(before), **{f"_own_{k}": zero(F.sum(c).over(before)) for k, c in sums.items()}}
    found = parts.withColumns(own).join(F.broadcast(totals), "_part")  # a row for each partition
    return found.select(*rows.columns, (F.col("_n") + F.col("_before_rows") + 1).alias("rank"), *[(F.col(f"_own_{k}") + F.col(f"_before_all_{k}")).alias(k) for k in sums])


def counts_between(points: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """(key, n): for each of ``intervals`` (key, grp, low, high) the sum of n over ``points`` (grp, at, n) with low < at <= high.

    A sweep: points and both ends of the intervals in one order, whose running sums differ by what lies between. An
    interval is two rows, whatever its length and however many others there are.
    """
    kind = intervals.schema[key].dataType
    none = F.lit(None).cast(kind)
    rows = points.select("grp", F.col("at").cast("bigint"), F.lit(0).alias("mark"), F.col("n").cast("bigint"), none.alias("_key"))
    ends = F.explode(F.array(F.struct(F.col("low").cast("bigint").alias("at"), F.lit(-1).alias("mark")), F.struct(F.greatest("low", "high").cast("bigint").alias("at"), F.lit(1).alias("mark"))))
    marks = intervals.withColumn("e", ends).select("grp", "e.at", "e.mark", F.lit(0).cast("bigint").alias("n"), F.col(key).alias("_key"))
    run = ordered(rows.unionByName(marks), [F.col("grp"), F.col("at"), F.abs(F.col("mark"))], {"seen": "n"}).where("mark <> 0")
    return run.groupBy(F.col("_key").alias(key)).agg(F.sum(F.col("seen") * F.col("mark")).alias("n"))
