"""Mixing sources to target weights, native: a time-varying curriculum.

Each source has a word budget (its target) and a weight schedule over training time 0..1. The integral of
the schedule, scaled to the target, is the source's cumulative demand; a document that sits at cumulative
words x of its source trains at the time where the demand reaches x. Documents are range-sorted by it.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrloom.llm.common import hidden, n_words, write_table

WEIGHTS = (3, 1, 2)
#: For each weight class: knots (time, relative weight) of a piecewise-linear schedule, from time 0 to 1.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))


def ordered(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``rows`` with rank (from 1) in ``order`` and, for each of ``sums``, the sum of that column over the rows before.

    In two levels: a range shuffle, numbers within each range, and what the ranges before hold. Only the second
    level meets in one task, a row for each partition of the shuffle.
    """
    parts = write_table(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = parts.groupBy("_part").agg(F.count("*").alias("_rows"), *[F.sum(c).alias(f"_sum_{k}") for k, c in sums.items()])
    totals = totals.select("_part", *[zero(F.sum(c).over(earlier)).alias(f"_before{c}") for c in totals.columns[1:]])
    own = {"_n": F.count("*").over(before), **{f"_own_{k}": zero(F.sum(c).over(before)) for k, c in sums.items()}}
    found = parts.withColumns(own).join(F.broadcast(totals), "_part")
    return found.select(*rows.columns, (F.col("_n") + F.col("_before_rows") + 1).alias("rank"), *[(F.col(f"_own_{k}") + F.col(f"_before_sum_{k}")).alias(k) for k in sums])


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = 150, cap: int = 2) -> DataFrame:
    """(src, source_size, class, target) from (src, source_size): one row for each source, however many there are.

    Sources in code-point order, null last, take the weights in turn. Targets are weight x level, at most
    ``cap`` times the source's size, and add up to the share of all sizes (or to all caps, if less): the
    level is where the sources with the smallest cap for their weight, summed up, leave just as much as
    the others take. That is the fixed point of resharing the excess.
    """
    n = len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("class") + 1).cast("int")).cast("long")
    t = ordered(sizes, [F.col("src").asc_nulls_last()], {}).withColumn("class", ((F.col("rank") - 1) % n).cast("int")).withColumn("w", w).drop("rank")
    t = t.withColumn("_per_weight", F.col("source_size") / F.col("w"))
    t = ordered(t, [F.col("_per_weight"), F.col("src").asc_nulls_last()], {"capped": "source_size", "w_before": "w"})
    all_words, all_w = (x or 0 for x in t.agg(F.sum("source_size"), F.sum("w")).first())
    # level x 100, times open_w: what is left when the sources before this one are capped
    t = t.withColumns({"open_w": F.lit(all_w) - F.col("w_before"), "rest": F.lit(share_percent * all_words) - F.lit(100 * cap) * F.col("capped")})
    is_open = F.col("rest") * F.col("w") <= F.lit(100 * cap) * F.col("source_size") * F.col("open_w")
    first = t.where(is_open).agg(F.min(F.struct("rank", "rest", "open_w"))).first()[0]
    target = (F.lit(cap) * F.col("source_size")).cast("double")
    if first is not None:
        level = (F.lit(first.rest) * F.col("w")).cast("double") / F.lit(100 * first.open_w).cast("double")
        target = F.when(F.col("rank") >= first.rank, level).otherwise(target)
    return t.select("src", "source_size", "class", target.alias("target"))


def _inverse(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of the schedule has reached ``share`` (0..1) of its whole."""
    pieces, done = [], 0.0
    for (t0, a), (t1, b) in zip(knots, knots[1:]):
        pieces.append((t0, t1, a, b, done))
        done += (t1 - t0) * (a + b) / 2
    out = None
    for t0, t1, a, b, before in reversed(pieces):
        x = share * F.lit(done) - F.lit(before)
        slope = (b - a) / (t1 - t0)
        if slope == 0:
            t = F.lit(t0) + x / F.lit(a)
        else:
            t = F.lit(t0) + (F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * x, F.lit(0.0))) - F.lit(a)) / F.lit(slope)
        out = t if out is None else F.when(share * F.lit(done) <= F.lit(before + (t1 - t0) * (a + b) / 2), t).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def plan_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, schedules=SCHEDULES, share_percent: int = 150, cap: int = 2, rows_per_slot: int = 2000) -> DataFrame:
    """``docs`` with size, source_size, target, passes, taken and positions (an array, one for each pass).

    A source is read in the order of an md5 of doc_id and text; pass p of a document whose words follow c others of
    its source is taken if the middle of its words, p x source_size + c + size / 2, is within the target. So
    the words taken differ from the target by half a document at most. Documents without words are never
    taken. The running sum is in three levels, ranges of the md5, slots of a range and rows of a slot, so that no
    source meets in one task; the number of slots grows with the rows. Null and repeated doc_ids are spread by their
    texts; rows that repeat are documents of their own, null sources are one source, an empty table gives no rows.
    """
    d, names = _plan(docs, weights, schedules, share_percent, cap, rows_per_slot)
    return d.select(*names, *[F.col(f"_{c}").alias(c) for c in ("size", "source_size", "target", "passes", "taken", "positions")])


def _plan(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share_percent: int = 150, cap: int = 2, rows_per_slot: int = 2000) -> tuple[DataFrame, list[Column]]:
    """plan_mix with all columns under hidden names, and the way back to those of ``docs``."""
    rows = docs.count()
    digits = max(3, ceil(log(rows / rows_per_slot, 16))) if rows > rows_per_slot else 3
    d, names = hidden(docs, "doc_id", "source", "text")
    order = F.md5(F.concat_ws(":", F.col("_need_doc_id").cast("string"), F.md5(F.col("_need_text"))))
    d = d.withColumns({"_size": n_words(F.col("_need_text")), "_order": order}).withColumn("_slot", F.substring("_order", 1, digits)).drop("_need_text")
    slots = d.groupBy(F.col("_need_source").alias("_src"), F.col("_slot").alias("_at_slot")).agg(F.sum("_size").alias("words"))
    slots = write_table(slots.withColumn("_range", F.substring("_at_slot", 1, digits // 2)), "mix-slots")
    ranges = slots.groupBy("_src", "_range").agg(F.sum("words").alias("words"))
    targets = source_targets(ranges.groupBy(F.col("_src").alias("src")).agg(F.sum("words").alias("source_size")), weights, share_percent, cap)
    before = lambda *w: F.coalesce(F.sum("words").over(Window.partitionBy(*w[:-1]).orderBy(w[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(F.col("_src").alias("_s"), F.col("_range").alias("_r"), before("_src", "_range").alias("_earlier"))
    ranges = ranges.join(targets, F.col("_s").eqNullSafe(F.col("src")))
    slots = slots.withColumn("_in_range", before("_src", "_range", "_at_slot")).join(ranges, F.col("_src").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    slots = slots.select("_src", "_at_slot", (F.col("_earlier") + F.col("_in_range")).alias("_before"), F.col("source_size").alias("_source_size"), F.col("class").alias("_class"), F.col("target").alias("_target"))
    own = Window.partitionBy("_need_source", "_slot").orderBy("_order", "_need_doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in_slot", F.coalesce(F.sum("_size").over(own), F.lit(0)))
    d = d.join(slots, F.col("_need_source").eqNullSafe(F.col("_src")) & (F.col("_slot") == F.col("_at_slot")))
    c = F.col("_before") + F.col("_in_slot")
    middle = lambda p: 2 * (p * F.col("_source_size") + c) + F.col("_size")
    passes = sum((F.when((F.col("_size") > 0) & (middle(p) <= 2 * F.col("_target")), 1).otherwise(0) for p in range(cap)), F.lit(0))
    at = lambda p: F.round(_by_class(schedules, F.least(middle(p) / (2 * F.col("_target")), F.lit(1.0))), 9)
    d = d.withColumn("_passes", passes)
    positions = F.filter(F.array(*[F.when(F.col("_passes") > p, at(p)) for p in range(cap)]), lambda x: x.isNotNull())
    return d.withColumns({"_taken": (F.col("_passes") * F.col("_size")).cast("long"), "_positions": positions}), names


def _by_class(schedules, share: Column) -> Column:
    out = _inverse(share, schedules[0])
    for k, knots in enumerate(schedules[1:], 1):
        out = F.when(F.col("_class") == k, _inverse(share, knots)).otherwise(out)
    return out


def mix(docs: DataFrame, **params) -> DataFrame:
    """The columns of ``docs``, each document as often as it is taken, range-sorted by training position."""
    plan, names = _plan(docs, **params)
    own = [c for c in plan.columns if c.startswith("_own_")]
    return plan.where("_passes > 0").select(*own, "_need_doc_id", F.explode("_positions").alias("_at")).orderBy("_at", "_need_doc_id").select(*names)


def op4_mix(docs: DataFrame) -> DataFrame:
    """One row for each document, in the order of its first training position (never taken ones last)."""
    plan = plan_mix(docs.select("doc_id", "text", "source"))
    plan = plan.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"))
    return plan.orderBy(F.col("position").asc_nulls_last(), "doc_id")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(concat_ws(':', CAST(doc_id AS VARCHAR), md5(text))) AS o FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS z FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM s),
w AS (SELECT *, CASE k WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM r),
a AS (SELECT *, SUM(z) OVER () AS total, COALESCE(SUM(z) OVER (ORDER BY z / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        SUM(w) OVER (ORDER BY z / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w, row_number() OVER (ORDER BY z / w, source NULLS LAST) AS rk FROM w),
b AS (SELECT *, 150 * total - 200 * capped AS rest FROM a),
f AS (SELECT rk AS frk, rest AS frest, open_w AS fw FROM b WHERE rest * w <= 200 * z * open_w ORDER BY rk LIMIT 1),
t AS (SELECT source, z, k, CASE WHEN rk >= frk THEN CAST(frest * w AS DOUBLE) / CAST(100 * fw AS DOUBLE) ELSE CAST(2 * z AS DOUBLE) END AS target FROM b LEFT JOIN f ON TRUE),
c AS (SELECT d.*, z, k, target, COALESCE(SUM(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN size > 0 AND 2 * before + size <= 2 * target THEN 1 ELSE 0 END + CASE WHEN size > 0 AND 2 * (z + before) + size <= 2 * target THEN 1 ELSE 0 END AS passes,
        LEAST(CAST(2 * before + size AS DOUBLE) / (2 * target), 1.0::DOUBLE) AS x FROM c),
q AS (SELECT *, CASE k WHEN 0 THEN (sqrt(GREATEST(2.25::DOUBLE - 2.0::DOUBLE * x, 0.0::DOUBLE)) - 1.5::DOUBLE) / -1.0::DOUBLE WHEN 1 THEN x
        ELSE CASE WHEN x * 1.0::DOUBLE <= 0.3125::DOUBLE THEN (sqrt(0.25::DOUBLE + x) - 0.5::DOUBLE) / 0.5::DOUBLE
             ELSE 0.5::DOUBLE + (sqrt(0.5625::DOUBLE + 5.0::DOUBLE * (x - 0.3125::DOUBLE)) - 0.75::DOUBLE) / 2.5::DOUBLE END END AS pos FROM p)
SELECT doc_id, size, z AS source_size, target, CAST(passes * size AS BIGINT) AS taken,
  CASE WHEN passes > 0 THEN round(LEAST(GREATEST(pos, 0.0::DOUBLE), 1.0::DOUBLE), 9) END AS position FROM q
"""
