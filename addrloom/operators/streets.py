"""Street names worked out once for each distinct spelling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrloom.plans.stage import materialize

#: Distinct spellings that are broadcast; some hundred bytes each. A city has about ten thousand.
SPELLINGS = 500_000


def with_streets(rows: DataFrame, columns: dict[str, Callable[[Column], Column]], raw: str = "street") -> DataFrame:
    """``rows`` with columns made of the spelling in ``raw``, null included.

    The functions are long chains of string operations, so they run over the distinct spellings, which are joined back. More than
    SPELLINGS of them aren't broadcast: then the functions run row by row, which needs no shuffle either.
    """
    names = rows.select(F.col(raw).alias("_raw")).distinct()
    made = materialize(names.select("_raw", *[f(F.col("_raw")).alias(f"_made_{n}") for n, f in columns.items()]), "spellings")
    if made.count() > SPELLINGS:
        return rows.withColumns({n: f(F.col(raw)) for n, f in columns.items()})
    found = rows.withColumnRenamed(raw, "_own_raw").join(F.broadcast(made), F.col("_own_raw").eqNullSafe(F.col("_raw")), "left").drop("_raw")
    kept = [F.col("_own_raw").alias(c) if c == raw else F.col(c) for c in rows.columns if c not in columns]
    return found.select(*kept, *[F.col(f"_made_{n}").alias(n) for n in columns])
