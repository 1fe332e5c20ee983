"""Filter interaction audit: what each of five filters removes in every order, and its Shapley value.

A document's failures are a mask of five bits, so a part of the corpus is 32 counts. The documents that a set of filters
removes are the corner values of a polynomial, the game's multilinear extension; the Shapley value of a filter is
the integral of the partial derivative along the diagonal, taken in exact rationals.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrloom.llm.common import WORD_RE

FILTERS = "ABCDE"
#: The order-independent filters: failure conditions over text, words and number of words.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 200, 50, 3, "[#$%&*|]"
#: Slots for the rows without a doc_id, which meet no label.
SLOTS = 4096
RESULT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def own_mask(text: Column, words: Column) -> Column:
    """Bits of the filters that look at the text alone: A 1, B 2, C 4, D 8."""
    n = F.size(words)
    fails = [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") > MAX_CAPITALS * F.length(text).cast("bigint"),
        text.rlike(SYMBOLS),
    ]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good ones and toxic ones of each part and failure mask (part, mask, n, good, toxic).

    Texts are hashed (SHA-256) where they are read; only hashes, ids and masks are shuffled. Copies of a text are
    combined before each shuffle, so that a text with very many copies is a few rows where its smallest id is sought.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("words", F.regexp_extract_all("text", F.lit(WORD_RE), F.lit(0)))
    rows = texts.select("doc_id", "part", F.sha2("text", 256).alias("th"), own_mask(F.col("text"), F.col("words")).alias("own"))
    rows = rows.groupBy("doc_id", "part", "th", "own").agg(F.count("*").alias("n"))

    known = labels.select(F.col("doc_id").cast("bigint").alias("_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("_id IS NOT NULL")
    known = known.groupBy("_id").agg(F.coalesce(F.max("good"), F.lit(False)).alias("good"), F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic"))
    slot = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("th"), F.lit(SLOTS)) + 1).otherwise(0)
    rows = rows.withColumn("_slot", slot).join(known.withColumn("_none", F.lit(0).cast("bigint")), (F.col("doc_id") == F.col("_id")) & (F.col("_slot") == F.col("_none")), "left")
    rows = rows.withColumns({"good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))})

    alike = rows.groupBy("th", "part", "own", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"),
        F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"),
    )
    alike = alike.withColumn("of_text", F.min("first").over(Window.partitionBy("th")))
    stays = F.col("no_id") + F.when(F.col("first") == F.col("of_text"), F.col("n_first")).otherwise(0)
    masks = alike.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("own").alias("mask"), stays.alias("n")), F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - stays).alias("n")))).alias("m"))
    masks = masks.select("part", "good", "toxic", "m.mask", "m.n")
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)).alias(flag)
    return masks.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


class RemovalPolynomial:
    """Multilinear extension of "documents removed by a set of filters", from counts by failure mask.

    A document that fails the filters of its mask m is removed with 1 - product of (1 - x_i) over m: terms of all
    non-empty subsets T of m, with sign (-1)^(|T|+1).
    """

    def __init__(self, counts: dict[int, int], filters: int = len(FILTERS)):
        self.filters, self.coefficients = filters, {}
        for t in range(1, 1 << filters):
            c = sum(n for m, n in counts.items() if m & t == t)
            if c:
                self.coefficients[t] = c if t.bit_count() % 2 else -c

    def corner(self, chosen: int) -> int:
        """Value where the variables of ``chosen`` are 1 and the others 0: documents removed by these filters."""
        return sum(c for t, c in self.coefficients.items() if t & chosen == t)

    def derivative(self, bit: int) -> list[int]:
        """The partial derivative on the diagonal x_1 = ... = x_n = t, as coefficients of 1, t, t^2, ..."""
        powers = [0] * self.filters
        for t, c in self.coefficients.items():
            if t & bit:
                powers[t.bit_count() - 1] += c
        return powers

    def shapley(self, bit: int) -> Fraction:
        """Integral of the derivative over t from 0 to 1."""
        return sum((Fraction(c, k + 1) for k, c in enumerate(self.derivative(bit))), Fraction(0))


def audit(part: str, total: int, counts: dict[str, dict[int, int]]) -> list[tuple]:
    """Rows of one part for all orders and steps. counts: n, good, toxic by mask."""
    of = {k: RemovalPolynomial(c) for k, c in counts.items()}
    bits, full = {f: 1 << k for k, f in enumerate(FILTERS)}, (1 << len(FILTERS)) - 1
    corners = {k: [p.corner(s) for s in range(full + 1)] for k, p in of.items()}
    orders = list(permutations(FILTERS))
    values = {f: of["n"].shapley(b) * len(orders) for f, b in bits.items()}
    if any(v.denominator != 1 for v in values.values()):
        raise ArithmeticError(f"Shapley values of {part!r} aren't whole: {values}")
    out, removed = [], corners["n"]
    for order in orders:
        before = 0
        for step, f in enumerate(order, 1):
            b = bits[f]
            here = {k: c[before | b] - c[before] for k, c in corners.items()}
            out.append((part, "".join(order), step, total - removed[before | b], here["n"], removed[b] - here["n"], removed[full] - removed[full ^ b], here["good"], here["toxic"], int(values[f])))
            before |= b
    return out


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of each part of ``docs`` (doc_id, text, lang), with ``labels`` (doc_id, quality, toxic)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:  # 32 rows at most
        counts = {k: dict(zip(rows["mask"].tolist(), rows[k].tolist())) for k in ("n", "good", "toxic")}
        return pd.DataFrame(audit(rows["part"].iloc[0], int(rows["n"].sum()), counts), columns=[f.split()[0] for f in RESULT.split(", ")])

    return mask_counts(docs, labels).groupBy("part").applyInPandas(run, RESULT)


def op12_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """120 orders of 5 steps for each lang value; null lang and text are empty.

    Repeated rows count as often as they occur; rows that share the smallest doc_id of a text are none of them copies. A
    null doc_id is neither smaller nor larger than another: such a row passes E and has no label. Of several labels of
    a doc_id, one that says 1 is enough; null labels say nothing. An empty table gives no rows; other columns are ignored.
    """
    return filter_audit(docs, labels)


OP12_SQL = r"""
WITH d AS (SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, MIN(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, MAX(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, MAX(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, COALESCE(good, 0) AS good, COALESCE(toxic, 0) AS toxic,
    CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, COUNT(*) AS n, SUM(good) AS good, SUM(toxic) AS toxic FROM m GROUP BY ALL),
f(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, CAST(bits[k] AS INTEGER) AS bit, CAST(COALESCE(list_sum(bits[1:k - 1]), 0) AS INTEGER) AS before FROM o, range(1, 6) AS r(k)),
x AS (SELECT part, filter_order, step, n, good, toxic, mask = bit AS alone, mask & bit <> 0 AS fails, mask & before <> 0 AS gone, n * 120 // greatest(bit_count(mask), 1) AS share FROM c, s)
SELECT part, filter_order, step, CAST(COALESCE(SUM(n) FILTER (WHERE NOT fails AND NOT gone), 0) AS BIGINT) AS kept,
  CAST(COALESCE(SUM(n) FILTER (WHERE fails AND NOT gone), 0) AS BIGINT) AS removed, CAST(COALESCE(SUM(n) FILTER (WHERE fails AND gone), 0) AS BIGINT) AS redundant,
  CAST(COALESCE(SUM(n) FILTER (WHERE alone), 0) AS BIGINT) AS unique_fails, CAST(COALESCE(SUM(good) FILTER (WHERE fails AND NOT gone), 0) AS BIGINT) AS good_lost,
  CAST(COALESCE(SUM(toxic) FILTER (WHERE fails AND NOT gone), 0) AS BIGINT) AS toxic_lost, CAST(COALESCE(SUM(share) FILTER (WHERE fails), 0) AS BIGINT) AS shapley
FROM x GROUP BY ALL
"""
