"""Cross-site line removal, native: a HyperLogLog sketch of the sites of each line, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrloom.llm.common import hidden, lookup, write_table

KEY = ["h1", "h2"]


def lines_of(docs: DataFrame) -> DataFrame:
    """A row for each line of (doc_id, text, source) that isn't blank: document, position, 128-bit hash of the trimmed line, site."""
    row = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("source").alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    line = F.trim("line")
    return row.where(line != "").select("doc_id", "th", "site", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int = 12) -> DataFrame:
    """Hashes of lines on ``min_sites`` sites or more: h1, h2, n (rows) and first (the occurrence that stays).

    The spread is a sketch for each hash, merged by the aggregation, so the shuffle carries sketches of
    some dozen bytes instead of (line, site) pairs. A line whose estimate is within four standard errors
    of the threshold, or within 1, gets an exact distinct count; others are decided by the estimate.
    """
    err = max(1.0, 4 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    spread = lines.groupBy(*KEY).agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
    spread = spread.where(F.col("n") >= min_sites).select(*KEY, "n", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = write_table(spread.where(F.col("sites") >= min_sites - err), "line-spread")
    near = spread.where(F.col("sites") <= min_sites + err)
    pairs = lookup(lines.select(*KEY, "site", "doc_id", "pos"), near.select(*KEY, "n"), KEY, "n", ["doc_id", "pos"])
    exact = pairs.where(F.col("n").isNotNull()).groupBy(*KEY).agg(F.countDistinct("site").alias("exact"))
    both = spread.join(exact, KEY, "left")
    return write_table(both.where(F.coalesce("exact", "sites") >= min_sites).select(*KEY, "n", "first"), "line-boilerplate")


def _cut(docs: DataFrame, min_sites: int, lg_k: int) -> tuple[DataFrame, list[Column]]:
    """``docs`` under hidden names with _text, _n_lines and _n_removed beside them, and the way back to its own columns."""
    lines = lines_of(docs.select("doc_id", "text", "source"))
    bad = boilerplate(lines, min_sites, lg_k)
    hits = lookup(lines.drop("site"), bad, KEY, "n", ["doc_id", "pos"]).where(F.col("n").isNotNull())
    gone = hits.where(~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.pos") == F.col("pos"))))
    gone = gone.groupBy(F.col("doc_id").alias("_doc"), F.col("th").alias("_th")).agg(F.collect_set("pos").alias("_gone"))
    own, names = hidden(docs, "doc_id", "text")
    kept = own.join(gone, F.col("_need_doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("_need_text") == F.col("_th")), "left")
    old = F.col("_need_text")
    lines_in = F.split(old, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines_in) - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), old).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines_in, i)), "\n"))
    n_lines, n_removed = F.when(old.isNull(), 0).otherwise(F.size(lines_in)), F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone"))
    return kept.withColumns({"_text": text, "_n_lines": n_lines.cast("long"), "_n_removed": n_removed.cast("long")}), names


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, lg_k: int = 12) -> DataFrame:
    """``docs`` with cross-site lines cut from ``text``, plus n_lines and n_removed (0 for null text).

    A line on ``min_sites`` distinct sites (``source``; null is no site) or more stays only where it
    occurs first, by (doc_id, position), nulls first; elsewhere it goes. Blank lines are never counted or
    removed. Null text stays null; an empty text has one blank line; a document can end up empty but is
    not dropped; repeated rows are treated alike. Other columns pass through under any name; where ``docs``
    has an n_lines or n_removed of its own, that column is replaced.
    """
    kept, names = _cut(docs, min_sites, lg_k)
    counts = ("n_lines", "n_removed")
    return kept.select(*[F.col("_text").alias("text") if c == "text" else n for c, n in zip(docs.columns, names) if c not in counts], *[F.col(f"_{c}").alias(c) for c in counts])


def clean(docs: DataFrame, min_sites: int = 10, lg_k: int = 12) -> DataFrame:
    """Exactly the columns of ``docs``, cross-site lines cut from ``text``; n_chars, where there is one, follows a changed text."""
    kept, names = _cut(docs, min_sites, lg_k)

    def column(name: str, own: Column) -> Column:
        if name == "n_chars":
            own = F.when(F.col("_n_removed") > 0, F.length("_text").cast(docs.schema[name].dataType)).otherwise(own)
        return F.col("_text").alias(name) if name == "text" else own.alias(name)

    return kept.select(*map(column, docs.columns, names))


def op2_line_dedup(docs: DataFrame) -> DataFrame:
    """Every document with its text after removal and the number of lines before and removed."""
    return remove_boilerplate(docs.select("doc_id", "text", "source")).select("doc_id", "text", "n_lines", "n_removed")


OP2_SQL = """
WITH l AS (SELECT doc_id, source, UNNEST(string_split(text, chr(10))) AS line, UNNEST(range(len(string_split(text, chr(10))))) AS pos FROM documents),
k AS (SELECT doc_id, source, line, pos, trim(line, ' ') AS key FROM l),
b AS (SELECT key, MIN({'d': doc_id, 'p': pos}) AS f FROM k WHERE key <> '' GROUP BY key HAVING COUNT(DISTINCT source) >= 10),
m AS (SELECT k.*, b.key IS NOT NULL AND NOT (b.f.d = k.doc_id AND b.f.p = k.pos) AS gone FROM k LEFT JOIN b ON k.key = b.key),
g AS (SELECT doc_id, COUNT(*) AS n_lines, SUM(gone::INT) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS t FROM m GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE COALESCE(g.t, '') END AS text, CAST(COALESCE(n_lines, 0) AS BIGINT) AS n_lines, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
