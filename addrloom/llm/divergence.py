"""Source divergence audit: how far the word use of the sources of a language lies apart, in exact integers.

The kept terms of a language are dealt into blocks. A block is a dense int64 matrix, a row for each source and a column for each
term; all pairs of its rows are compared by broadcasting, and the blocks' pair sums and heaps of terms are merged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrloom.llm.common import write_table

MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Cells of a block's matrix on average, where a language has few sources; cells of the largest temporary array in comparing pairs.
CELLS, PAIR_CELLS = 1 << 16, 4_000_000
#: Terms a task holds before it hands on what it has counted; bytes of a long text that are cut into terms at a time.
HELD, WINDOW = 200_000, 1 << 20

#: Letters of ASCII in lower case and all bytes of other characters stay, anything else is a space.
_TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTED = pa.schema([("lang", pa.binary()), ("source", pa.binary()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists of WINDOW bytes or a term at least."""
    text = text.translate(_TO_TERMS)
    lo = 0
    while len(text) - lo > WINDOW:
        hi = text.find(b" ", lo + WINDOW)
        if hi < 0:
            break
        yield text[lo:hi].split()
        lo = hi
    yield (text[lo:] if lo else text).split()


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by lang, source and term, as far as one task has them: the same key may come again."""
    counted: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
    held = 0

    def emit() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counted.items():
            terms = list(n)
            for lo in range(0, len(terms), 20_000):
                some = terms[lo : lo + 20_000]
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(some), "source": [source] * len(some), "term": some, "n": [n[t] for t in some], "docs": [docs[t] for t in some]}, schema=_COUNTED)
        counted.clear()

    for b in batches:
        for k in range(b.num_rows):
            key = (b.column("lang")[k].as_py(), b.column("source")[k].as_py())
            n, docs = counted.setdefault(key, (Counter(), Counter()))
            had, seen = len(n), set()
            for terms in terms_of(b.column("text")[k].as_py()):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            held += len(n) - had
            if held >= HELD:
                yield from emit()
                held = 0
    yield from emit()


def share(count: str, total: str) -> Column:
    """1 + floor(SCALE * (count + 2) / total) of two columns, in 64-bit steps that can't overflow for totals under 2.9e14: 31,250 * 32,000 is SCALE."""
    rest = f"(({count} + 2) % {total})"
    high = f"({rest} * 31250)"
    return F.expr(f"1 + {SCALE} * (({count} + 2) DIV {total}) + 32000 * ({high} DIV {total}) + ({high} % {total}) * 32000 DIV {total}")


def pair_sums(p: np.ndarray) -> np.ndarray:
    """Sum over the columns of floor((a - b)^2 / (a + b)) for all pairs of rows of ``p``, a slab of rows against all at a time."""
    groups, terms = p.shape
    sums = np.zeros((groups, groups), np.int64)
    if terms == 0:
        return sums
    rows = max(1, PAIR_CELLS // (groups * terms))
    for lo in range(0, groups, rows):
        part, rest = p[lo : lo + rows, None, :], p[None, lo:, :]  # pairs with earlier rows are there already
        away = part - rest
        np.multiply(away, away, out=away)
        away //= part + rest
        sums[lo : lo + rows, lo:] = away.sum(axis=2)
    upper = np.triu(sums, 1)
    return upper + upper.T


_TILE = "source string, part string, item string, q bigint, p bigint, value bigint, lang string"
_TILE_SCHEMA = pa.schema([("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("q", pa.int64()), ("p", pa.int64()), ("value", pa.int64()), ("lang", pa.string())])


def tile(table: pa.Table) -> pa.Table:
    """Pair sums and the TOP terms of each source in one block of terms of a language.

    Rows with a null term are the sources (p: that of a term which the source lacks), the others its cells.
    """
    table = table.combine_chunks()
    head, cells = table.filter(pc.is_null(table["term"])), table.filter(pc.is_valid(table["term"]))
    head, lang = head.sort_by("source"), table["lang"][0].as_py()
    sources = head["source"].combine_chunks()
    at = np.asarray(pc.index_in(cells["source"], sources).combine_chunks().to_numpy(zero_copy_only=False), np.int64)
    terms = cells["term"].combine_chunks().unique().sort()
    of = np.asarray(pc.index_in(cells["term"], terms).combine_chunks().to_numpy(zero_copy_only=False), np.int64)
    matrix = np.repeat(head["p"].to_numpy()[:, None], len(terms), axis=1)
    p, q = cells["p"].to_numpy(), cells["q"].to_numpy()
    matrix[at, of] = p
    sums = pair_sums(matrix)
    a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
    none = pa.nulls(len(a), pa.int64())
    made = [pa.table([sources.take(pa.array(a)), pa.array(["pair"] * len(a), pa.string()), sources.take(pa.array(b)), none, none, pa.array(sums[a, b]), pa.array([lang] * len(a), pa.string())], schema=_TILE_SCHEMA)]

    more = np.nonzero(p > q)[0]
    f = (p[more] - q[more]) ** 2 // (p[more] + q[more])
    order = np.lexsort((of[more], -f, at[more]))
    group = at[more][order]
    first = np.searchsorted(group, group)  # where the source's terms begin
    best = order[np.arange(len(order)) - first < TOP]
    rows = more[best]
    made.append(pa.table([sources.take(pa.array(at[rows])), pa.array(["term"] * len(rows), pa.string()), terms.take(pa.array(of[rows])), pa.array(q[rows]), pa.array(p[rows]), pa.array(f[best]), pa.array([lang] * len(rows), pa.string())], schema=_TILE_SCHEMA))
    return pa.concat_tables(made)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, cells: int = CELLS) -> DataFrame:
    """Pairs of sources and leading terms of every (lang, source) group of ``docs`` (text, lang, source).

    Words are counted where they are read, then by (lang, term) in one shuffle; the counts of a word are a row for each source
    at most by then. A block has ``cells`` cells on average, or four for each pair of sources if that is more: what
    it hands on, a row for each pair, stays small against what it reads.
    """
    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = texts.select("lang", "source").distinct()
    counted = texts.select(*[F.col(c).cast("binary") for c in ("lang", "source", "text")]).mapInArrow(count_terms, "lang binary, source binary, term binary, n bigint, docs bigint")
    counted = counted.select(*[F.col(c).cast("string") for c in ("lang", "source", "term")], "n", "docs")
    counted = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    over = Window.partitionBy("lang", "term")
    kept = counted.withColumns({"lang_docs": F.sum("docs").over(over), "lang_n": F.sum("n").over(over), "first": F.min("source").over(over)}).where(F.col("lang_docs") >= min_docs)
    kept = write_table(kept.select("lang", "source", "term", "n", "lang_n", (F.col("first") == F.col("source")).cast("bigint").alias("terms")), "terms")

    of_groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")), ["lang", "source"], "left").na.fill(0, ["n", "terms"])
    lang = Window.partitionBy("lang")
    of_groups = of_groups.withColumns({"v": F.sum("terms").over(lang), "lang_total": F.sum("n").over(lang), "groups": F.count("*").over(lang)})
    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") * F.col("groups") / F.greatest(F.lit(cells), 4 * F.col("groups") * F.col("groups")))).cast("bigint")
    of_groups = write_table(of_groups.select("lang", "source", (F.col("n") + 2 * F.col("v")).alias("total"), (F.col("lang_total") + 2 * F.col("v")).alias("lang_total"), blocks.alias("blocks")), "groups")

    p = lambda n, total: F.when(F.col(total) > 0, share(n, total))
    heads = of_groups.select("lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("n"), "total")
    heads = heads.select("lang", "block", "source", "term", F.coalesce(p("n", "total"), F.lit(0)).alias("p"), F.lit(0).cast("bigint").alias("q"))
    rows = kept.join(of_groups, ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    rows = rows.select("lang", "block", "source", "term", p("n", "total").alias("p"), p("lang_n", "lang_total").alias("q"))
    tiles = heads.unionByName(rows).groupBy("lang", "block").applyInArrow(tile, _TILE)

    merged = tiles.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))  # a term is in one block only
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return merged.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= TOP)).select("lang", "source", "part", "item", "value", "rank")


def op13_divergence(docs: DataFrame) -> DataFrame:
    """Pairs and leading terms of every lang and source; null text, lang and source are empty.

    Repeated rows count as often as they occur, doc_id isn't looked at. A group without kept terms still has a share for
    each of them; a lang without kept terms gives pairs of value 0. Equal values rank by item. An empty table gives no
    rows, a lang with one source no pairs; other columns are ignored.
    """
    return divergence(docs)


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
    regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT id, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, COUNT(*) AS n FROM t GROUP BY 1, 2 HAVING COUNT(DISTINCT id) >= 10),
c AS (SELECT t.lang, t.source, t.term, COUNT(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, COUNT(*) AS v, SUM(n) AS total FROM k GROUP BY 1),
gt AS (SELECT g.lang, g.source, COALESCE((SELECT SUM(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total FROM g),
p AS (SELECT gt.lang, gt.source, k.term, COALESCE(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (COALESCE(c.n, 0) + 2)) // (gt.total + 2 * v.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 2)) // (v.total + 2 * v.v) AS q
  FROM gt JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = k.term),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, COALESCE(SUM((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
      LEFT JOIN p y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM z WHERE part = 'pair' OR rank <= 10
"""
