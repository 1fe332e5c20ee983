"""The reverse sweep: map addresses that the source doesn't know, by bucket and reason, with totals, tables and rows for files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrloom.functions.spans import above, nodes
from addrloom.functions.text import first_int, housenumber_tokens, normalize_street, override_street
from addrloom.operators.streets import with_streets

COLUMNS = ("bucket", "reason", "osm_type", "osm_id", "addr_housenumber", "addr_street", "entrance", "name", "building", "lat", "lon", "missing_parts", "matched_parts")


def _tag(key: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("tags"), F.lit(key)), F.lit(""))


def source_index(src: DataFrame) -> DataFrame:
    """What the source emits, as an index: street_norm, token (a number as written) or step, parity, level, node (numbers of ranges), n_rows.

    Ranges without letters stand for all their numbers by parity (none where reversed); they are stored as nodes of a tree,
    so a range costs some rows for each digit, however long it is. Other rows give the number as written, and rows
    with two equal numbers and no letter also that number, so most of them count twice. Rows without a street give nothing.
    """
    suffix = lambda c: F.trim(F.coalesce(F.nullif(F.col(c), F.lit("None")), F.lit("")))
    rendered = F.upper(F.trim(F.coalesce("number", F.lit(""))))
    lo, hi = F.col("lo_num").cast("bigint"), F.col("hi_num").cast("bigint")
    plain = F.coalesce((lo != hi) & (suffix("lo_num_suf") == "") & (suffix("hi_num_suf") == ""), F.lit(False))
    again = F.when(F.coalesce((lo == hi) & (suffix("lo_num_suf") == ""), F.lit(False)), F.array(rendered, lo.cast("string"))).otherwise(F.array(rendered))
    single = F.when(rendered == "", F.array().cast("array<string>")).otherwise(again)
    rows = with_streets(src, {"_norm": lambda s: normalize_street(override_street(s))}).where("_norm <> ''").withColumnRenamed("_norm", "street_norm")
    singles = rows.where(~plain).select("street_norm", F.explode(single).alias("token")).groupBy("street_norm", "token").agg(F.count("*").alias("n_rows"))
    ranges = number_nodes(rows.where(plain).select("street_norm", lo.alias("lo"), hi.alias("hi"))).groupBy("street_norm", *NODE).agg(F.count("*").alias("n_rows"))
    return singles.unionByName(ranges, allowMissingColumns=True)


NODE = ("step", "parity", "level", "node")


def number_nodes(ranges: DataFrame) -> DataFrame:
    """``ranges`` (lo, hi) as nodes, a row for each: by two where both ends have one parity, else by one; none where reversed."""
    step = F.when(F.pmod(F.col("lo"), F.lit(2)) == F.pmod(F.col("hi"), F.lit(2)), 2).otherwise(1)
    r = ranges.where("lo <= hi").withColumn("step", step)
    scaled = lambda c: F.when(F.col("step") == 2, F.shiftright(F.col(c), 1)).otherwise(F.col(c))
    r = r.withColumns({"parity": F.when(F.col("step") == 2, F.pmod(F.col("lo"), F.lit(2))).otherwise(0).cast("int"), "n": F.explode(nodes(scaled("lo"), scaled("hi")))})
    return r.select(*ranges.columns, "step", "parity", F.col("n.level").alias("level"), F.col("n.node").alias("node")).drop("lo", "hi")


def number_places(numbers: DataFrame, top: int) -> DataFrame:
    """``numbers`` (n) with the nodes up to level ``top`` that may hold each: by one and by two."""
    by = F.explode(F.array(F.struct(F.lit(1).alias("step"), F.lit(0).alias("parity"), above(F.col("n"), top).alias("a")), F.struct(F.lit(2).alias("step"), F.pmod(F.col("n"), F.lit(2)).cast("int").alias("parity"), above(F.shiftright(F.col("n"), 1), top).alias("a"))))
    each = numbers.withColumn("b", by).select(*numbers.columns, "b.step", "b.parity", F.explode("b.a").alias("a"))
    return each.select(*numbers.columns, "step", "parity", F.col("a.level").alias("level"), F.col("a.node").alias("node"))


def plain_number(token: Column) -> Column:
    """The number of a token that is written just as a range's numbers are, else null."""
    n = token.try_cast("bigint")
    return F.when(n.cast("string") == token, n)


def index_counts(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(street_norm, token, n_rows) of those of ``asked`` (street_norm, token; distinct) that the index knows."""
    top = index.agg(F.max("level")).first()[0]
    hits = asked.join(index.where("token IS NOT NULL").select("street_norm", "token", "n_rows"), ["street_norm", "token"])
    if top is not None:
        numbers = asked.withColumn("n", plain_number(F.col("token"))).where("n IS NOT NULL")
        held = number_places(numbers, top).join(index.where("token IS NULL").select("street_norm", *NODE, "n_rows"), ["street_norm", *NODE])
        hits = hits.unionByName(held.select("street_norm", "token", "n_rows"))
    return hits.groupBy("street_norm", "token").agg(F.sum("n_rows").alias("n_rows"))


def listed(index: DataFrame) -> DataFrame:
    """(street_norm, token, n_rows): the index written out, a row for each number. For looking at; lookups use index_counts."""
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("level") * 4)
    n = F.explode(F.sequence(F.col("node") * size, (F.col("node") + 1) * size - 1))
    numbers = index.where("token IS NULL").select("street_norm", "step", "parity", "n_rows", n.alias("n"))
    numbers = numbers.select("street_norm", F.when(F.col("step") == 2, 2 * F.col("n") + F.col("parity")).otherwise(F.col("n")).cast("string").alias("token"), "n_rows")
    return index.where("token IS NOT NULL").select("street_norm", "token", "n_rows").unionByName(numbers).groupBy("street_norm", "token").agg(F.sum("n_rows").alias("n_rows"))


def node_rows(features: DataFrame, index: DataFrame, inside: Column | None = None) -> DataFrame:
    """Address nodes that aren't POIs, with the parts of their number that the index knows or not.

    ``features``: osm_id, osm_type, is_poi, street_norm, housenumber, street, lat, lon, tags. bucket: entrance or pure; reason: matched,
    missing_in_source, no_addr_street, or outside where ``inside`` is false or a coordinate is null.
    """
    within = F.lit(True) if inside is None else F.coalesce(inside, F.lit(False))
    nodes = features.where("osm_type = 'node' AND NOT is_poi").withColumns({"_in": within, "bucket": F.when(F.map_contains_key("tags", "entrance"), "entrance").otherwise("pure")})
    t = nodes.where("_in AND street_norm <> ''").select("osm_id", "street_norm", F.posexplode(housenumber_tokens(F.col("housenumber"))).alias("_pos", "token"))
    known = index_counts(index, t.select("street_norm", "token").distinct())
    j = t.join(known.select("street_norm", "token", F.lit(True).alias("_known")), ["street_norm", "token"], "left")
    part = F.struct("_pos", "token")
    listed = lambda when: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, part))), lambda u: u["token"]), ";")
    g = j.groupBy("osm_id").agg(listed(F.col("_known").isNull()).alias("missing_parts"), listed(F.col("_known")).alias("matched_parts"), F.count("*").alias("_parts"), F.count("_known").alias("_hits"))
    n = nodes.join(g, "osm_id", "left")
    reason = F.when(~F.col("_in"), "outside").when(F.col("street_norm") == "", "no_addr_street").when(F.col("_parts") == F.col("_hits"), "matched").otherwise("missing_in_source")
    empty = F.lit("")
    return n.select("bucket", reason.alias("reason"), "osm_type", "osm_id", F.col("housenumber").alias("addr_housenumber"), F.coalesce("street", empty).alias("addr_street"), _tag("entrance").alias("entrance"), _tag("name").alias("name"),
                    empty.alias("building"), "lat", "lon", F.coalesce("missing_parts", empty).alias("missing_parts"), F.coalesce("matched_parts", empty).alias("matched_parts"), "street_norm")


def no_street_polygons(features: DataFrame, inside: Column | None = None) -> DataFrame:
    """ways and relations with a number, a blank street and no interpolation."""
    within = F.lit(True) if inside is None else F.coalesce(inside, F.lit(False))
    p = features.where(F.col("osm_type").isin("way", "relation") & (F.trim(F.coalesce("street", F.lit(""))) == "") & ~F.coalesce(F.map_contains_key("tags", "addr:interpolation"), F.lit(False)))
    reason = F.when(within, "no_addr_street_polygon").otherwise("outside")
    empty = F.lit("")
    return p.select(F.lit("buildings_no_street").alias("bucket"), reason.alias("reason"), "osm_type", "osm_id", F.col("housenumber").alias("addr_housenumber"), empty.alias("addr_street"), empty.alias("entrance"), _tag("name").alias("name"),
                    _tag("building").alias("building"), "lat", "lon", empty.alias("missing_parts"), empty.alias("matched_parts"), empty.alias("street_norm"))


def totals(rows: DataFrame) -> DataFrame:
    """For each bucket all rows inside, and the matched, missing, street-less and outside ones."""
    is_ = lambda r: F.count_if(F.col("reason") == r)
    return rows.groupBy("bucket").agg(F.count_if(F.col("reason") != "outside").alias("total"), is_("matched").alias("matched"), is_("missing_in_source").alias("missing"), F.count_if(F.startswith("reason", F.lit("no_addr_street"))).alias("no_street"), is_("outside").alias("outside"))


def building_values(polygons: DataFrame) -> DataFrame:
    """Street-less polygons by kind of building and of element."""
    label = F.coalesce(F.nullif(F.col("building"), F.lit("")), F.lit("(no building tag)"))
    return polygons.where("reason <> 'outside'").groupBy(label.alias("label"), "osm_type").agg(F.count("*").alias("n"))


def table(rows: DataFrame, bucket: str, reason: str, cap: int = 500) -> DataFrame:
    """The first rows of a bucket by street, leading number and number: a top-k, so no task holds the bucket."""
    return rows.where((F.col("bucket") == bucket) & (F.col("reason") == reason)).orderBy("street_norm", first_int(F.col("addr_housenumber")), "addr_housenumber", "osm_id").limit(cap)


def file_rows(nodes: DataFrame, polygons: DataFrame) -> DataFrame:
    """The unknown rows of all buckets in the file's columns; for rows without a street no parts are listed."""
    kept = nodes.unionByName(polygons).where("reason NOT IN ('matched', 'outside')")
    return kept.select(*COLUMNS)
