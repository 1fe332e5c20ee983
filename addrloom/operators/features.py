"""Map features: what counts as an address, a POI or an interpolation end, and how a feature compares with a proposal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrloom.functions.text import normalize_street
from addrloom.operators.streets import with_streets
from addrloom.plans.stage import materialize

# Fixed values
POI_KEYS = ("amenity", "shop", "office", "tourism", "leisure", "craft", "healthcare", "building")
LIFECYCLE = ("disused", "abandoned", "ruins", "demolished", "razed", "removed", "destroyed", "construction", "proposed", "planned", "was")
IGNORED_KEYS = ("source", "opendata:type", "check_date", "note", "entrance", "door", "access")
#: Distinct nodes that end interpolation ways and are broadcast; some twenty bytes each.
ENDS = 500_000
DIFF_KEYS = ("addr:housenumber", "addr:street", "addr:unit", "addr:postcode", "addr:city", "addr:country")


def is_poi_key(key: Column) -> Column:
    """a POI key, bare or with a lifecycle qualifier in front or behind; cut at the first colon."""
    head = F.substring_index(key, ":", 1)
    tail = F.when(F.contains(key, F.lit(":")), F.substring(key, F.length(head) + 2, F.length(key)))
    return key.isin(*POI_KEYS) | F.coalesce((head.isin(*LIFECYCLE) & tail.isin(*POI_KEYS)) | (head.isin(*POI_KEYS) & tail.isin(*LIFECYCLE)), F.lit(False))


def is_poi_node(kind: Column, tags: Column) -> Column:
    """nodes with a POI key; other kinds never."""
    return (kind == "node") & F.coalesce(F.exists(F.map_keys(tags), is_poi_key), F.lit(False))


def tags_of(osm: DataFrame) -> DataFrame:
    """The lattice's features with their tags as a map."""
    pairs = [("addr:housenumber", F.col("housenumber")), ("addr:street", F.col("street")), ("addr:postcode", F.col("postcode")), ("name", F.col("name")), ("entrance", F.col("entrance"))]
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs], F.struct(F.col("poi_key").alias("key"), F.lit("yes").alias("value")))
    return osm.withColumn("tags", F.map_from_entries(F.filter(entries, lambda e: e["key"].isNotNull() & e["value"].isNotNull())))


def address_features(osm: DataFrame, interp: DataFrame) -> DataFrame:
    """Features with a house number and a point, without nodes that end an interpolation way.

    num is upper case but not trimmed, street_norm '' where there is no street: blank streets equal each other. Up to ENDS ends are
    broadcast, so features don't move; more of them meet in a shuffle.
    """
    ends = materialize(interp.select(F.explode(F.array("n1", "n2")).alias("osm_id")).distinct(), "ends").withColumn("osm_type", F.lit("node"))
    f = tags_of(osm).where(F.col("housenumber").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    f = with_streets(f, {"_norm": normalize_street})
    f = f.join(F.broadcast(ends) if ends.count() <= ENDS else ends.hint("merge"), ["osm_id", "osm_type"], "left_anti")
    return f.select("osm_id", "osm_type", F.upper("housenumber").alias("num"), F.col("_norm").alias("street_norm"), "housenumber", "street", "lat", "lon", "tags", is_poi_node(F.col("osm_type"), F.col("tags")).alias("is_poi"))


def extra_tags(tags: Column) -> Column:
    """keys that are neither address nor noise, sorted."""
    return F.array_sort(F.filter(F.map_keys(tags), lambda k: ~F.startswith(k, F.lit("addr:")) & ~k.isin(*IGNORED_KEYS)))


def geometry_hint(kind: Column, tags: Column) -> Column:
    """P10"""
    has = lambda k: F.coalesce(F.map_contains_key(tags, k), F.lit(False))
    value = lambda k: F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))
    way = F.when(has("building") | has("building:part") | (value("area") == "yes"), "way-polygon").otherwise("way-line")
    relation = F.when((value("type") == "multipolygon") | has("building"), "relation-polygon").otherwise("relation")
    return F.when(kind == "node", "node").when(kind == "way", way).when(kind == "relation", relation).otherwise(F.coalesce(kind, F.lit("unknown")))


def tag_diff(df: DataFrame, proposed: str, found: str) -> DataFrame:
    """A row for each default key that either side has: SAME, ADD, CHANGE or MISSING_PROPOSED."""
    rows = df.withColumn("tag", F.explode(F.array(*map(F.lit, DIFF_KEYS))))
    value = lambda m: F.coalesce(F.try_element_at(F.col(m), F.col("tag")), F.lit(""))
    rows = rows.withColumns({"_p": value(proposed), "_o": value(found)}).where((F.col("_p") != "") | (F.col("_o") != ""))
    same = F.when(F.col("tag") == "addr:street", normalize_street(F.col("_p")) == normalize_street(F.col("_o"))).when(
        F.col("tag") == "addr:housenumber", F.upper(F.trim("_p")) == F.upper(F.trim("_o"))).otherwise(F.trim("_p") == F.trim("_o"))
    status = F.when(F.col("_o") == "", "ADD").when(F.col("_p") == "", "MISSING_PROPOSED").when(same, "SAME").otherwise("CHANGE")
    return rows.withColumn("status", status).withColumnsRenamed({"_p": "proposed_value", "_o": "osm_value"})
