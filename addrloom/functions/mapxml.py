"""Map XML as rows of text: upload files and fixes of existing elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GENERATOR = "addrloom"


def attribute(text: Column) -> Column:
    """A text as the value of an XML attribute."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#09;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def upload_tags(number: Column, street: Column, postcode: Column, source: str) -> Column:
    """The proposed tags in this order, blank ones left out; the source is required."""
    if not source.strip():
        raise ValueError("uploads need an attribution")
    pairs = [("addr:housenumber", number), ("addr:street", street), ("source", F.lit(source)), ("addr:postcode", postcode)]
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(F.trim(v), F.lit("")).alias("value")) for k, v in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] != ""))


def tag_lines(tags: Column) -> Column:
    one = lambda e: F.concat(F.lit('<tag k="'), attribute(e["key"]), F.lit('" v="'), attribute(e["value"]), F.lit('" />'))
    return F.array_join(F.transform(F.map_entries(tags), one), "")


def node(local_id: Column, lat: Column, lon: Column, tags: Column, changeset: int | None = None) -> Column:
    """One node: as a change of a JOSM file, or as a creation in a changeset."""
    more = F.lit(' action="modify" visible="true"') if changeset is None else F.lit(' version="0"')
    owner = F.lit("") if changeset is None else F.lit(f' changeset="{changeset}"')
    at = F.format_string(' lat="%.7f" lon="%.7f"', lat, lon)
    return F.concat(F.lit('<node id="'), local_id.cast("string"), F.lit('"'), owner, at, more, F.lit(">"), tag_lines(tags), F.lit("</node>"))


def document(items: DataFrame, changeset: int | None = None) -> DataFrame:
    """The lines of each run's file as rows (run_id, part, local_id, line); in this order they are the file.

    ``items``: run_id, candidate_id, local_node_id, lat, lon, tags. Rows without a point are left out; a missing local id is minus
    the candidate's. Lines are never gathered: write them sorted, partitioned by run.
    """
    if changeset is None:
        head, foot = f'<osm version="0.6" generator="{GENERATOR}">', "</osm>"
    else:
        head, foot = f'<osmChange version="0.6" generator="{GENERATOR}"><create>', "</create></osmChange>"
    local = F.coalesce("local_node_id", -F.col("candidate_id").try_cast("bigint"))
    nodes = items.where("lat is not null and lon is not null").withColumn("_id", local)
    nodes = nodes.select("run_id", F.lit(1).alias("part"), F.col("_id").alias("local_id"), node(F.col("_id"), F.col("lat"), F.col("lon"), F.col("tags"), changeset).alias("line"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit(head).alias("line")), F.struct(F.lit(2).alias("part"), F.lit(foot).alias("line"))))
    frame = items.select("run_id").distinct().select("run_id", ends.alias("e")).select("run_id", "e.part", F.lit(None).cast("bigint").alias("local_id"), "e.line")
    return frame.unionByName(nodes)


def keep_set(elements: DataFrame, edited: DataFrame, members: DataFrame) -> DataFrame:
    """The edited elements and the nodes of edited ways, each once: nodes (0), ways (1), relations (2).

    ``elements``: osm_type, osm_id and more; ``edited``: osm_type, osm_id; ``members``: way_id, node_id.
    """
    key = ["osm_type", "osm_id"]
    e = edited.select(*key).distinct()
    ways = e.where("osm_type = 'way'").select(F.col("osm_id").alias("way_id"))
    used = members.join(ways, "way_id", "left_semi").select(F.lit("node").alias("osm_type"), F.col("node_id").alias("osm_id"), F.lit(False).alias("_e"))
    wanted = e.withColumn("_e", F.lit(True)).unionByName(used).groupBy(*key).agg(F.max("_e").alias("is_edited"))
    order = F.when(F.col("osm_type") == "node", 0).when(F.col("osm_type") == "way", 1).otherwise(2)
    return elements.join(wanted, key).withColumn("part", order)
