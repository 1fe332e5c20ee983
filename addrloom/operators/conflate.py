"""Ingest and conflation of all runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrloom.functions.geo import haversine, with_cells
from addrloom.functions.text import expand_street, id_order, normalize_street, override_street
from addrloom.operators.streets import with_streets
from addrloom.plans.stage import materialize
from addrloom.sources.lattice import RUN_BLOCKS

NEAR_M, MATCH_M, TWIN_M = 15.0, 100.0, 5.0


def ingest(src: DataFrame, run: Column | None = None) -> DataFrame:
    """Source rows to candidates; 'Land Entrance' rows go."""
    run = F.floor(F.col("b") / RUN_BLOCKS).cast("bigint") if run is None else run
    long = lambda s: expand_street(override_street(s))
    rows = src.where(~F.col("cls").eqNullSafe("Land Entrance")).withColumn("_run", run)
    return with_streets(rows, {"_long": long, "_norm": lambda s: normalize_street(long(s))}).select(
        F.col("_run").alias("run_id"), F.col("identity_key").alias("candidate_id"), F.nullif(F.upper(F.trim("number")), F.lit("")).alias("housenumber"),
        F.col("_long").alias("street"), F.col("_norm").alias("street_norm"), F.concat_ws(" ", "number", F.col("street")).alias("address_full"),
        "muni", "cls", "lo_num", "hi_num", "lo_num_suf", "lat", "lon", F.lit("INGESTED").alias("stage"),
        (F.col("lo_num").isNotNull() & F.col("hi_num").isNotNull() & (F.col("lo_num") != F.col("hi_num"))).alias("is_range"),
    )


#: Height of the cells of the search for the nearest feature, in radii.
CELL = 8
#: The address of a candidate, never null: rows without an address are each on their own.
AT = ["run_id", "_a", "_m"]
#: Columns of candidates that conflation itself looks at.
USED = ("run_id", "candidate_id", "housenumber", "street_norm", "address_full", "muni", "cls", "lat", "lon", "is_range")


def _with_found(cands: DataFrame, features: DataFrame, radius_m: float, tags: bool = True, poi: bool = True) -> DataFrame:
    """``cands`` with _best and _poi, the nearest feature and the nearest POI with a candidate's number and street within the radius.

    The lower id wins on ties. Number, street and a cell are equi keys, so that the same address elsewhere doesn't meet. Features lie in
    each cell that they reach and those of one key are one row, a place once; so a candidate is in one cell, is dealt once and stays one
    row. Without ``tags`` _best has none; without ``poi`` features that are POIs stay away and there is no _poi.
    """
    f = features.where("num IS NOT NULL" if poi else "num IS NOT NULL AND NOT is_poi").select("osm_id", "osm_type", "num", F.col("street_norm").alias("_street"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "is_poi",
        *[F.to_json("tags").alias("tags")] * tags, *[F.try_element_at("tags", F.lit("addr:postcode")).alias("_post")] * poi)
    at = ["num", "_street", "_cy", "_cx"]
    f = with_cells(f, radius_m, "_lat", "_lon", around=True, wide=CELL).withColumnsRenamed({"cy": "_cy", "cx": "_cx"}).repartition(*at)
    shown = {"best": ["osm_id", "osm_type", *["tags"] * tags]} | ({"poi": ["osm_id", "_post"]} if poi else {})
    at_place = [F.min(F.when(F.col("is_poi") if n == "poi" else ~F.col("is_poi"), F.struct(*names))).alias(n) for n, names in shown.items()]
    f = f.groupBy(*at, "_lat", "_lon").agg(*at_place).groupBy(*at).agg(F.collect_list(F.struct("_lat", "_lon", *shown)).alias("_near"))
    same = (F.col("housenumber") == F.col("num")) & (F.col("street_norm") == F.col("_street")) & (F.col("cy") == F.col("_cy")) & (F.col("cx") == F.col("_cx"))
    pairs = with_cells(cands, radius_m, wide=CELL).hint("merge").join(f, same, "left")

    def nearest_of(n: str) -> Column:
        entry = lambda e: F.struct(haversine(F.col("lat"), F.col("lon"), e["_lat"], e["_lon"]).alias("dist"), *[e[n][x].alias(x) for x in shown[n]])
        each = F.transform(F.filter("_near", lambda e: e[n].isNotNull()), entry)
        return F.array_min(F.filter(each, lambda e: e["dist"] <= radius_m))

    return pairs.select(*cands.columns, *[nearest_of(n).alias(f"_{n}") for n in shown])


def nearest(cands: DataFrame, features: DataFrame, radius_m: float = MATCH_M) -> DataFrame:
    """For each candidate that has one the nearest feature with its number and street within the radius, and the nearest POI."""
    found = _with_found(cands, features, radius_m).where("_best IS NOT NULL OR _poi IS NOT NULL")
    return found.select("run_id", "candidate_id", "_best.*", F.col("_poi.osm_id").alias("poi_id"))


def _by_address(rows: DataFrame) -> DataFrame:
    """Rows dealt by address, its parts as the columns AT instead of address_full and muni."""
    a = F.coalesce(F.concat(F.lit("a"), "address_full"), F.concat(F.lit("c"), "candidate_id"))
    return rows.withColumns({"_a": a, "_m": F.coalesce(F.concat(F.lit("m"), "muni"), F.lit(""))}).drop("address_full", "muni").repartition(*AT)


def _with_siblings(cands: DataFrame) -> DataFrame:
    """Candidates by address (AT) with sibling_id, sibling_dist, is_canonical, _land and _lands, the number of Land rows at the address.

    Rows are dealt by address once, and written. Rows that share a place are siblings at distance zero: of a place, the two lowest ids are all
    that matters. Only a row that is alone at its place, at an address with several, asks for the nearest other place; these few meet in a
    join, the other rows in none. So a stack of units or a hot point gives no pairs.
    """
    land = F.coalesce((F.col("cls") == "Land") & F.startswith("_a", F.lit("a")) & F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.lit(False))
    me = F.struct(id_order(F.col("candidate_id")).alias("o"), F.col("candidate_id").alias("id"))
    place, address = Window.partitionBy(*AT, "_land", "lat", "lon"), Window.partitionBy(*AT)
    c = _by_address(cands).withColumns({"_land": land, "_me": me})
    c = c.withColumn("_rank", F.row_number().over(place.orderBy("_me")))
    c = c.withColumns({"_first": F.min("_me").over(place), "_second": F.min(F.when(F.col("_rank") == 2, F.col("_me"))).over(place)})
    c = c.withColumns({"_low": F.min(F.when(F.col("_land"), F.col("_me"))).over(address), "_places": F.count_if(F.col("_land") & (F.col("_rank") == 1)).over(address), "_lands": F.count_if("_land").over(address)})
    here = F.when(F.col("_land"), F.when(F.col("_me") == F.col("_first"), F.col("_second")).otherwise(F.col("_first")))
    several = F.col("_land") & (F.col("_places") > 1)
    c = c.withColumns({"_here": here["id"], "_asks": several & here.isNull(), "_place": F.when(several & (F.col("_rank") == 1), F.col("_first")), "_lowest": F.col("_me") == F.col("_low")})
    c = materialize(c.drop("_me", "_rank", "_first", "_second", "_low", "_places"), "addresses")
    other = c.where("_place IS NOT NULL").select(*AT, *[F.col(x).alias(f"_s{x}") for x in ("lat", "lon")], "_place")
    asking = c.where("_asks").drop("_place")
    pairs = asking.select(*AT, "lat", "lon").hint("merge").join(other, AT).where((F.col("lat") != F.col("_slat")) | (F.col("lon") != F.col("_slon")))
    dist = haversine(F.col("lat"), F.col("lon"), F.col("_slat"), F.col("_slon"))
    near = pairs.groupBy(*AT, "lat", "lon").agg(F.min(F.struct(dist.alias("d"), F.col("_place.o").alias("o"), F.col("_place.id").alias("id"))).alias("_near"))
    asked = materialize(asking.hint("merge").join(near, [*AT, "lat", "lon"], "left").select(*asking.columns, "_near"), "siblings")
    j = c.where("NOT _asks").drop("_place").unionByName(asked, allowMissingColumns=True)
    sibling = F.coalesce("_here", "_near.id")
    j = j.withColumns({"sibling_id": sibling, "sibling_dist": F.when(F.col("_here").isNotNull(), F.lit(0.0)).otherwise(F.col("_near.d")), "is_canonical": F.when(sibling.isNotNull(), F.col("_lowest"))})
    return j.drop("_here", "_asks", "_lowest", "_near")


def land_siblings(cands: DataFrame) -> DataFrame:
    """For each Land row with a sibling at its address, the nearest one and whether the row is canonical (the lowest id)."""
    return _with_siblings(cands).where("sibling_id IS NOT NULL").select("run_id", "candidate_id", "sibling_id", "sibling_dist", "is_canonical")


def beside_land(cands: DataFrame) -> DataFrame:
    """Other rows at the address of a Land row of their run."""
    land = cands.where((F.col("cls") == "Land") & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(F.col("run_id").alias("_r"), F.col("address_full").alias("_a"), F.col("muni").alias("_m"))
    rest = cands.where(~F.col("cls").eqNullSafe("Land") & (F.col("address_full") != ""))
    return rest.join(land, (F.col("run_id") == F.col("_r")) & (F.col("address_full") == F.col("_a")) & F.col("muni").eqNullSafe(F.col("_m")), "left_semi").select("run_id", "candidate_id")


def conflate(cands: DataFrame, features: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """Candidates with verdict, nearest feature, POI acknowledgement, sibling and group columns.

    Rows are dealt by address for siblings, then by number, street and cell to the features. Only the rows of addresses with several Land
    rows are dealt by address again, if their group is asked for. ``wanted``: the columns to return, all where it is None. Others that
    conflation doesn't look at, tags and POIs are left out before rows move; rows are written in between, so Spark can't leave them out itself.
    """
    asked = lambda *names: wanted is None or bool({*names} & {*wanted})
    tags, poi = asked("tags"), asked("poi_id", "proposed_postcode")
    cands = cands.select(*[x for x in cands.columns if x in USED or asked(x)])
    c = _with_siblings(cands)
    beside = ~F.col("cls").eqNullSafe("Land") & (F.length("_a") > 1) & (F.col("_lands") > 0)
    skip = F.col("is_range") | beside | F.coalesce((F.col("sibling_dist") <= TWIN_M) & ~F.col("is_canonical"), F.lit(False))
    c = c.withColumn("skipped", skip)

    def judged(rows: DataFrame) -> DataFrame:
        # skipped rows meet nothing
        met = _with_found(rows.where("NOT coalesce(skipped, false)"), features, MATCH_M, tags, poi)
        both = met.unionByName(rows.where("skipped"), allowMissingColumns=True)
        verdict = F.when(F.col("skipped"), "SKIPPED").when(F.col("_best").isNull(), "MISSING").when(F.col("_best.dist") <= NEAR_M, "MATCH").otherwise("MATCH_FAR")
        return both.withColumn("verdict", verdict)

    missing = F.col("verdict") == "MISSING"
    if asked("group_all_match"):
        # every Land row of the address is a MATCH (J37); the others have no group
        several = F.col("_land") & (F.col("_lands") > 1)
        every = F.every(F.col("verdict") == "MATCH").over(Window.partitionBy(*AT))
        grouped = judged(c.where(several)).withColumn("group_all_match", every)
        c = judged(c.where(~several)).unionByName(grouped, allowMissingColumns=True)
    else:
        c = judged(c).withColumn("group_all_match", F.lit(None).cast("boolean"))
    c = c.withColumns({"address_full": F.when(F.startswith("_a", F.lit("a")), F.substring("_a", 2, 2**31 - 1)), "muni": F.when(F.col("_m") != "", F.substring("_m", 2, 2**31 - 1))})
    beside_poi = [F.when(missing, F.col("_poi.osm_id")).alias("poi_id"), F.when(missing, F.nullif(F.trim("_poi._post"), F.lit(""))).alias("proposed_postcode")] if poi else []
    out = c.select(*cands.columns, "sibling_id", "sibling_dist", "is_canonical", *[F.col(f"_best.{x}").alias(x) for x in ("dist", "osm_id", "osm_type", *["tags"] * tags)], "verdict", *beside_poi, "group_all_match")
    return out if wanted is None else out.select(*wanted)
