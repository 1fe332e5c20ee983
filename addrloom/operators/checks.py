"""The check registry: each check gives a row for each candidate, and stages follow from the flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrloom.functions.geo import haversine, sample_ordinal, with_cells
from addrloom.functions.text import id_order, suspicious_suffix
from addrloom.operators.features import extra_tags
from addrloom.sources.recipes import Recipe

#: Height of the cells in which places meet, in radii.
CELL = 4
DUPLICATE_M, NEARBY_M, SLACK_M, SAMPLE, LISTED = 3.0, 20.0, 2.0, 50, 5
KEY = ["run_id", "candidate_id"]
RESULT = [*KEY, "check_id", "version", "verdict", "severity", "reason_code", "n_details", "details"]
VERSIONS = {"match_far": 2, "suffix_range": 2, "city_duplicate": 1, "intra_source_duplicate": 2, "missing_sample": 1, "nearby_street_mismatch": 2, "match_number_drift": 2, "potential_amenity": 4}


#: Fields without which a check has nothing to say.
REQUIRES = {"suffix_range": ("lo_num", "hi_num"), "intra_source_duplicate": ("address_class",)}


#: Columns of conflated candidates that a check looks at, besides their key and verdict.
LOOKS_AT = {"suffix_range": ("is_range", "lo_num_suf", "housenumber"), "city_duplicate": ("lat", "lon"), "intra_source_duplicate": ("sibling_id", "sibling_dist", "group_all_match"), "nearby_street_mismatch": ("housenumber", "street_norm", "lat", "lon"),
            "match_number_drift": ("housenumber", "street_norm", "lat", "lon", "dist"), "potential_amenity": ("osm_type", "tags")}
#: Checks that look about a candidate, at other candidates or features.
ABOUT = ("city_duplicate", "nearby_street_mismatch", "match_number_drift")


def columns(enabled: tuple[str, ...] = tuple(VERSIONS)) -> tuple[str, ...]:
    """The columns of conflated candidates that these checks look at."""
    return tuple(dict.fromkeys([*KEY, "verdict", *[x for check in enabled for x in LOOKS_AT.get(check, ())]]))


def available(recipe: Recipe, wanted: tuple[str, ...] = ()) -> tuple[str, ...]:
    """the checks whose fields the source declares; asking for another one by name is an error."""
    missing = {check: [f for f in fields if not recipe.declares(f)] for check, fields in REQUIRES.items()}
    for check in wanted:
        if missing.get(check):
            raise ValueError(f"{check} needs {', '.join(missing[check])}, which the source doesn't declare")
    return tuple(c for c in VERSIONS if not missing.get(c))


def _result(check: str, applies: Column, reason: Column, severity: str, passed: str, n: Column | None = None, details: Column | None = None) -> Column:
    """The struct of one check's result for a row. reason: null where the check passes. Rows it doesn't apply to are SKIP / not_applicable."""
    applies = F.coalesce(applies, F.lit(False))
    flag = applies & reason.isNotNull()
    none = F.lit(0).cast("bigint")
    return F.struct(
        F.lit(check).alias("check_id"), F.lit(VERSIONS[check]).alias("version"), F.when(~applies, "SKIP").when(flag, "FLAG").otherwise("PASS").alias("verdict"), F.when(flag, F.lit(severity)).alias("severity"),
        F.when(~applies, "not_applicable").when(flag, reason).otherwise(F.lit(passed)).alias("reason_code"), F.when(flag, F.coalesce(n, none) if n is not None else none).otherwise(none).alias("n_details"),
        F.when(flag, details if details is not None else F.lit(None).cast("string")).alias("details"),
    )


def cm(metres: Column) -> Column:
    """Metres rounded to two places, as whole centimetres."""
    return F.round(metres * 100).cast("bigint")


def listed(entries: Column, most: int = LISTED) -> Column:
    """Details as text: the first ``most`` entries (cm, id) by distance, then id: id@metres, with bars between."""
    shown = lambda e: F.concat(e["id"], F.lit("@"), F.format_string("%d.%02d", F.floor(e["cm"] / 100).cast("bigint"), F.pmod(e["cm"], F.lit(100))))
    return F.array_join(F.transform(F.slice(F.array_sort(entries), 1, most), shown), "|")


def _nearest(pairs: DataFrame, entry: Column, by: list[str], most: int) -> DataFrame:
    """(by, n, near): the number of rows of each key and the ``most`` smallest entries; ``pairs`` is worked out and shuffled once."""
    key = Window.partitionBy(*by)
    p = pairs.withColumn("_entry", entry).withColumns({"n": F.count("*").over(key), "_place": F.row_number().over(key.orderBy("_entry"))})
    return p.where(F.col("_place") <= most).groupBy(*by).agg(F.first("n").alias("n"), F.collect_list("_entry").alias("near"))


def close_candidates(c: DataFrame, radius_m: float) -> DataFrame:
    """For each candidate the number of others of its run within the radius and the nearest of them.

    Candidates are reduced to distinct places first, with their number and the lowest ids; only places meet in the grid. So a
    stack of units or a point that many rows share gives no pairs.
    """
    at = ["run_id", "lat", "lon"]
    rows = c.where("lat is not null and lon is not null").select(*at, "candidate_id", F.struct(id_order(F.col("candidate_id")).alias("o"), F.col("candidate_id").alias("id")).alias("me"))
    places = _nearest(rows, F.col("me"), at, LISTED + 1)
    a = with_cells(places.select(*at), radius_m, around=True, wide=CELL)
    b = with_cells(places.select("run_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "n", "near"), radius_m, "_lat", "_lon", wide=CELL)
    dist = haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    pairs = a.hint("merge").join(b, ["run_id", "cy", "cx"]).withColumn("dist", dist).where(F.col("dist") <= radius_m)
    entries = F.transform("near", lambda e: F.struct(cm(F.col("dist")).alias("cm"), e["o"].alias("o"), e["id"].alias("id")))
    # of each place's neighbours LISTED + 1 are enough, as a candidate takes itself away at most
    few = pairs.select(*at, "n", F.slice(F.array_sort(entries), 1, LISTED + 1).alias("e"))
    n = few.groupBy(*at).agg(F.sum("n").alias("all"))
    near = few.select(*at, F.explode("e").alias("_entry")).withColumn("_place", F.row_number().over(Window.partitionBy(*at).orderBy("_entry")))
    near = near.where(F.col("_place") <= LISTED + 1).groupBy(*at).agg(F.collect_list("_entry").alias("near"))
    j = rows.hint("merge").join(n.hint("merge").join(near, at), at)
    others = F.transform(F.filter("near", lambda e: e["id"] != F.col("candidate_id")), lambda e: F.struct(e["cm"].alias("cm"), e["o"].alias("o"), e["id"].alias("id")))
    return j.where("all > 1").select(*KEY, (F.col("all") - 1).alias("n"), listed(others).alias("list"))


def _feature_cells(features: DataFrame, radius_m: float) -> DataFrame:
    f = features.where(~F.col("is_poi")).select("osm_id", "osm_type", "num", F.col("street_norm").alias("_street"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    return with_cells(f, radius_m, "_lat", "_lon", wide=CELL)


def _close_features(rows: DataFrame, features: DataFrame, reach_m: float, key: Column, wanted: Column, within: Column | None = None) -> DataFrame:
    """(key, n, list): the distinct features of the cells about each row that share ``key`` and are ``wanted``, by distance; rows look ``within`` so many metres, the reach unless given."""
    f = _feature_cells(features, reach_m).withColumnsRenamed({"cy": "_cy", "cx": "_cx"})
    p = with_cells(rows, reach_m, around=True, wide=CELL, within=within).hint("merge").join(f, (F.col("cy") == F.col("_cy")) & (F.col("cx") == F.col("_cx")) & key)
    p = p.withColumn("_d", haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))).where(wanted)
    p = p.groupBy(*KEY, "osm_type", "osm_id").agg(F.min("_d").alias("_d"))
    entry = F.struct(cm(F.col("_d")).alias("cm"), F.col("osm_type").alias("kind"), F.col("osm_id").alias("no"), F.concat_ws("/", "osm_type", "osm_id").alias("id"))
    found = _nearest(p, entry, KEY, LISTED)
    return found.select(*KEY, "n", listed(F.col("near")).alias("list"))


def mismatched(c: DataFrame, features: DataFrame, radius_m: float) -> DataFrame:
    """Features with a candidate's number on another street, close by; features without street don't count."""
    rows = c.where(_open_mismatch()).select(*KEY, "housenumber", "street_norm", "lat", "lon")
    return _close_features(rows, features.where("street_norm <> ''"), radius_m, F.col("housenumber") == F.col("num"), (F.col("street_norm") != F.col("_street")) & (F.col("_d") <= radius_m))


def _open_mismatch() -> Column:
    return (F.col("verdict") == "MISSING") & (F.trim("housenumber") != "") & F.col("lat").isNotNull() & F.col("lon").isNotNull()


def _open_drift() -> Column:
    return F.col("verdict").isin("MATCH", "MATCH_FAR") & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("dist").isNotNull() & (F.col("street_norm") != "") & (F.trim("housenumber") != "")


def reach_of(c: DataFrame) -> float:
    """The distance within which drift can be found: that of the farthest match, whatever radius the conflation used."""
    return max(c.agg(F.max("dist")).first()[0] or 0.0, 1.0)


def drifted(c: DataFrame, features: DataFrame, slack_m: float) -> DataFrame:
    """Other numbers of a candidate's street that lie closer than the matched feature, by the slack at least."""
    # a row looks no farther than its own match, by a centimetre more for rounding; one that is matched within the slack has nothing to find
    rows = c.where(_open_drift() & (F.col("dist") >= slack_m)).select(*KEY, "housenumber", "street_norm", "lat", "lon", "dist")
    return _close_features(rows, features, reach_of(c), F.col("street_norm") == F.col("_street"), (F.col("housenumber") != F.col("num")) & (F.col("_d") <= F.col("dist") - slack_m), F.col("dist") - slack_m + 0.01)


def missing_nearby(c: DataFrame, flagged: DataFrame) -> DataFrame:
    """For each flagged candidate the MISSING ones of its run and street within its matched distance: (key, n, list)."""
    reach = reach_of(c)
    rows = with_cells(c.hint("merge").join(flagged.select(*KEY), KEY, "left_semi").select(*KEY, "street_norm", "lat", "lon", "dist"), reach, around=True, wide=CELL)
    m = c.where("verdict = 'MISSING' and lat is not null and lon is not null").select("run_id", F.col("candidate_id").alias("other"), "street_norm", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    p = rows.hint("merge").join(with_cells(m, reach, "_lat", "_lon", wide=CELL), ["run_id", "street_norm", "cy", "cx"]).where(F.col("candidate_id") != F.col("other"))
    p = p.withColumn("_d", haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))).where(F.col("_d") <= F.col("dist"))
    entry = F.struct(cm(F.col("_d")).alias("cm"), id_order(F.col("other")).alias("o"), F.col("other").alias("id"))
    return _nearest(p, entry, KEY, LISTED).select(*KEY, "n", listed(F.col("near")).alias("list"))


def run_checks(c: DataFrame, features: DataFrame, enabled: tuple[str, ...] = tuple(VERSIONS), duplicate_m: float = DUPLICATE_M, nearby_m: float = NEARBY_M, slack_m: float = SLACK_M, every: int = SAMPLE, per_run: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """All results of the enabled checks over candidates that aren't SKIPPED; the right sides see every candidate.

    ``per_run`` (run_id, every): runs with a sampling rate of their own; 0 samples none. ``keep``: columns of candidates that
    stand beside their results, so that who needs them doesn't join once more.

    The three checks that look about a candidate are joined to it once; the results of a row are then one array.
    """
    joined = {"city_duplicate": lambda: close_candidates(c, duplicate_m), "nearby_street_mismatch": lambda: mismatched(c, features, nearby_m), "match_number_drift": lambda: drifted(c, features, slack_m)}
    # to whom they apply is said before the joins, so that these move a flag instead of what it is made of
    applies = {"city_duplicate": F.col("lat").isNotNull() & F.col("lon").isNotNull(), "nearby_street_mismatch": _open_mismatch(), "match_number_drift": _open_drift()}
    rows = c.where("verdict <> 'SKIPPED'").withColumns({f"_applies_{check}": on for check, on in applies.items() if check in enabled})
    n, text = {}, {}
    for check, find in joined.items():
        if check in enabled:
            rows = rows.hint("merge").join(find().select(*KEY, F.col("n").alias(f"_n_{check}"), F.col("list").alias(f"_list_{check}")), KEY, "left")
        n[check], text[check] = F.col(f"_n_{check}"), F.col(f"_list_{check}")

    def about(check: str, severity: str, passed: str) -> Column:
        return _result(check, F.col(f"_applies_{check}"), F.when(n[check] > 0, check), severity, passed, n[check], text[check])

    extra = extra_tags(F.from_json("tags", "map<string,string>"))
    suffix = suspicious_suffix(F.nullif(F.col("lo_num_suf"), F.lit("None")), F.col("housenumber"))
    rows = rows.join(per_run.select("run_id", F.col("every").alias("_every")), "run_id", "left") if per_run is not None else rows.withColumn("_every", F.lit(None).cast("int"))
    rate = F.coalesce("_every", F.lit(every))
    hit = F.when(rate > 0, sample_ordinal(F.col("candidate_id")) % rate == 0).otherwise(False)
    matched = F.col("verdict").isin("MATCH", "MATCH_FAR")
    result = {
        "match_far": lambda: _result("match_far", F.col("verdict") == "MATCH_FAR", F.lit("match_far"), "warn", "ok"),
        "suffix_range": lambda: _result("suffix_range", F.col("verdict") == "MISSING", F.when(F.col("is_range"), "range").when(suffix != "", "suspicious_suffix"), "info", "ok"),
        "city_duplicate": lambda: about("city_duplicate", "info", "unique_location"),
        "intra_source_duplicate": lambda: _result("intra_source_duplicate", F.col("sibling_id").isNotNull() & ~F.coalesce("group_all_match", F.lit(False)), F.lit("intra_source_duplicate"), "info", "ok", details=listed(F.array(F.struct(cm(F.col("sibling_dist")).alias("cm"), F.col("sibling_id").alias("id"))))),
        "missing_sample": lambda: _result("missing_sample", F.col("verdict") == "MISSING", F.when(hit, "spot_check"), "info", "not_sampled"),
        "nearby_street_mismatch": lambda: about("nearby_street_mismatch", "warn", "no_nearby_mismatch"),
        "match_number_drift": lambda: about("match_number_drift", "warn", "no_number_drift"),
        "potential_amenity": lambda: _result("potential_amenity", matched & (F.col("osm_type") == "node") & F.col("tags").isNotNull(), F.when(F.size(extra) > 0, "potential_amenity"), "info", "pure_address", F.size(extra).cast("bigint"), F.array_join(extra, ",")),
    }
    return rows.select(*KEY, *keep, F.explode(F.array(*[result[check]() for check in enabled])).alias("r")).select(*KEY, *keep, "r.*")


def stages(c: DataFrame, results: DataFrame) -> DataFrame:
    """The stage after the checks and the sorted reasons of the flags."""
    flags = results.where("verdict = 'FLAG'").groupBy("run_id", "candidate_id").agg(F.array_join(F.array_sort(F.collect_set("reason_code")), ",").alias("reasons"))
    j = c.select("run_id", "candidate_id", "verdict").hint("merge").join(flags, ["run_id", "candidate_id"], "left")
    stage = F.when(F.col("verdict") == "SKIPPED", "SKIPPED").when(F.col("reasons").isNotNull(), "REVIEW_PENDING").when(F.col("verdict") == "MISSING", "APPROVED").when(F.col("verdict") == "MATCH", "SKIPPED").otherwise("CHECKED")
    return j.withColumn("stage", stage)


def rerouted(items: DataFrame, staged: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """The review items after a run of the checks, and the keys of those that it cleared.

    ``items``: key, reason_code, status, opened_at; ``staged``: what ``stages`` returns for all rows of the run. A flagged row
    has an item, opened at ``at`` if it is new; of one that exists only the reasons change. An OPEN item of a row that is
    no longer flagged goes; decided ones stay, as do those of rows that the checks don't look at.
    """
    seen = staged.where("verdict <> 'SKIPPED'").select(*KEY, F.col("reasons").alias("_reasons"), F.lit(True).alias("_seen"))
    j = items.withColumn("_old", F.lit(True)).hint("merge").join(seen, KEY, "full_outer")
    stale = F.coalesce(F.col("_old") & F.col("_seen") & F.col("_reasons").isNull() & (F.col("status") == "OPEN"), F.lit(False))
    j = j.withColumn("_stale", stale).where(F.col("_old") | F.col("_reasons").isNotNull())
    kept = j.where("NOT _stale").select(*KEY, F.coalesce("_reasons", "reason_code").alias("reason_code"), F.coalesce("status", F.lit("OPEN")).alias("status"), F.when(F.col("_old"), F.col("opened_at")).otherwise(at).alias("opened_at"))
    return kept, j.where("_stale").select(*KEY)


def pending(results: DataFrame, stored: DataFrame) -> DataFrame:
    """Results not stored yet for their check and version."""
    return results.hint("merge").join(stored, ["run_id", "candidate_id", "check_id", "version"], "left_anti")
