"""Places: gazetteer lookup, distances, radius search, hotspots, map layers. Nothing unlocated gets coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.columns import haversine_km, plain_name
from dossier.operators.components import broadcast_up_to

KM_PER_DEGREE = 111.19


def geocode(rows: DataFrame, name: str, gazetteer: DataFrame) -> DataFrame:
    """rows with lat, lng, geo_source: the whole name, or else its first word if that is a city of one word.

    The first-word rule is an equi-join as well.
    """
    g = broadcast_up_to(gazetteer, 100_000)
    whole = g.select(F.col("name").alias("_n"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    city = g.filter(~F.contains("name", F.lit(" "))).select(F.col("name").alias("_c"), F.col("lat").alias("_clat"), F.col("lng").alias("_clng"))
    out = rows.withColumn("_plain", plain_name(F.col(name))).withColumn("_word", F.when(F.contains("_plain", F.lit(" ")), F.substring_index("_plain", " ", 1)))
    out = out.join(whole, F.col("_plain") == F.col("_n"), "left").join(city, F.col("_word") == F.col("_c"), "left")
    source = F.when(F.col("_n").isNotNull(), "gazetteer").when(F.col("_c").isNotNull(), "gazetteer-city")
    out = out.withColumns({"lat": F.coalesce("_lat", "_clat"), "lng": F.coalesce("_lng", "_clng"), "geo_source": source})
    return out.drop("_plain", "_word", "_n", "_lat", "_lng", "_c", "_clat", "_clng")


def backfill(rows: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Locations without coordinates get the gazetteer's; others stay."""
    found = geocode(rows.withColumnsRenamed({"lat": "_old_lat", "lng": "_old_lng", "geo_source": "_old"}), "normalized", gazetteer)
    take = F.col("_old_lat").isNull() & (F.col("node_type") == "Location")
    return found.withColumns({
        "lat": F.when(take, F.col("lat")).otherwise(F.col("_old_lat")), "lng": F.when(take, F.col("lng")).otherwise(F.col("_old_lng")),
        "geo_source": F.when(take, F.col("geo_source")).otherwise(F.col("_old")),
    }).drop("_old_lat", "_old_lng", "_old")


def override(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """Manual coordinates (entity_id, lat, lng) win, for locations and within range alone."""
    ok = corrections.filter(F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180)).select("entity_id", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    out = rows.join(ok, "entity_id", "left")
    take = F.col("_lat").isNotNull() & (F.col("node_type") == "Location")
    return out.withColumns({
        "lat": F.when(take, F.col("_lat")).otherwise(F.col("lat")), "lng": F.when(take, F.col("_lng")).otherwise(F.col("lng")),
        "geo_source": F.when(take, F.lit("manual")).otherwise(F.col("geo_source")),
    }).drop("_lat", "_lng")


def within_radius(points: DataFrame, centres: DataFrame, km: float = 5.0) -> DataFrame:
    """points x centres (centre_id, clat, clng) at most km apart, with `km`.

    A centre names the one-degree cells its circle touches (longitudes wrap, and widen towards the poles), so the
    join is on equal cells and distances are computed for candidates alone.
    """
    span = km / KM_PER_DEGREE
    #: The widest east-west reach of the circle lies at its latitude nearest a pole.
    nearest = F.least(F.abs(F.col("clat")) + span, F.lit(89.9))
    wide = F.least(F.lit(span) / F.cos(F.radians(nearest)), F.lit(180.0))
    rows = F.sequence(F.floor(F.col("clat") - span).cast("int"), F.floor(F.col("clat") + span).cast("int"))
    cols = F.sequence(F.floor(F.col("clng") - wide).cast("int"), F.floor(F.col("clng") + wide).cast("int"))
    cells = centres.withColumn("_row", F.explode(rows)).withColumn("_col", F.explode(F.array_distinct(F.transform(cols, lambda c: F.pmod(c + 180, F.lit(360))))))
    placed = points.filter("lat is not null and lng is not null").withColumn("_row", F.floor("lat").cast("int")).withColumn("_col", F.pmod(F.floor("lng").cast("int") + 180, F.lit(360)))
    met = placed.join(cells, ["_row", "_col"]).withColumn("km", haversine_km(F.col("clat"), F.col("clng"), F.col("lat"), F.col("lng")))
    return met.filter(F.col("km") <= km).drop("_row", "_col")


def hotspots(points: DataFrame, cell: float = 0.5) -> DataFrame:
    """Grid cells with two points and more (halves round to even)."""
    at = lambda c: (F.rint(F.col(c) / cell) * cell).alias(f"cell_{c}")
    located = points.filter("lat is not null and lng is not null")
    return located.groupBy(at("lat"), at("lng")).agg(F.count("*").alias("n"), F.sum(F.coalesce("weight", F.lit(0.5))).alias("weight")).filter("n >= 2")


def tower_points(rows: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Tower rows (tower, date, evidence_id, line) by (lower-case tower, date): count, first spelling and file, coordinates."""
    found = rows.groupBy(F.lower("tower").alias("tower_key"), "date").agg(
        F.count("*").alias("n"), F.min_by("tower", F.struct("evidence_id", "line")).alias("tower"), F.min("evidence_id").alias("evidence_id"),
    )
    return geocode(found, "tower", gazetteer)


def map_points(presences: DataFrame, devices: DataFrame, towers: DataFrame) -> DataFrame:
    """(layer, case_id, label, day, confidence, lat, lng): suspects at their latest places, device pings and towers.

    presences: case_id, label, day, confidence, lat, lng, at most one a label; devices, towers: the same columns. Rows
    without coordinates come as the layer `unlocated`, so nothing is lost from the counts.
    """
    cols = ("case_id", "label", "day", "confidence", "lat", "lng")
    layers = [rows.select(F.lit(name).alias("layer"), *cols) for name, rows in (("suspects", presences), ("devices", devices), ("towers", towers))]
    out = layers[0].unionByName(layers[1]).unionByName(layers[2])
    return out.withColumn("layer", F.when(F.col("lat").isNull() | F.col("lng").isNull(), "unlocated").otherwise(F.col("layer")))


def map_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("case_id", "layer").agg(F.count("*").alias("n"))


def map_filter(points: DataFrame, least: float = 0.0, since: str | None = None, until: str | None = None) -> DataFrame:
    """Points of a confidence and a time window: undated ones pass the window, and towers go by date alone."""
    out = points.filter((F.col("layer") == "towers") | (F.coalesce("confidence", F.lit(0.0)) >= least))
    for bound, op in ((since, lambda c, v: c >= v), (until, lambda c, v: c <= v)):
        if bound:
            out = out.filter(F.col("day").isNull() | op(F.col("day"), F.lit(bound).cast("date")))
    return out
