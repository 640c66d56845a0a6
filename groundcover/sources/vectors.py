"""Vector layers: box reads, tiled extracts, profiles and map-data JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.stats import attach_scalar
from ..operators.vector import features_per_tile

OSM_SCHEMA = ("struct<elements:array<struct<type:string,id:bigint,tags:map<string,string>,"
              "geometry:array<struct<lat:double,lon:double>>,"
              "members:array<struct<type:string,role:string,geometry:array<struct<lat:double,lon:double>>>>>>>")

BOX = {"west": "minx", "south": "miny", "east": "maxx", "north": "maxy"}


def read_bbox(features: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Features whose box meets the window, edges included; a missing box is skipped."""
    box = {k: F.col(v) for k, v in BOX.items()}
    return features.filter(F.col("minx").isNotNull() & ~F.isnan("minx")).filter(
        geo.touches(box, geo.lit_box(west, south, east, north)))


def tiled_extract(features: DataFrame, origin_x: float, origin_y: float, size: float, n_x, n_y,
                  distinct: bool = False) -> DataFrame:
    """Features by extract tile; a feature across tiles comes once per tile unless ``distinct``."""
    out = features_per_tile(features, origin_x, origin_y, size, n_x, n_y)
    if distinct:
        keep = [c for c in features.columns]
        return out.dropDuplicates(["layer", "feature_id"]).select(*keep)
    return out


def profile_layers(features: DataFrame, requested: DataFrame) -> DataFrame:
    """Count, type and extent per requested layer; a missing layer is reported, not fatal."""
    stats = features.groupBy("layer").agg(
        F.count("*").alias("n"), F.min("kind").alias("kind"), F.min("minx").alias("minx"),
        F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
    return requested.join(stats, "layer", "left").withColumn("ok", F.col("n").isNotNull())


def parse_osm(docs: DataFrame, geom_type: str, text: str = "json") -> DataFrame:
    """Ways and outer relation rings of map-data JSON documents as features.

    ``geom_type`` is ``polygon`` or ``line``. Short ways are dropped, rings are
    closed, polygons need four points.
    """
    el = docs.select(F.explode(F.from_json(text, OSM_SCHEMA)["elements"]).alias("e"))
    pts = lambda g: F.transform(F.coalesce(g, F.array().cast("array<struct<lat:double,lon:double>>")),
                                lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    same = lambda r: F.element_at(r, 1) == F.element_at(r, -1)
    closed = lambda r: F.when(same(r), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
    way = el.filter("e.type = 'way'").withColumn("_p", pts(F.col("e.geometry"))).filter(F.size("_p") >= 2)
    if geom_type == "polygon":
        way = way.withColumn("_r", closed(F.col("_p"))).filter(F.size("_r") >= 4)
        outer = F.filter("e.members", lambda m: (m["role"] == "outer") & (m["type"] == "way")
                         & (F.size(m["geometry"]) >= 3))
        rel = el.filter("e.type = 'relation'").withColumn("rings", F.transform(outer, lambda m: closed(pts(m["geometry"]))))
        rel = rel.filter(F.size("rings") > 0).select(F.col("e.id").alias("osm_id"), F.col("e.tags").alias("tags"), "rings")
        return way.select(F.col("e.id").alias("osm_id"), F.col("e.tags").alias("tags"),
                          F.array("_r").alias("rings")).unionByName(rel)
    return way.select(F.col("e.id").alias("osm_id"), F.col("e.tags").alias("tags"), F.array("_p").alias("rings"))


def frequent_tags(features: DataFrame, share: float = 0.05) -> DataFrame:
    """Tag names present on at least ``share`` of the features."""
    tags = features.select(F.explode(F.map_keys(F.coalesce("tags", F.create_map().cast("map<string,string>")))).alias("tag"))
    total = features.agg(F.count("*").alias("n")).scalar()
    return tags.groupBy("tag").agg(F.count("*").alias("n")).filter(F.col("n") >= total * F.lit(share))


def keep_frequent_tags(features: DataFrame, share: float = 0.05) -> DataFrame:
    """Drop tags that few features carry. The list holds tag names, at most one in twenty features each."""
    held = attach_scalar(features, frequent_tags(features, share).agg(F.collect_set("tag").alias("_keep")))
    return held.withColumn("tags", F.map_filter("tags", lambda k, v: F.array_contains("_keep", k))).drop("_keep")


def concat_layers(layers: list[DataFrame]) -> DataFrame:
    """Union of layers with differing columns; missing ones become null."""
    out = layers[0]
    for nxt in layers[1:]:
        out = out.unionByName(nxt, allowMissingColumns=True)
    return out


def attr(name: str) -> Column:
    return F.col("attrs")[name]
