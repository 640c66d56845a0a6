"""Calibration profiles: merge of user values over factory values, and migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CLASSES, LEGACY_PARENT
from ..functions.naming import literal_map

PROFILE_SCHEMA = ("version int, name string, created_at string, raster_path string, "
                  "material_overrides map<string,struct<reference_color:string,anchors:array<array<int>>,"
                  "tolerance_radius:int,sample_count:int,sample_std_rgb:array<double>>>, "
                  "bias_overrides map<string,double>")


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """One row per material of a profile file; entries that are not objects are skipped."""
    raw = spark.read.schema(PROFILE_SCHEMA).option("multiLine", "true").json(path)
    return raw.select("version", F.explode("material_overrides").alias("material", "m")).filter(
        F.col("m").isNotNull()).select("version", "material", "m.*")


def migrate(materials: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Fold the anchors of absorbed names into their parent, without repeats, order kept.

    ``materials`` has ``version, material, anchors`` (null anchors for malformed
    entries). Versions from three on pass through.
    """
    by = by or []
    legacy_order = {n: i + 1 for i, n in enumerate(LEGACY_PARENT)}
    parents = literal_map(LEGACY_PARENT)[F.col("material")]
    old = F.col("version") < 3
    moved = materials.withColumn("_parent", F.when(old & parents.isNotNull(), parents).otherwise(F.col("material")))
    moved = moved.withColumn("_pos", F.when(old, F.coalesce(literal_map(legacy_order)[F.col("material")], F.lit(0))).otherwise(0))
    moved = moved.filter((F.col("_pos") == 0) | F.col("anchors").isNotNull())
    lists = moved.groupBy(*by, F.col("_parent").alias("material")).agg(
        F.max("version").alias("version"),
        F.array_sort(F.collect_list(F.struct("_pos", F.coalesce(
            "anchors", F.array().cast("array<array<int>>")).alias("anchors")))).alias("_l"))
    # a parent and its absorbed names: at most four lists per profile
    return lists.select(*by, "material", F.when(F.col("version") < 3, F.lit(3)).otherwise(F.col("version")).alias("version"),
                        F.array_distinct(F.flatten(F.transform("_l", lambda x: x["anchors"]))).alias("anchors"))


def merge(factory: DataFrame, user: DataFrame, fields: list[str], by: list[str] | None = None) -> DataFrame:
    """User values win field by field; materials known to either side are kept."""
    keys = [*(by or []), "material"]
    f, u = factory.alias("f"), user.alias("u")
    on = [F.col(f"f.{k}") == F.col(f"u.{k}") for k in keys]
    return f.join(u, on, "full_outer").select(
        *[F.coalesce(F.col(f"u.{k}"), F.col(f"f.{k}")).alias(k) for k in keys],
        *[F.coalesce(F.col(f"u.{c}"), F.col(f"f.{c}")).alias(c) for c in fields])


def resolve_anchors(profile: DataFrame, defaults: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Anchors in force: a profile's non-empty list, else the default list of a known class."""
    keys = [*(by or []), "material"]
    mine = profile.filter(F.size("anchors") > 0).select(*keys, F.col("anchors").alias("_own"))
    every = profile.select(*(by or [])).distinct() if by else None
    base = defaults.select("material", F.col("anchors").alias("_base"))
    if every is not None:
        listed = base.agg(F.collect_list(F.struct("material", "_base")).alias("l")).scalar()  # the class table
        base = every.select(*by, F.explode(listed).alias("m")).select(*by, "m.material", "m._base")
    return base.join(mine, keys, "full_outer").select(*keys, F.coalesce("_own", "_base").alias("anchors"))


def legacy_names(classes: DataFrame) -> DataFrame:
    """Absorbed names and the class that absorbed them."""
    return classes.select(F.explode("sub_absorbs").alias("legacy"), F.col("name").alias("parent"))


def class_dim(spark: SparkSession) -> DataFrame:
    """The built-in class table."""
    from ..schema import CLASS_DIM
    from ..constants import hex_to_rgb
    rows = [(i, c["id"], c["name"], c["color"], *hex_to_rgb(c["color"]), c["composite_name"], c["source"],
             c["material_type"], c["anchors"], c["sub_absorbs"]) for i, c in enumerate(CLASSES, 1)]
    return spark.createDataFrame(rows, CLASS_DIM)
