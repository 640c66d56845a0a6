"""File discovery and the footprint cache. Only listings are read, never pixels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FOOTPRINT_CACHE_NAME, LAYER_SUFFIXES, OUTPUT_DIR_SUFFIXES, RASTER_SUFFIXES
from ..functions.naming import file_suffix


def list_files(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """Recursive listing: path, length and modification time; contents are pruned away."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder).select("path", "length", "modificationTime")


def with_suffix(files: DataFrame, suffixes=RASTER_SUFFIXES, path: str = "path") -> DataFrame:
    return files.filter(file_suffix(path).isin([s.lower() for s in suffixes]))


def relative_path(path, root) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(p, F.concat(F.lit("^(file:)?"), F.lit(str(root).rstrip("/")), F.lit("/")), "")


def scan_folder(spark: SparkSession, folder: str, suffixes=RASTER_SUFFIXES) -> DataFrame:
    """Raster files under a folder, by path."""
    found = with_suffix(list_files(spark, folder), suffixes)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path",
                        relative_path("path", folder).alias("relative_path")).orderBy("path")


def is_source(path="path") -> Column:
    """False for cache files and for anything under an output folder of a run."""
    p = F.col(path) if isinstance(path, str) else path
    parts = F.split(p, "/")
    ours = F.exists(F.slice(parts, 1, F.size(parts)), lambda d: reduce(
        lambda a, b: a | b, [d.endswith(s) for s in OUTPUT_DIR_SUFFIXES]))
    name = F.element_at(parts, -1)
    return ~ours & ~name.isin(FOOTPRINT_CACHE_NAME, FOOTPRINT_CACHE_NAME + ".tmp")


def union_matches(matches: list[DataFrame], path: str = "path") -> DataFrame:
    """Union of several pattern matches without duplicates or run output."""
    return reduce(DataFrame.unionByName, [m.select(path) for m in matches]).distinct().filter(is_source(path))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail when a listing is empty; a listing is metadata, so one row is fetched."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def discover_layer(spark: SparkSession, folder: str, priority: int, suffixes=LAYER_SUFFIXES) -> DataFrame:
    """Source files of one layer; an empty layer is an error."""
    found = union_matches([list_files(spark, folder, f"*.{s}") for s in suffixes])
    found = require_rows(found, f"layer priority={priority} folder={folder} matched no files")
    return found.withColumn("priority", F.lit(priority))


def add_flat_sources(layers: DataFrame, flat: DataFrame) -> DataFrame:
    """Flat sources go below every layer: one priority number after the last."""
    below = layers.agg((F.max("priority") + 1).alias("p")).scalar()
    return layers.select("path", "priority").unionByName(flat.select("path", below.alias("priority")))


CACHE_KEYS = ["path", "size", "mtime"]


def flag_cached(current: DataFrame, cached: DataFrame) -> DataFrame:
    """Every current file with ``cache_hit``: its path, size and time are in the cache.

    Duplicates of the cache are dropped on the join key, so the join reuses that
    shuffle and each side is read once.
    """
    valid = cached.select(*CACHE_KEYS).dropDuplicates(CACHE_KEYS).withColumn("_hit", F.lit(True))
    return current.join(valid, CACHE_KEYS, "left").withColumn(
        "cache_hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def refresh_cache(current: DataFrame, cached: DataFrame, read) -> DataFrame:
    """Cached footprints for unchanged files, ``read(misses)`` for the others."""
    misses = flag_cached(current, cached).filter(~F.col("cache_hit")).drop("cache_hit")
    kept = cached.join(current.select(*CACHE_KEYS), CACHE_KEYS, "left_semi").withColumn("cache_hit", F.lit(True))
    return kept.unionByName(read(misses).withColumn("cache_hit", F.lit(False)))
