"""Whole runs on byte tiles: a pixel never becomes a row between the stored images and the written index."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import reduce
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CLASS_RGB, CLASSES, DEFAULT_NAME, INCOMPATIBLE, VETO_DEFAULT, VETO_RGB_SQ, VETO_THRESHOLDS
from ..operators import runs
from ..operators.export import cell_material_table, write_lines
from ..operators.overlay import veto_summary
from ..operators.tiles import TILE_COLUMNS, block_of
from ..schema import TILE, TILE_KEYS
from ..session import cut_lineage
from ..sources import files, profiles
from ..sources.rasters import footprints
from . import material_map as mm
from .cell_run import CellConfig, mosaic_tiles

#: Index of each class in the material table; zero is uncovered.
CMIX = {c["name"]: i for i, c in enumerate(CLASSES, 1)}


def _one_band(t, block: np.ndarray) -> tuple:
    return (t.raster_id, t.tile_row, t.tile_col, t.row0, t.col0, t.h, t.w, t.raster_h, t.raster_w, 1,
            np.ascontiguousarray(block, dtype=np.uint8).tobytes())


def index_tiles(labels: DataFrame, materials: tuple[str, ...]) -> DataFrame:
    """Label tiles (0 uncovered, else one-based clusters) to index tiles; every tile is on its own."""
    lut = np.array([0, *(CMIX[m] for m in materials)], dtype=np.uint8)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([_one_band(t, lut[block_of(t)[0]]) for t in pdf.itertuples(index=False)], columns=TILE_COLUMNS)

    return labels.mapInPandas(run, TILE)


def fuse_tiles(index: DataFrame, masks: list[tuple[DataFrame, str]]) -> DataFrame:
    """Paints mask tiles over index tiles of the same grid, the last mask on top.

    Tiles meet on their key, one row each; what no image covers stays zero.
    """
    for mask, material in masks:
        value = CMIX[material]

        def run(frames: Iterator[pd.DataFrame], value: int = value) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                rows = []
                for t in pdf.itertuples(index=False):
                    a = block_of(t)[0]
                    if t.mask is not None:
                        m = np.frombuffer(t.mask, dtype=np.uint8).reshape(a.shape)
                        a = np.where((m > 0) & (a > 0), value, a)
                    rows.append(_one_band(t, a))
                yield pd.DataFrame(rows, columns=TILE_COLUMNS)

        held = index.join(mask.select(*TILE_KEYS, F.col("data").alias("mask")), TILE_KEYS, "left")
        index = held.select(*TILE_COLUMNS, "mask").mapInPandas(run, TILE)
    return index


def fuse_tiles_with_veto(index: DataFrame, original: DataFrame, masks: list[tuple[DataFrame, str, str]], tile: int,
                         colours: dict[str, tuple[int, int, int]], everywhere: bool = False) -> tuple[DataFrame, DataFrame]:
    """Paints masks over index tiles, without the components that the image contradicts: (index tiles, veto table).

    ``masks`` are mask tiles on the same grid with their material and source; ``colours`` are those a pixel may be too
    close to. All masks become runs at once: one labelling, one exchange with the image's tiles for the contradicting
    pixels of every run, and one with the index tiles, whatever the number of masks. Masks of sources that cannot
    veto are not labelled. Water goes below roads and these below buildings.
    """
    order = {"BM_WATER": 0, "BM_ASPHALT": 1, "BM_CONCRETE": 2}
    ranked = sorted(masks, key=lambda m: order.get(m[1], 9))
    limits = [float(VETO_THRESHOLDS.get(source, VETO_DEFAULT)) for _, _, source in ranked]
    layers = [df.select(*TILE_COLUMNS).withColumn("layer", F.lit(i)) for i, (df, _, _) in enumerate(ranked)]
    of_layer = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("layer") + 1)
    by = ("raster_id", "layer")
    plain = [x for x, limit in zip(layers, limits) if limit > 1]
    kept = [runs.tile_runs(reduce(DataFrame.unionByName, plain), ("layer",))] if plain else []
    table = index.sparkSession.createDataFrame([], "raster_id string, layer int, comp long, area long, bad long, vetoed boolean")
    doubted = [x for x, limit in zip(layers, limits) if limit <= 1]
    if doubted:
        rules = [[colours[n] for n in INCOMPATIBLE.get(m, ()) if n in colours] for _, m, _ in ranked]

        def contradicting(bands: np.ndarray) -> list[np.ndarray]:
            a = bands[:3].astype(np.int64)
            near = lambda c: sum((x - v) ** 2 for x, v in zip(a, c)) <= VETO_RGB_SQ
            none = np.zeros(a.shape[1:], dtype=bool)
            return [np.logical_or.reduce([none, *(near(c) for c in cs)]) for cs in rules]

        labels = runs.label_runs(runs.tile_runs(reduce(DataFrame.unionByName, doubted), ("layer",)), tile, 8, by)
        names = [f"bad{i}" for i in range(len(ranked))]
        counted = runs.with_sums(cut_lineage(labels), original, names, contradicting)
        bad = F.sum(F.element_at(F.array(*[F.col(n) for n in names]), F.col("layer") + 1))
        table = runs.run_stats(counted, by, [bad.alias("bad")]).select(
            *by, "comp", "area", "bad", (F.col("bad") / F.col("area") >= of_layer(limits)).alias("vetoed"))
        table = cut_lineage(table)
        kept.append(runs.runs_of(labels, table.filter("NOT vetoed"), by).select(kept[0].columns if kept else [*runs.RUN_COLUMNS, "layer"]))
    painted = reduce(DataFrame.unionByName, kept).withColumn("paint", of_layer([CMIX[m] for _, m, _ in ranked]))
    return (runs.painted_tiles(index, painted, "layer", "paint", everywhere),
            table.withColumn("material", of_layer([m for _, m, _ in ranked])))


def masked_run(tiles: DataFrame, masks: list[tuple[DataFrame, str, str]], opts: mm.Options = mm.Options(),
               model: mm.Model | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tiles and named mask tiles to index tiles, their histogram, and the veto totals by material.

    Labels, names and training are those of ``classify_tiles``; masks are painted everywhere, as on the pixel form.
    """
    labels, named = mm.classify_tiles(tiles, opts, model)
    index = index_tiles(labels, named.materials)
    colours = {n: CLASS_RGB[n] for n in opts.names}
    index, table = fuse_tiles_with_veto(index, tiles, masks, opts.tile, colours, everywhere=True) if masks else (
        index, tiles.sparkSession.createDataFrame([], "material string, vetoed boolean"))
    index = cut_lineage(index)
    counts = mm.tile_histogram(index).select(F.col("cluster").alias("cmix"), F.col("n").alias("n_px"))
    return index, counts, veto_summary(table)


def index_histogram(index: DataFrame, cells: int) -> DataFrame:
    """Cells and percentage per index value over a grid of ``cells`` cells; cells without a tile count as zero."""
    counted = mm.tile_histogram(index).select(F.col("cluster").alias("cmix"), "n")
    covered = counted.filter("cmix > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    zero = covered.select(F.lit(0).alias("cmix"), (F.lit(cells) - F.col("n")).alias("n"))
    names = F.element_at(F.array(F.lit(DEFAULT_NAME), *[F.lit(c["name"]) for c in CLASSES]), F.col("cmix") + 1)
    return counted.filter("cmix > 0").unionByName(zero).select(
        F.col("cmix").cast("int").alias("cmix"), names.alias("name"), F.col("n").alias("n_px"),
        (F.col("n") * 100.0 / cells).alias("pct"))


def cell_index(tiles: DataFrame, sources: DataFrame, cfg: CellConfig, masks: list[tuple[DataFrame, str]] | None = None,
               opts: mm.Options = mm.Options(), model: mm.Model | None = None) -> tuple[DataFrame, DataFrame]:
    """Stored tiles to index tiles of the cell and their histogram: composite, label, paint masks."""
    image, width, height, _ = mosaic_tiles(tiles, sources, cfg, opts.tile)
    image = cut_lineage(image)
    labels, named = mm.classify_tiles(image, opts, model)
    index = fuse_tiles(index_tiles(labels, named.materials), masks or [])
    return index, index_histogram(index, width * height)


# --- a run from its manifest --------------------------------------------------

def discover(spark: SparkSession, cfg: CellConfig) -> DataFrame:
    """Files of all layers and flat sources: (path, size, mtime, priority). An empty layer is an error."""
    def listed(folder: str, globs: tuple[str | None, ...], priority: int) -> DataFrame:
        found = reduce(DataFrame.unionByName, [files.list_files(spark, folder, g) for g in globs])
        found = found.filter(files.is_source()).dropDuplicates(["path"])
        found = files.require_rows(found, f"layer priority={priority} folder={folder} matched no files")
        return found.select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"),
                            F.lit(priority).alias("priority"))

    below = max(x.priority for x in cfg.layers) + 1
    parts = [listed(x.folder, x.glob, x.priority) for x in cfg.layers] + [listed(s, (None,), below) for s in cfg.sources]
    return cut_lineage(reduce(DataFrame.unionByName, parts))


def signature(found: DataFrame, cfg: CellConfig, opts: mm.Options, model: mm.Model | None = None,
              masks: list[tuple[DataFrame, str]] | None = None) -> str:
    """One text that changes with any file, mask, the configuration, the options or a given model; rows are summed where they lie."""
    row = found.agg(F.count("*"), F.sum(F.xxhash64("path", "size", "mtime", "priority").cast("decimal(38,0)"))).first()
    painted = [(material, mask.agg(F.sum(F.xxhash64(*TILE_KEYS, "data").cast("decimal(38,0)"))).first()[0]) for mask, material in masks or []]
    return sha256(repr((replace(cfg, overwrite=False), opts, model, painted, *row)).encode()).hexdigest()


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    done = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.parquet(path) if done else None


#: What a run leaves in its output folder; anything else there is not ours.
OWN = {"runs", "current", "materials"}


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _current(spark: SparkSession, out: str) -> str | None:
    """Signature of the published run."""
    fs, where = _file_system(spark, f"{out}/current")
    return spark.read.text(f"{out}/current").first()[0].strip() if fs.exists(where) else None


def _publish(spark: SparkSession, out: str, mark: str) -> None:
    """Points to a finished run by one rename, so a reader finds the run before or this one, and never a part."""
    jvm = spark.sparkContext._jvm
    fs, new = _file_system(spark, f"{out}/.current-{uuid.uuid4().hex}")
    stream = fs.create(new, True)
    stream.write((mark + "\n").encode())
    stream.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{out}/current"), how)


def _guard(spark: SparkSession, out: str) -> None:
    fs, where = _file_system(spark, out)
    if fs.exists(where):
        odd = sorted({x.getPath().getName() for x in fs.listStatus(where)} - OWN)
        odd = [n for n in odd if not n.startswith(".")]
        if odd:
            raise FileExistsError(f"{out} holds {odd[0]}, which no run wrote; choose another folder or set overwrite")


def published(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame] | None:
    """Index and histogram of the run that is published under a folder; None without one."""
    mark = _current(spark, out.rstrip("/"))
    if mark is None:
        return None
    run = f"{out.rstrip('/')}/runs/{mark}"
    return spark.read.parquet(f"{run}/index"), spark.read.parquet(f"{run}/histogram")


def run_manifest(spark: SparkSession, cfg: CellConfig, read_headers: Callable[[DataFrame], DataFrame],
                 read_tiles: Callable[[DataFrame], DataFrame], masks: list[tuple[DataFrame, str]] | None = None,
                 opts: mm.Options = mm.Options(), model: mm.Model | None = None,
                 read_mask: Callable[[str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Discovery to the written pair: index tiles and histogram of a run, and the material table, under ``cfg.output``.

    ``read_headers(files)`` gives raster headers of files, ``read_tiles(sources)`` their
    stored tiles, and ``masks`` mask tiles on the cell's grid with their material (used when ``cfg.use_models`` holds);
    ``read_mask(path)`` gives the mask tiles of ``cfg.water_mask``, which is painted below the others.
    Reading image formats is the caller's. Headers of unchanged files come from the
    footprint cache of the published run.

    A run has a folder of its own, ``runs/<signature>`` of its files and settings. Its parts (headers, mosaic, model, index,
    histogram) are written one after the other by Spark's committer; a run that died goes on after its last whole part.
    The finished run is published by replacing the file ``current`` in one rename, so the run before stays whole until then. A published
    run of the same files and settings is not repeated; another one, or a folder with other content, is an error unless
    ``cfg.overwrite`` is set.
    """
    if cfg.water_mask and read_mask is None:
        raise ValueError("the manifest names a water mask: pass read_mask")
    found = discover(spark, cfg)
    used = (masks or []) if cfg.use_models else []
    mark, out = signature(found, cfg, opts, model, used), cfg.output.rstrip("/")
    last = _current(spark, out)
    if last == mark:
        return published(spark, out)
    if not cfg.overwrite:
        if last is not None:
            raise FileExistsError(f"{out} holds another run; set overwrite to replace it")
        _guard(spark, out)
    run = f"{out}/runs/{mark}"

    def part(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        done = _stored(spark, f"{run}/{name}")
        if done is None:
            make().write.mode("overwrite").parquet(f"{run}/{name}")
            done = spark.read.parquet(f"{run}/{name}")
        return done

    def read_all_headers() -> DataFrame:
        cached = _stored(spark, f"{out}/runs/{last}/footprints") if last else None
        if cached is None:
            return read_headers(found)
        misses = files.flag_cached(found, cached).filter("NOT cache_hit").drop("cache_hit")
        return cached.drop("priority").join(found, files.CACHE_KEYS).unionByName(read_headers(misses))

    headers = part("footprints", read_all_headers)
    sized = headers.select("path", "width", "height")
    sources = footprints(headers).join(sized, "path").withColumn(
        "px_x", (F.col("east") - F.col("west")) / F.col("width")).withColumn(
        "px_y", (F.col("north") - F.col("south")) / F.col("height")).drop("width", "height")
    _, width, height, _ = _grid(sources, cfg)
    image = part("mosaic", lambda: mosaic_tiles(read_tiles(sources), sources, cfg, opts.tile)[0])

    def learn() -> DataFrame:
        got = mm.name_centres(model or mm.train_tiles(image, opts), opts, spark)
        return spark.createDataFrame([(json.dumps([got.features, got.scaler, got.centres, got.materials]),)], "model string").coalesce(1)

    names, scaler, centres, materials = json.loads(part("model", learn).first()[0])
    named = mm.Model(tuple(names), {n: tuple(v) for n, v in scaler.items()}, tuple(map(tuple, centres)), tuple(materials))
    painted = [(read_mask(cfg.water_mask), "BM_WATER")] if cfg.water_mask else []
    index = part("index", lambda: fuse_tiles(index_tiles(mm.score_tiles(image, named, opts), named.materials), painted + used))
    hist = part("histogram", lambda: index_histogram(index, width * height))
    classes = profiles.class_dim(spark).select(F.col("cmix").alias("pos"), "name", "color", "composite_name")
    # the material table is that of the classes, the same for every run
    write_lines(cell_material_table(classes), f"{out}/materials", ["pos"], overwrite=True)
    _publish(spark, out, mark)
    return index, hist


def _grid(sources: DataFrame, cfg: CellConfig):
    from .cell_run import plan_grid
    return plan_grid(sources, cfg)
