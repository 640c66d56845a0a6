"""Index raster, histogram, material tables and sidecar text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (CLASSES, DEFAULT_ARGB, DEFAULT_CMIX, DEFAULT_MATERIAL, DEFAULT_NAME, TXR_HEADER, TXS_LIBRARY,
                         TXS_LINES, hex_to_rgb)
from ..functions import color, naming
from ..functions.color import as_col


class PaletteError(ValueError):
    """A classified raster holds a colour outside the palette."""


def build_palette(classes: list[dict] | None = None) -> dict[int, int]:
    """Packed colour to one-based index; black or repeated colours are errors."""
    palette: dict[int, int] = {}
    for idx, c in enumerate(classes or CLASSES, start=1):
        text = str(c.get("color", "")).strip().lstrip("#")
        if len(text) != 6:
            raise ValueError(f"expected a #RRGGBB colour, got {c.get('color')!r}")
        r, g, b = hex_to_rgb(text)
        key = (r << 16) | (g << 8) | b
        if key == 0:
            raise ValueError(f"class {c.get('name')!r} is black, which is reserved for uncovered pixels")
        if key in palette:
            raise ValueError(f"class {c.get('name')!r} repeats a colour; colours must be injective")
        palette[key] = idx
    return palette


def rgb_to_cmix(px: DataFrame, palette: dict[int, int], strict: bool = False) -> DataFrame:
    """Index of each painted pixel. Unknown colours become zero, or fail when strict.

    Adds ``cmix`` and ``known``. Colours must match exactly.
    """
    packed = color.pack_rgb("r", "g", "b")
    idx = naming.literal_map({0: DEFAULT_CMIX} | palette)[packed]
    if strict:
        err = F.raise_error(F.format_string("colour #%06x is outside the class palette", packed))
        idx = F.coalesce(idx, err.cast("int"))
    return px.withColumn("known", idx.isNotNull()).withColumn("cmix", F.coalesce(idx, F.lit(DEFAULT_CMIX)))


def palette_errors(px: DataFrame) -> DataFrame:
    """The class table's colour problems as rows: black and repeated colours."""
    rgb = px.withColumn("_c", color.hex_to_rgb("color"))
    packed = color.pack_rgb(F.col("_c.r"), F.col("_c.g"), F.col("_c.b"))
    return rgb.groupBy(packed.alias("packed")).agg(F.count("*").alias("n_classes")).filter(
        (F.col("packed") == 0) | (F.col("n_classes") > 1))


def unknown_colours(px: DataFrame, palette: dict[int, int], top: int = 8) -> DataFrame:
    """Lowest unknown colours with their pixel counts, and how many more there are."""
    unknown = rgb_to_cmix(px, palette).filter(~F.col("known")).groupBy(
        color.pack_rgb("r", "g", "b").alias("packed")).agg(F.count("*").alias("n_px"))
    more = unknown.agg(F.greatest(F.lit(0), F.count("*") - top).alias("more"))
    shown = unknown.orderBy("packed").limit(top)
    return shown.select(F.format_string("#%06x", "packed").alias("color"), "n_px",
                        more.scalar().alias("more"))


def merge_index(px: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Merge overlapping index tiles: later tiles win, zero never erases."""
    fits = F.when(F.col("cmix").between(0, 255), F.col("cmix")).otherwise(
        F.raise_error(F.format_string("index %d does not fit a byte", F.col("cmix"))).cast("int"))
    packed = F.when(F.col("cmix") != 0, F.shiftleft(order.cast("long"), 8) + fits.cast("long"))
    return px.groupBy(*keys).agg(F.max(packed).alias("_p")).select(
        *keys, F.coalesce(F.col("_p").bitwiseAND(F.lit(255)), F.lit(0)).cast("int").alias("cmix"))


def histogram(index: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pixels and percentage per index value of the finished raster."""
    from pyspark.sql import Window as W
    by = by or []
    counted = index.groupBy(*by, "cmix").agg(F.count("*").alias("n_px"))
    total = F.sum("n_px").over(W.partitionBy(*by))  # at most 256 rows per group
    names = naming.literal_map({0: DEFAULT_NAME} | {i: c["name"] for i, c in enumerate(CLASSES, 1)})
    return counted.select(*by, "cmix", F.coalesce(names[F.col("cmix")], F.lit("?")).alias("name"), "n_px",
                          (F.col("n_px") * 100.0 / total).alias("pct"))


def fill_grid(index: DataFrame, height: int, width: int, raster: str) -> DataFrame:
    """The index over every cell of a raster's grid; cells without one are zero."""
    grid = index.sparkSession.range(height).select(F.col("id").cast("int").alias("row")).withColumn(
        "col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    held = index.select("row", "col", "cmix")
    return grid.join(held, ["row", "col"], "left").select(
        F.lit(raster).alias("raster_id"), "row", "col", F.coalesce("cmix", F.lit(0)).alias("cmix"))


def union_grid(tiles: DataFrame) -> DataFrame:
    """Grid over all tiles: union bounds, finest resolution; mixed systems fail."""
    agg = tiles.agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"),
                    F.max("north").alias("north"), F.min(F.abs("xres")).alias("xres"),
                    F.min(F.abs("yres")).alias("yres"), F.min("epsg").alias("_e0"), F.max("epsg").alias("_e1"))
    bad = F.when(F.col("_e0") != F.col("_e1"), F.raise_error(F.lit("tiles disagree on CRS")))
    flat = F.when(~((F.col("xres") > 0) & (F.col("yres") > 0) & (F.col("east") > F.col("west"))
                    & (F.col("north") > F.col("south"))), F.raise_error(F.lit("degenerate grid")))
    side = lambda a, b, res: F.greatest(F.lit(1), F.bround((F.col(b) - F.col(a)) / F.col(res)).cast("int"))
    return agg.select("west", "south", "east", "north", "xres", "yres", F.col("_e0").alias("epsg"),
                      F.coalesce(bad.cast("int"), flat.cast("int"), side("west", "east", "xres")).alias("width"),
                      side("south", "north", "yres").alias("height"))


def txr_lines(top, bottom, left, right) -> Column:
    """Lines of a bounds sidecar."""
    num = lambda label, v: F.format_string(f"{label}: %.12f", as_col(v))
    return F.array(*[F.lit(x) for x in TXR_HEADER], num("Top", top), num("Bottom", bottom), num("Left", left),
                   num("Right", right))


def txr_text(top, bottom, left, right) -> Column:
    return F.concat(F.array_join(txr_lines(top, bottom, left, right), "\n"), F.lit("\n"))


def txs_lines(images: DataFrame) -> DataFrame:
    """Lines of the batch-load script, numbered per image.

    ``images`` has ``pos, path, left, bottom, right, top, width, height``.
    """
    def fill(line: str) -> Column:
        out = F.lit(line.replace("{lib}", TXS_LIBRARY))
        values = {"path": F.col("path"), "width": F.col("width").cast("string"),
                  "height": F.col("height").cast("string")}
        values |= {k: F.format_string("%.12f", k) for k in ("top", "right", "left", "bottom")}
        for name, v in values.items():
            if "{" + name + "}" in line:
                out = F.replace(out, F.lit("{" + name + "}"), v)
        return out

    return images.select("pos", F.posexplode(F.array(*[fill(x) for x in TXS_LINES])).alias("line", "text"))


def material_block(index, name, argb, material) -> Column:
    """Lines of one composite material entry."""
    return F.array(
        F.format_string('  <Composite_Material index="%d">', as_col(index)),
        F.concat(F.lit("    <Name>"), as_col(name), F.lit("</Name>")),
        F.concat(F.lit("    <Color>"), as_col(argb), F.lit("</Color>")),
        F.lit("    <Primary_Substrate>"), F.lit("      <Thickness>1</Thickness>"), F.lit("      <Material>"),
        F.concat(F.lit("        <Name>"), as_col(material), F.lit("</Name>")),
        F.lit("        <Weight>100</Weight>"), F.lit("      </Material>"),
        F.lit("    </Primary_Substrate>"), F.lit("  </Composite_Material>"))


def material_table(classes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Composite material entries, one text block per class (``pos`` is one-based)."""
    text = F.array_join(material_block("pos", naming.composite_name("name"), naming.argb("color"), "name"), "\n")
    return classes.select(*(by or []), "pos", text.alias("text"))


def cell_material_table(classes: DataFrame) -> DataFrame:
    """Cell-wide table: the entries of all classes plus index zero."""
    shown = F.coalesce(F.when(F.col("composite_name") != "", F.col("composite_name")),
                       F.replace(F.col("name"), F.lit("BM_"), F.lit("")))
    rows = classes.select("pos", F.array_join(material_block("pos", shown, naming.argb("color"), "name"), "\n").alias("text"))
    zero = classes.sparkSession.range(1).select(F.lit(0).alias("pos"), F.array_join(material_block(
        F.lit(0), F.lit(DEFAULT_NAME), F.lit(DEFAULT_ARGB), F.lit(DEFAULT_MATERIAL)), "\n").alias("text"))
    return zero.unionByName(rows)


def palette_csv(classes: DataFrame) -> DataFrame:
    """Palette reference: id, material, type, colour and its three numbers."""
    rgb = color.hex_to_rgb("color")
    return classes.select(F.col("id").alias("class_id"), F.col("name").alias("material"),
                          naming.material_type("name").alias("material_type"), F.col("color").alias("hex_color"),
                          F.concat_ws(",", rgb["r"], rgb["g"], rgb["b"]).alias("final_rgb"))


def tile_index(tiles: DataFrame) -> DataFrame:
    """Where each written tile sits on the virtual raster; gaps read as zero."""
    return tiles.select(F.concat(naming.tile_name(F.col("raster_id"), "tile_row", "tile_col"), F.lit(".tif")).alias("path"),
                        "col0", "row0", "w", "h")


def colour_mask(base: DataFrame, mask: DataFrame, rgb: tuple[int, int, int], keys: list[str]) -> DataFrame:
    """A mask as an image: set pixels in the class colour, the rest black."""
    hit = mask.select(*keys).distinct().withColumn("_set", F.lit(True))
    out = base.select(*keys).join(hit, keys, "left")
    return out.select(*keys, *[F.when(F.col("_set"), F.lit(v)).otherwise(F.lit(0)).alias(n)
                               for v, n in zip(rgb, "rgb")])


# --- sinks ------------------------------------------------------------------

def write_tiles(tiles: DataFrame, path: str, overwrite: bool = False) -> None:
    """Tiles by raster; refuses to touch existing output unless told to.

    Spark's committer publishes the files only when the whole write succeeds.
    """
    spread = tiles.repartition("raster_id", "tile_row", "tile_col")
    spread.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("raster_id").parquet(path)


def write_lines(rows: DataFrame, path: str, order: list[str], overwrite: bool = False) -> None:
    """Text lines in a total order; part files sort by name, so no single task holds them all."""
    rows.orderBy(*order).select(F.col("text").alias("value")).write.mode(
        "overwrite" if overwrite else "errorifexists").text(path)


def failures(results: DataFrame) -> DataFrame:
    """Failed rasters with the last line of the message and the full text."""
    text = F.trim(F.col("error"))
    return results.filter(F.col("error").isNotNull()).select(
        "path", F.element_at(F.split(text, "\n"), -1).alias("summary"),
        F.concat(F.lit("===== "), F.col("path"), F.lit(" =====\n"), F.col("error"), F.lit("\n\n")).alias("detail"))


def batch_outcome(results: DataFrame) -> DataFrame:
    """Run status two ways: ok when any raster worked, exit code one when any failed."""
    ok, bad = F.count_if(F.col("error").isNull()), F.count_if(F.col("error").isNotNull())
    return results.agg(ok.alias("n_ok"), bad.alias("n_error"),
                       F.when(ok > 0, F.lit("ok")).otherwise(F.lit("error")).alias("status"),
                       F.when(bad > 0, F.lit(1)).otherwise(F.lit(0)).alias("exit_code"))
