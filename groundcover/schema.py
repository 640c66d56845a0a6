"""Table layouts shared by the operators."""

# Storage form: one block of a raster, unsigned bytes, band after band.
TILE = ("raster_id string, tile_row int, tile_col int, row0 int, col0 int, h int, w int, "
        "raster_h int, raster_w int, n_bands int, data binary")
TILE_KEYS = ["raster_id", "tile_row", "tile_col"]

# Relational form: one row per pixel.
PIXEL = "raster_id string, row int, col int, r int, g int, b int, nir int"
PIXEL_KEYS = ["raster_id", "row", "col"]

RASTER = ("raster_id string, path string, priority int, epsg int, width int, height int, n_bands int, "
          "west double, north double, xres double, yres double, size bigint, mtime_ns bigint")

FEATURE = ("layer string, feature_id string, kind string, "
           "rings array<array<struct<x:double,y:double>>>, "
           "minx double, miny double, maxx double, maxy double, attrs map<string,string>")

CLASS_DIM = ("cmix int, id string, name string, color string, r int, g int, b int, composite_name string, "
             "source string, material_type string, anchors array<array<int>>, sub_absorbs array<string>")
