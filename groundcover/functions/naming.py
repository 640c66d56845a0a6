"""File names, sidecar text and small lookups."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CLASSES
from .color import as_col


def tile_name(stem, row, col) -> Column:
    return F.format_string("%s_tile_r%d_c%d", as_col(stem), as_col(row), as_col(col))


def file_stem(path) -> Column:
    return F.regexp_replace(F.element_at(F.split(as_col(path), "/"), -1), r"(?<=.)\.[^.]+$", "")


def file_suffix(path) -> Column:
    """Lower-case suffix with its dot; empty without one."""
    return F.lower(F.regexp_extract(as_col(path), r"[^/](\.[^./]+)$", 1))


def output_path(path, out_dir, suffix: str) -> Column:
    """``<out_dir>/<stem><suffix>.tif``; next to the input when no folder is given."""
    p = as_col(path)
    parent = F.regexp_replace(p, r"/[^/]*$", "")
    folder = F.coalesce(as_col(out_dir), parent)
    return F.concat(folder, F.lit("/"), file_stem(p), F.lit(f"{suffix}.tif"))


def argb(color) -> Column:
    c = as_col(color)
    ok = c.startswith("#") & (F.length(c) == 7)
    return F.when(ok, F.concat(F.lit("#ff"), F.lower(F.substring(c, 2, 6)))).otherwise(F.lit("#ff000000"))


def literal_map(pairs: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pairs.items()))


def material_type(name) -> Column:
    return F.coalesce(literal_map({c["name"]: c["material_type"] for c in CLASSES})[as_col(name)],
                      F.lit("OTHER"))


def composite_name(name) -> Column:
    """Display name of a known class, else the name without its prefix."""
    known = literal_map({c["name"]: c["composite_name"] for c in CLASSES})
    return F.coalesce(known[as_col(name)], F.replace(as_col(name), F.lit("BM_"), F.lit("")))


def class_source(source, name) -> Column:
    """A class's own source field, else the built-in one, else clustering."""
    known = literal_map({c["name"]: c["source"] for c in CLASSES})
    own = F.when(as_col(source) != "", as_col(source))
    return F.coalesce(own, known[as_col(name)], F.lit("kmeans"))


def six_class_route(names, mask_models_enabled) -> Column:
    """True when a request lists exactly the six class names with mask models on."""
    known = F.array(*[F.lit(c["name"]) for c in CLASSES])
    n = as_col(names)
    return (as_col(mask_models_enabled) & (F.size(n) == len(CLASSES))
            & (F.size(F.array_except(n, known)) == 0))


def as_positive(value) -> Column:
    """A number above zero, else null; NaN and text count as absent."""
    v = as_col(value).try_cast("double")
    return F.when((v > 0) & ~F.isnan(v), v)


def road_width(width_val, type_val, main_key: str, main_w: float, side_key: str, side_w: float,
               fallback: float) -> Column:
    """Own width, else the width of the matching road type, else the fallback."""
    kind = F.lower(F.trim(as_col(type_val)))
    tiers = [as_positive(width_val)]
    for key, width in ((main_key, main_w), (side_key, side_w)):
        wanted = key.strip().lower() if key else ""
        if wanted and width and width > 0:
            tiers.append(F.when(kind == wanted, F.lit(float(width))))
    return F.coalesce(*tiers, F.lit(float(fallback)))
