"""Raster-shaped views over the given tables, for Spark and, as text, for the check engine.

The formulas are plain integer arithmetic so both engines derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_BLOCK = "cast((floor(row/5)+2*floor(col/25))%6 as int)"


def _noise(k: int) -> str:
    return f"cast((event_id*7+user_id*13+{k})%13 as int)-6"


def _base(values: list[int]) -> str:
    # three digits per block: one look at the block, where a CASE would test it again and again
    return f"cast(substr('{''.join(f'{v:03d}' for v in values)}', blk*3+1, 3) as int)"


_R, _G, _B = [40, 232, 105, 178, 28, 2], [130, 200, 70, 178, 107, 2], [45, 176, 36, 180, 160, 2]

_PIXEL_STEPS = [
    ("SELECT event_id, user_id, cast(floor(event_id/100) as int) AS row, cast(event_id%100 as int) AS col FROM {src}"),
    (f"SELECT *, {_BLOCK} AS blk FROM {{src}}"),
    (f"SELECT row, col, blk, greatest(0, least(255, {_base(_R)} + {_noise(0)})) AS r, "
     f"greatest(0, least(255, {_base(_G)} + {_noise(5)})) AS g, "
     f"greatest(0, least(255, {_base(_B)} + {_noise(10)})) AS b FROM {{src}}"),
    ("SELECT 'r0' AS raster_id, row, col, blk, r, g, b, "
     "greatest(0, least(255, g + case blk when 0 then 90 when 4 then -80 else 10 end)) AS nir FROM {src}"),
]


def _nest(steps: list[str], source: str) -> str:
    text = source
    for i, step in enumerate(steps):
        text = step.replace("{src}", text if i == 0 else f"({text}) t{i}")
    return text


# name -> (needed views, text); {table} stands for a given table
SQL: dict[str, tuple[list[str], str]] = {
    "pixel": ([], _nest(_PIXEL_STEPS, "{events}")),
    "scene": (["pixel"], "SELECT concat('s', cast(cast(floor(row/20) as int) as string)) AS raster_id, "
                         "cast(row%20 as int) AS row, col, blk, r, g, b, nir FROM {pixel}"),
    "footprint": ([], "SELECT path, priority, west, south, west + ext AS east, south + ext AS north, px FROM ("
                      "SELECT s_name AS path, cast(s_suppkey%3 as int)+1 AS priority, "
                      "cast(35 + (s_suppkey%10)*0.12e0 - 0.1e0 as double) AS west, "
                      "cast(33 + (cast(floor(s_suppkey/10) as int)%10)*0.12e0 - 0.1e0 as double) AS south, "
                      "cast(0.05e0 + (s_nationkey%5)*0.03e0 as double) AS ext, "
                      "cast(0.0005e0*(1+s_nationkey%4) as double) AS px FROM {supplier}) f"),
    "raster": ([], "SELECT concat('t', cast(s_suppkey as string)) AS raster_id, s_name AS path, "
                   "cast(s_suppkey%3 as int)+1 AS priority, case when s_suppkey%4=0 then 3857 else 4326 end AS epsg, "
                   "cast(100+(s_suppkey*37)%900 as int) AS width, cast(100+(s_suppkey*53)%700 as int) AS height, 3 AS n_bands, "
                   "case when s_suppkey%4=0 then cast(3900000+(s_suppkey%10)*13000 as double) else cast(35+(s_suppkey%10)*0.12e0 as double) end AS west, "
                   "case when s_suppkey%4=0 then cast(4000000+(s_suppkey%7)*15000 as double) else cast(33+(s_suppkey%9)*0.12e0 as double) end AS north, "
                   "case when s_suppkey%4=0 then cast(20+s_nationkey%5 as double) else cast(0.0002e0*(1+s_nationkey%4) as double) end AS xres, "
                   "case when s_suppkey%4=0 then cast(20+s_nationkey%3 as double) else cast(0.0002e0*(1+s_nationkey%3) as double) end AS yres "
                   "FROM {supplier}"),
    "listing": ([], "SELECT page_id, concat('/data/', case page_id%5 when 0 then 'a' when 1 then 'run_mosaic_tiles' "
                    "when 2 then 'b/c' when 3 then 'run_classified_tiles' else 'run_with_vectors_tiles/d' end, '/img', "
                    "cast(page_id as string), case page_id%9 when 0 then '.tif' when 1 then '.TIFF' when 2 then '.jpeg' "
                    "when 3 then '.txt' when 4 then '.jp2' when 5 then '.PNG' when 6 then '.tif.aux' when 7 then '' else '.Tif' end) "
                    "AS path FROM {pages}"),
    "file_stat": ([], "SELECT o_orderkey AS path, cast(round(o_totalprice*100) as bigint) AS size, o_orderdate AS mtime FROM {orders}"),
    "cached_stat": (["file_stat"], "SELECT path, size + case when path%7=0 then 1 else 0 end AS size, mtime FROM {file_stat} WHERE path%5<>0"),
    "rect": ([], "SELECT concat('f', cast(c_custkey as string)) AS feature_id, c_mktsegment AS layer, c_custkey AS fid, "
                 "cast(c_custkey%90 as int) AS x, cast(c_custkey%80 as int) AS y, "
                 "cast(1+c_nationkey%5 as int) AS w, cast(1+c_nationkey%3 as int) AS h FROM {customer}"),
    "road": ([], "SELECT p_partkey AS fid, cast(p_size%7 as int)-2 AS width_val, p_type AS type_val, "
                 "cast(p_partkey%90 as int) AS x, cast(p_partkey%97 as int) AS y FROM {part}"),
    "mask": (["pixel"], "SELECT raster_id, 'roads' AS feature, row, col FROM {pixel} WHERE row%20 in (9,10) "
                        "UNION ALL SELECT raster_id, 'buildings', row, col FROM {pixel} WHERE row%25<6 and col%20<6 "
                        "UNION ALL SELECT raster_id, 'water', row, col FROM {pixel} WHERE blk=4"),
    "source_pixel": (["pixel"], " UNION ALL ".join(
        f"SELECT 'p{p}' AS path, {p} AS priority, row+{p} AS row, col, r, g, b FROM {{pixel}}"
        + (" WHERE NOT (col between 10 and 30)" if p == 1 else "") for p in (1, 2, 3))),
    "part_class": ([], "SELECT cast(p_partkey as int) AS pos, concat('class-', cast(p_partkey as string)) AS id, "
                       "case p_partkey%9 when 0 then 'BM_ASPHALT' when 1 then 'BM_CONCRETE' when 2 then 'BM_VEGETATION' "
                       "when 3 then 'BM_WATER' when 4 then 'BM_SAND' when 5 then 'BM_SOIL' when 6 then 'BM_ROCK' "
                       "when 7 then 'BM_MUD' else 'OTHER_THING' end AS name, "
                       "case p_partkey%7 when 0 then '#12' when 1 then 'bad' when 2 then '' else "
                       "concat('#', substr(md5(cast(p_partkey as string)), 1, 6)) end AS color FROM {part}"),
}

ALL_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
              "benchmark labels conversations").split()


def needed(*names: str) -> list[str]:
    """Views in an order that puts each after the ones it needs."""
    out: list[str] = []
    for n in names:
        for d in needed(*SQL[n][0]):
            if d not in out:
                out.append(d)
        if n not in out:
            out.append(n)
    return out


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A view as a DataFrame, built on the tables it reads."""
    deps, text = SQL[name]
    args = {d: view(spark, sf, d) for d in deps}
    args |= {t: table(spark, sf, t) for t in ALL_TABLES if "{" + t + "}" in text}
    return spark.sql(text, **args)


def with_views(body: str, *names: str) -> str:
    """Check-engine text with the views as common table expressions."""
    order = needed(*names)
    if not order:
        return body
    parts = []
    for n in order:
        text = SQL[n][1]
        for t in [*ALL_TABLES, *SQL]:
            text = text.replace("{" + t + "}", t)
        parts.append(f"{n} AS ({text.replace('as string', 'as varchar')})")
    if body.lstrip().upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body.lstrip()[len("WITH RECURSIVE"):]
    if body.lstrip().upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + body.lstrip()[len("WITH "):]
    return "WITH " + ", ".join(parts) + " " + body
