"""Class table, palettes, priors and thresholds.

Everything in this module is a value that results depend on, not logic.
"""

from __future__ import annotations

# --- fixed values: the six material classes, in index order -----------------
CLASSES = [
    {
        "id": "class-1", "name": "BM_ASPHALT", "color": "#2D2D30",
        "composite_name": "ASPHALT", "source": "mask", "material_type": "ROAD_SURFACE",
        "sub_absorbs": ["BM_PAINT_ASPHALT"],
        "anchors": [[44, 44, 56], [52, 55, 72], [91, 91, 101], [91, 90, 96], [60, 63, 65]],
    },
    {
        "id": "class-2", "name": "BM_CONCRETE", "color": "#B4B4B4",
        "composite_name": "CONCRETE", "source": "mask", "material_type": "BUILDING",
        "sub_absorbs": ["BM_ROCK", "BM_METAL", "BM_METAL_STEEL"],
        "anchors": [[180, 180, 180], [130, 123, 115], [169, 171, 176], [112, 128, 144]],
    },
    {
        "id": "class-3", "name": "BM_VEGETATION", "color": "#228B22",
        "composite_name": "GENVEGETATION", "source": "kmeans", "material_type": "VEGETATION",
        "sub_absorbs": ["BM_FOLIAGE", "BM_LAND_GRASS", "BM_LAND_DRY_GRASS"],
        "anchors": [[0, 100, 0]],
    },
    {
        "id": "class-4", "name": "BM_WATER", "color": "#1C6BA0",
        "composite_name": "WATER", "source": "mask", "material_type": "WATER",
        "sub_absorbs": [],
        "anchors": [[28, 107, 160]],
    },
    {
        "id": "class-5", "name": "BM_SAND", "color": "#EDC9AF",
        "composite_name": "SAND", "source": "kmeans", "material_type": "SOIL_EARTH",
        "sub_absorbs": [],
        "anchors": [[230, 200, 130]],
    },
    {
        "id": "class-6", "name": "BM_SOIL", "color": "#654321",
        "composite_name": "SOIL", "source": "kmeans", "material_type": "SOIL_EARTH",
        "sub_absorbs": [],
        "anchors": [[85, 55, 30]],
    },
]

# --- fixed values: index 0 of the index raster ------------------------------
DEFAULT_CMIX = 0
DEFAULT_NAME = "DEFAULT"
DEFAULT_MATERIAL = "BM_SOIL"
DEFAULT_ARGB = "#ff000000"

# --- fixed values: expected share of each material --------------------------
PRIOR_URBAN = {
    "BM_CONCRETE": 0.28, "BM_VEGETATION": 0.21, "BM_ASPHALT": 0.20,
    "BM_SOIL": 0.15, "BM_SAND": 0.04, "BM_WATER": 0.04,
}
PRIOR_OPEN = {
    "BM_VEGETATION": 0.39, "BM_SOIL": 0.25, "BM_CONCRETE": 0.12,
    "BM_SAND": 0.08, "BM_WATER": 0.05, "BM_ASPHALT": 0.04,
}
PRIOR_UNLISTED = 0.05

# --- fixed values: cost terms of the cluster naming -------------------------
PRIOR_COST = 280.0
SHAPE_COST = 30000.0
BRIGHT_SUM = 420

# --- fixed values: near-black rule ------------------------------------------
NEAR_BLACK_MEAN = 8.0

# --- fixed values: training sample bounds -----------------------------------
TRAIN_MAX = 100_000
TRAIN_LOW = 20_000
TRAIN_HIGH = 120_000
PER_RASTER_MIN = 4_096
KMEANS_SEED = 42

# --- fixed values: sampling grid for tiled training -------------------------
SAMPLE_GRID = 16
SAMPLE_WINDOW = 256
SAMPLE_EXTRA = 64
SAMPLE_MIN_PER_WINDOW = 32

# --- fixed values: scene prior zones ----------------------------------------
ZONE_RADIUS_M = 90.0
ZONE_MIN_PX = 20
ZONE_MAX_PX = 140
ZONE_COUNT = 16

# --- fixed values: mosaic grid ----------------------------------------------
MOSAIC_TILE_PX = 2_048
OUTPUT_DIR_SUFFIXES = ("_mosaic_tiles", "_classified_tiles", "_with_vectors_tiles")
FOOTPRINT_CACHE_NAME = ".mc_footprint_cache.json"
LAYER_SUFFIXES = ("tif", "tiff", "jp2")

# --- fixed values: file suffixes --------------------------------------------
RASTER_SUFFIXES = (".tif", ".tiff", ".jpg", ".jpeg", ".png", ".img", ".bmp", ".jp2", ".ecw", ".sid")
BATCH_SUFFIXES = (".tif", ".tiff", ".jpg", ".jpeg")

# --- fixed values: geographic maths -----------------------------------------
MERCATOR_HALF = 20037508.34
METRES_PER_DEGREE = 111_320.0

# --- fixed values: mask veto ------------------------------------------------
VETO_THRESHOLDS = {
    "shapefile": 1.01, "raster": 1.01, "sam3": 1.01, "sam3_failed": 1.01,
    "sam3_empty": 1.01, "skipped": 1.01, "disabled": 1.01,
}
VETO_DEFAULT = 0.55
VETO_RGB_SQ = 4500
INCOMPATIBLE = {
    "BM_ASPHALT": ("BM_VEGETATION", "BM_WATER"),
    "BM_CONCRETE": ("BM_VEGETATION", "BM_WATER"),
}

# --- fixed values: overlay colour candidates, in order of preference --------
OVERLAY_CANDIDATES = [
    (255, 255, 0), (255, 0, 255), (0, 255, 255), (255, 128, 0), (255, 255, 255),
    (0, 255, 128), (255, 0, 128), (0, 128, 255), (128, 0, 255), (200, 250, 50),
]
OVERLAY_FALLBACK = (255, 255, 0)
OVERLAY_MIN_DISTANCE = 80.0

# --- fixed values: colours of custom classes, by position -------------------
CUSTOM_PALETTE = [
    "#FF0000", "#00FF00", "#0000FF", "#FFFF00", "#FF00FF",
    "#00FFFF", "#FF8000", "#8000FF", "#00FF80", "#FF0080",
    "#0080FF", "#80FF00", "#FF4500", "#1E90FF", "#32CD32",
    "#FF1493", "#FFD700", "#4B0082", "#00CED1", "#FF6347",
    "#9400D3", "#00FA9A", "#FF69B4", "#ADFF2F", "#DC143C",
    "#00BFFF", "#7FFF00", "#20B2AA", "#FF7F50", "#6A5ACD",
]
GOLDEN_RATIO = 0.618033988749895

# --- fixed values: feature extraction set-up --------------------------------
FEATURE_CONFIGS = {
    "roads": [{"suffix": "roads", "color": (45, 45, 48), "prompt": "road", "threshold": 0.20}],
    "buildings": [{"suffix": "buildings", "color": (180, 180, 180), "prompt": "building",
                   "threshold": 0.15, "detector": "buildings"}],
    "trees": [{"suffix": "trees", "color": (34, 139, 34),
               "prompt": "tree, trees, forest, woodland, grove", "detector": "trees"}],
    "fields": [
        {"suffix": "fields_grass", "color": (34, 139, 34),
         "prompt": "grass, lawn, field, meadow, pasture", "detector": "fields"},
        {"suffix": "fields_agriculture", "color": (34, 139, 34),
         "prompt": "crop, farmland, agriculture, cultivated field", "detector": "fields"},
    ],
    "water": [
        {"suffix": "water_bodies", "color": (28, 107, 160), "threshold": 0.20,
         "prompt": "water, lake, pond, reservoir, pool", "detector": "water"},
        {"suffix": "water_channels", "color": (28, 107, 160), "threshold": 0.20,
         "prompt": "river, stream, canal, waterway, channel", "detector": "water"},
        {"suffix": "water_other", "color": (28, 107, 160), "threshold": 0.20,
         "prompt": "sea, ocean, fish pond, swimming pool", "detector": "water"},
    ],
}
PREFILTER_SHARE = {"roads": 0.03, "buildings": 0.01, "trees": 0.03, "fields": 0.05, "water": 0.005}
PREFILTER_SIDE = 256
PREFILTER_MIN_VALID = 100

# --- fixed values: lines of the batch-load script; {name} is filled per image
TXS_LIBRARY = "Source Data Library;Geospecific Imagery;Year-Round"
TXS_LINES = [
    'Delete "{lib};{path} (backup)"',
    'Rename "{lib};{path}" "{path} (backup)"',
    'Create "GeoSpecific" "{lib}" "{path}"',
    'SetEnv thisRecord "{lib};{path}"',
    'Set $thisRecord "Zero Y" ""',
    'Set $thisRecord "Zero X" ""',
    'Set $thisRecord "Use 4th Channel as Alpha" "no"',
    'Set $thisRecord "Transparency" ""',
    'Set $thisRecord "Timestamp" ""',
    'Set $thisRecord "Origin Y" ""',
    'Set $thisRecord "Origin X" ""',
    'Set $thisRecord "Number of Texels Y" {height}',
    'Set $thisRecord "Number of Texels X" {width}',
    'Set $thisRecord "Notes" ""',
    'Set $thisRecord "Misc3" ""',
    'Set $thisRecord "Misc2" ""',
    'Set $thisRecord "Misc1" ""',
    'Set $thisRecord "Meters per Texels Y" ""',
    'Set $thisRecord "Meters per Texels X" ""',
    'Set $thisRecord "MaterialClassification" ""',
    'Set $thisRecord "Map Selection" ""',
    'Set $thisRecord "Map Model" "Geographic"',
    'Set $thisRecord "Map Datum" "WGS84"',
    'Set $thisRecord "Local Top" {top}',
    'Set $thisRecord "Local Right" {right}',
    'Set $thisRecord "Local Left" {left}',
    'Set $thisRecord "Local Bottom" {bottom}',
    'Set $thisRecord "Gamma" 1.800000000000',
    'Set $thisRecord "File Type" ""',
    'Set $thisRecord "File Name" "{path}"',
    'Set $thisRecord "Enter Date" ""',
    'Set $thisRecord "Data Interpretation" "GeoSpecific Format"',
    'Set $thisRecord "Custom Definition 2" ""',
    'Set $thisRecord "Custom Definition" ""',
    'Set $thisRecord "Conv_ Usage" "use default"',
    'Set $thisRecord "Conv_ Selection" ""',
    'Set $thisRecord "Conv_ Family" ""',
    'Set $thisRecord "Auto Load" ""',
]

# --- fixed values: lines of a bounds sidecar --------------------------------
TXR_HEADER = ["csm=Geographic", "datumId=4326", "dcType=NONE", "dcSelectorId=0", "EndMapTokens"]


def hex_to_rgb(color: str) -> tuple[int, int, int]:
    digits = color.lstrip("#")
    return int(digits[0:2], 16), int(digits[2:4], 16), int(digits[4:6], 16)


CLASS_RGB = {c["name"]: hex_to_rgb(c["color"]) for c in CLASSES}
LEGACY_PARENT = {old: c["name"] for c in CLASSES for old in c["sub_absorbs"]}
