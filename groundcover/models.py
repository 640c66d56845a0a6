"""The classifier as an estimator and a model of Spark's machine learning library: parameters, fit, save, load, transform."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from .constants import KMEANS_SEED
from .operators import tile_kmeans
from .plans import material_map


class _TileParams(Params):
    k = Param(Params._dummy(), "k", "number of clusters", TypeConverters.toInt)
    tile = Param(Params._dummy(), "tile", "side of the stored tiles", TypeConverters.toInt)
    nir = Param(Params._dummy(), "nir", "whether a near-infrared band is used", TypeConverters.toBoolean)
    smoothing = Param(Params._dummy(), "smoothing", "none or median_1, 2, 3, 5", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "seed of the start", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "rounds at most", TypeConverters.toInt)
    start = Param(Params._dummy(), "start", "fixed centres in units of the features, one after the other", TypeConverters.toListFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(k=6, tile=512, nir=False, smoothing="none", seed=KMEANS_SEED, maxIter=tile_kmeans.MAX_ROUNDS, start=[])

    def options(self) -> material_map.Options:
        return material_map.Options(tile=self.getOrDefault("tile"), nir=self.getOrDefault("nir"), smoothing=self.getOrDefault("smoothing"))


class TileKMeans(Estimator, _TileParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns one model from all covered pixels of stored tiles."""

    @keyword_only
    def __init__(self, *, k=None, tile=None, nir=None, smoothing=None, seed=None, maxIter=None, start=None):
        super().__init__()
        self._set(**{n: v for n, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> TileKMeansModel:
        opts, start = self.options(), self.getOrDefault("start")
        features = material_map.tile_form(opts)
        kept = tile_kmeans.kept_tiles(dataset, features, opts.tile)
        width = len(features.names)
        scaler, centres = tile_kmeans.fit(kept, features, self.getOrDefault("k"), self.getOrDefault("seed"),
                                          rounds=self.getOrDefault("maxIter"),
                                          start=[start[i:i + width] for i in range(0, len(start), width)] or None)
        model = TileKMeansModel(learnt=json.dumps({"features": features.names, "scaler": scaler, "centres": centres}))
        return self._copyValues(model)


class TileKMeansModel(Model, _TileParams, DefaultParamsReadable, DefaultParamsWritable):
    """Labels stored tiles: label tiles with 0 where nothing is covered and clusters from 1."""

    learnt = Param(Params._dummy(), "learnt", "scaler and centres as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, learnt=None):
        super().__init__()
        self._set(**{n: v for n, v in self._input_kwargs.items() if v is not None})

    @property
    def model(self) -> material_map.Model:
        got = json.loads(self.getOrDefault("learnt"))
        return material_map.Model(tuple(got["features"]), {n: tuple(v) for n, v in got["scaler"].items()},
                                  tuple(map(tuple, got["centres"])))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return material_map.score_tiles(dataset, self.model, self.options())
