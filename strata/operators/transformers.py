"""Co-registration and normalisation as estimators of pyspark.ml: fitted once, kept with what they learned, used on other surveys."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.features import norm_params, normalised
from strata.operators.grid import Grid, common_grid, locate, registered

PLACE = ("xmin", "xmax", "ymin", "ymax", "nx", "ny")


class _Kept(Params):
    """What a model has learned, as JSON in a parameter, so that the usual writers save it."""

    learned = Param(Params._dummy(), "learned", "what fit() found, as JSON", TypeConverters.toString)

    def _known(self):
        if not self.isSet(self.learned):
            raise RuntimeError(f"{type(self).__name__} knows nothing yet: it comes from fit() or load()")
        return json.loads(self.getOrDefault(self.learned))


class RobustNormalizer(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator over long features (feature, val): percentiles, median and interquartile range of each feature.

    clip: per cent cut off at either end. Features with fewer than ten values are taken as they are (0 to 1, so clipped).
    """

    clip = Param(Params._dummy(), "clip", "per cent cut off at either end", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, clip: float = 2.0):
        super().__init__()
        self._setDefault(clip=2.0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> RobustNormalizerModel:
        rows = norm_params(dataset.select("feature", "val"), self.getOrDefault(self.clip)).orderBy("feature").collect()  # a row a feature
        return self._copyValues(RobustNormalizerModel()._set(learned=json.dumps([list(r) for r in rows])))


class RobustNormalizerModel(Model, _Kept, DefaultParamsReadable, DefaultParamsWritable):
    """Clips, centres and scales each feature as it was fitted, and keeps it in -5 to 5. Features that weren't fitted go."""

    clip = RobustNormalizer.clip

    def parameters(self, dataset: DataFrame) -> DataFrame:
        """feature, p_low, p_high, median, iqr."""
        return dataset.sparkSession.createDataFrame([tuple(r) for r in self._known()], "feature string, p_low double, p_high double, median double, iqr double")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return normalised(dataset, self.parameters(dataset))


class CoRegistration(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator of the common grid of layers. The dataset is cells with their layer's extent and size (see described()).

    nx, ny: nodes of the grid, 0 for the finest layer's; how: "intersection" or "union"; method: "linear" or "nearest".
    """

    nx = Param(Params._dummy(), "nx", "columns of the grid, 0 for the most of a layer", TypeConverters.toInt)
    ny = Param(Params._dummy(), "ny", "rows of the grid, 0 for the most of a layer", TypeConverters.toInt)
    how = Param(Params._dummy(), "how", "intersection or union", TypeConverters.toString)
    method = Param(Params._dummy(), "method", "linear or nearest", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, nx: int = 0, ny: int = 0, how: str = "intersection", method: str = "linear"):
        super().__init__()
        self._setDefault(nx=0, ny=0, how="intersection", method="linear")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> CoRegistrationModel:
        get = lambda p: self.getOrDefault(p)
        grid = common_grid(layers_of(dataset), get(self.nx) or None, get(self.ny) or None, get(self.how))
        return self._copyValues(CoRegistrationModel.of(grid))


class CoRegistrationModel(Model, _Kept, DefaultParamsReadable, DefaultParamsWritable):
    """Brings the cells of any layers onto the fitted grid; points are located on it by locate()."""

    nx, ny, how, method = CoRegistration.nx, CoRegistration.ny, CoRegistration.how, CoRegistration.method

    @classmethod
    def of(cls, grid: Grid) -> CoRegistrationModel:
        """The model of a grid that is known already."""
        return cls()._set(learned=json.dumps(list(grid)))

    @property
    def grid(self) -> Grid:
        return Grid(*self._known())

    def locate(self, points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
        return locate(points, self.grid, x, y)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return registered(dataset.select("layer", "row", "col", "z"), layers_of(dataset), self.grid, self.getOrDefault(self.method) if self.isDefined(self.method) else "linear")


def described(cells: DataFrame, layers: DataFrame) -> DataFrame:
    """cells with the extent and size of their layers. Layers are few: a row a file."""
    return cells.join(F.broadcast(layers.select("layer", *PLACE)), "layer")


def layers_of(dataset: DataFrame) -> DataFrame:
    """A row a layer: its extent and size."""
    return dataset.groupBy("layer").agg(*[F.first(c).alias(c) for c in PLACE])
