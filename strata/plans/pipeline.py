"""The survey pipeline: layers and wells in, ranked targets out."""

from __future__ import annotations

import warnings
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.features import extract, feature_names, weighted, wide
from strata.operators.grid import Grid, common_grid, locate, registered
from strata.operators.metrics import recall_at_k
from strata.operators.models import Prospect
from strata.operators.ranks import percentiles
from strata.operators.sampling import assemble
from strata.operators.storage import stored
from strata.operators.targets import top_targets
from strata.operators.transformers import CoRegistrationModel, RobustNormalizer, RobustNormalizerModel
from strata.operators.unsupervised import unit_maps
from strata.sources import synthetic
from strata.sources.grids import array_layer, load_layer, read_wells
from strata.sources.sinks import report_lines, stamped, write_targets, write_text

WELL_COLUMNS = {"x", "y", "label"}


class Result(NamedTuple):
    """Of one target type: mode, maps (row, col, prob, uncertainty and more), ranked targets, the model if one was trained."""

    mode: str
    maps: DataFrame
    targets: DataFrame
    model: Prospect | None


class SurveyPipeline:
    """Collects layers and wells; run() does the rest. A later layer or well set of the same name replaces the earlier."""

    def __init__(self, spark: SparkSession, project: str = "survey"):
        self.spark, self.project = spark, project
        self.layers: dict[str, tuple[DataFrame, DataFrame]] = {}
        self.wells: dict[str, DataFrame] = {}
        self.grid: Grid | None = None
        #: Once features are made: the fitted transformers, which can be saved and used on another survey.
        self.registration: CoRegistrationModel | None = None
        self.normalizer: RobustNormalizerModel | None = None
        self.results: dict[str, Result] = {}

    def add_layer(self, path: str, name: str | None = None, **how) -> SurveyPipeline:
        """A layer from a file; one that can't be read is skipped with a warning."""
        try:
            cells, rows = load_layer(self.spark, path, name, **how)
            self.layers[rows.first().layer] = (cells, rows)
        except Exception as e:
            warnings.warn(f"{path} is skipped: {type(e).__name__}: {str(e)[:200]}", stacklevel=2)
        return self

    def add_layer_array(self, grid, x, y, name: str) -> SurveyPipeline:
        self.layers[name] = array_layer(self.spark, grid, x, y, name)
        return self

    def add_layer_cells(self, cells: DataFrame, layers: DataFrame, name: str) -> SurveyPipeline:
        self.layers[name] = (cells, layers)
        return self

    def add_wells(self, path: str, target_type: str = "generic", **how) -> SurveyPipeline:
        """Wells from a file; the type is the argument's, whatever the file says. Unreadable files give a warning."""
        try:
            self.wells[target_type] = read_wells(self.spark, path, **how)
        except Exception as e:
            warnings.warn(f"{path} is skipped: {type(e).__name__}: {str(e)[:200]}", stacklevel=2)
        return self

    def add_wells_frame(self, wells: pd.DataFrame | DataFrame, target_type: str = "generic") -> SurveyPipeline:
        if missing := WELL_COLUMNS - set(wells.columns):
            raise ValueError(f"wells lack {sorted(missing)}")
        self.wells[target_type] = wells if isinstance(wells, DataFrame) else self.spark.createDataFrame(wells)
        return self

    def features(self, nx: int | None = 200, ny: int | None = 200, how: str = "intersection", window: int = 5) -> tuple[DataFrame, list[str]]:
        """(long normalised features, names): registered, filtered and normalised once, and kept for all target types."""
        if not self.layers:
            raise ValueError("there are no layers")
        keep = ["layer", "nx", "ny", "xmin", "xmax", "ymin", "ymax"]
        cells = rows = None
        for c, r in self.layers.values():
            cells = c if cells is None else cells.unionByName(c)
            rows = r.select(*keep) if rows is None else rows.unionByName(r.select(*keep))
        self.grid = common_grid(rows, nx, ny, how)
        self.registration = CoRegistrationModel.of(self.grid)
        common = stored(registered(cells, rows, self.grid), "registered")
        there = {r.layer for r in common.select("layer").distinct().collect()}
        names = [n for n in self.layers if n in there]
        if not names:
            raise RuntimeError("no layer could be registered")
        long = stored(extract(common, names, window, self.grid.dx, self.grid.dy), "features")
        self.normalizer = RobustNormalizer().fit(long)
        return stored(self.normalizer.transform(long), "normalised"), feature_names(names)

    def run(self, target_types: list[str] | None = None, target_nx: int = 200, target_ny: int = 200, common_extent: str = "intersection", window_size: int = 5, n_targets: int = 15, min_prob: float | None = 0.35, cv_folds: int = 5, output_dir: str | None = None, **training) -> dict[str, Result]:
        """Results by type. A type without wells (its own or generic ones), with too few samples or whose training fails gets
        the unsupervised maps; min_prob None takes the learned threshold, or one half without a model."""
        long, names = self.features(target_nx, target_ny, common_extent, window_size)
        for kind in target_types or list(self.wells) or ["generic"]:
            found = self.wells.get(kind, self.wells.get("generic"))
            model = self._trained(long, names, found, kind, cv_folds, training) if found is not None else None
            if model:
                maps, mode = stored(model.predict(wide(weighted(long, model.target_type), names)), "maps"), "supervised"
            else:
                maps, mode = stored(unit_maps(long), "maps"), "unsupervised"
            limit = (model.threshold if model else 0.5) if min_prob is None else min_prob
            self.results[kind] = Result(mode, maps, stored(top_targets(maps.select("row", "col", "prob", "uncertainty"), self.grid, kind, n_targets, limit), "targets"), model)
        if output_dir:
            self.report(output_dir)
        return self.results

    def _trained(self, long, names, wells, kind, cv_folds, training) -> Prospect | None:
        try:
            model = Prospect(kind, **training)
            features = wide(weighted(long, model.target_type), names)
            samples = stored(assemble(features, locate(wells.where("label in (0, 1)"), self.grid), self.grid), "samples")
            return model.train(samples, names, cv_folds)
        except Exception as e:
            warnings.warn(f"{kind}: no model ({type(e).__name__}: {str(e)[:200]})", stacklevel=3)
            return None

    def report(self, folder: str, when=None) -> None:
        """Target table and text report, both named by the time."""
        write_targets([r.targets for r in self.results.values()], f"{folder}/{stamped('targets', when)}")
        lines = [self.project]
        for kind, r in self.results.items():
            lines += report_lines(r.targets, r.model.metrics if r.model else [], kind)
        write_text(self.spark, lines, f"{folder}/{stamped('report', when)}")

    @classmethod
    def demo(cls, spark: SparkSession, nx: int = 120, ny: int = 120, target_types=("mineral", "groundwater"), **how) -> SurveyPipeline:
        """The demonstration survey with its wells, run."""
        grid, made, points = synthetic.demo(nx, ny)
        pipe = cls(spark, "demo")
        for name, z in made.items():
            pipe.add_layer_cells(synthetic.cells_of(spark, {name: z}, grid), synthetic.layer_rows(spark, [name], grid), name)
        for kind in target_types:
            pipe.add_wells_frame(pd.DataFrame(points[kind], columns=["x", "y", "label"]), kind)
        pipe.run(list(target_types), nx, ny, **({"n_targets": 12, "min_prob": 0.3, "cv_folds": 3} | how))
        return pipe

    @classmethod
    def realistic(cls, spark: SparkSession, name: str = "porphyry_copper", nx: int = 400, ny: int = 400, n_wells: int = 80, ratio: float = 15.0, seed: int = 42, vary: bool = True, **how) -> tuple[SurveyPipeline, DataFrame]:
        """A synthetic scenario with noise and gaps, each layer on a grid of its own (unless vary is off), run with the learned
        threshold; and its recall and precision at 10."""
        grid = synthetic.survey_grid(nx, ny)
        made, zones = synthetic.scenario(name, grid, seed)
        cells, pipe = stored(synthetic.with_noise(synthetic.cells_of(spark, made, grid), grid, seed), "synthetic"), cls(spark, name)
        grids = synthetic.own_grids(list(made), grid, seed=seed) if vary else dict.fromkeys(made, grid)
        if vary:
            cells = stored(synthetic.on_own_grids(cells, grid, grids), "own")
        for layer in made:
            pipe.add_layer_cells(cells.where(F.col("layer") == layer), synthetic.layer_rows(spark, [layer], grids[layer]), layer)
        kind = synthetic.TARGET_TYPES[name]
        pipe.add_wells_frame(synthetic.wells(spark, zones, grid, name, ratio, n_wells, seed=seed), kind)
        found = pipe.run([kind], nx, ny, min_prob=None, **how)
        return pipe, recall_at_k(found[kind].targets, synthetic.zone_rows(spark, zones))


def layer_stats(cells: DataFrame) -> DataFrame:
    """layer, colour limits p2 and p98, missing percent: what a chart of the layers needs."""
    limits = percentiles(cells, "z", [0.02, 0.98], "layer").select("layer", F.col("p")[0].alias("p2"), F.col("p")[1].alias("p98"))
    return limits.join(cells.groupBy("layer").agg((100.0 * F.count_if(F.col("z").isNull()) / F.count("*")).alias("missing_percent")), "layer")


#: Contour levels of probability.
LEVELS = (0.4, 0.6, 0.75, 0.88)


def contour_class(maps: DataFrame) -> DataFrame:
    """maps with level: how many contour levels prob reaches."""
    reached = [F.when(F.col("prob") >= v, 1).otherwise(0) for v in LEVELS]
    return maps.withColumn("level", reached[0] + reached[1] + reached[2] + reached[3])
