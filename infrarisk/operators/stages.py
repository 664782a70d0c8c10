"""M1, M2 and S9 as pipeline stages that save and load with ``PipelineModel``.

``MedianScaler`` learns exact medians, means and population deviations (A1, A2); its model imputes and scales.
``LinearProbability`` applies one target's weights; a city that it does not know has the weight 0 (a zero slot of the one-hot).
The stages carry their parameters on the driver, so the city list is bounded (``MOST_CITIES``); larger models stay
tables (``sources/io.save_model``, ``infer.predict``).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import add_all, clip
from . import infer, stats

MOST_CITIES = 100_000


class MedianScalerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Output column k: (input k, missing ones the median, minus the mean) / deviation; a deviation of 0 counts as 1."""

    medians = Param(Params._dummy(), "medians", "one median an input column", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "one mean an input column", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "one population deviation an input column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, medians=None, means=None, stds=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def preprocessor(self) -> stats.Preprocessor:
        names = self.getInputCols()
        medians, means, stds = (dict(zip(names, self.getOrDefault(p), strict=True)) for p in (self.medians, self.means, self.stds))
        return stats.Preprocessor(list(names), medians, means, stds)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        pre = self.preprocessor()
        return dataset.withColumns({out: infer.standardized(pre, c) for c, out in zip(self.getInputCols(), self.getOutputCols(), strict=True)})


class MedianScaler(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Learns a ``MedianScalerModel``: three numbers an input column."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> MedianScalerModel:
        names = self.getInputCols()
        medians = stats.medians(dataset, names)
        means, stds = stats.moments(dataset, medians, names)
        per = {k: [float(d[c]) for c in names] for k, d in (("medians", medians), ("means", means), ("stds", stds))}
        return self._copyValues(MedianScalerModel(**per))


class LinearProbability(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """M2 for one target: weights of the scaled columns, the city's weight and the bias through the sigmoid."""

    weights = Param(Params._dummy(), "weights", "one weight an input column", TypeConverters.toListFloat)
    bias = Param(Params._dummy(), "bias", "bias", TypeConverters.toFloat)
    cities = Param(Params._dummy(), "cities", "known cities", TypeConverters.toListString)
    cityWeights = Param(Params._dummy(), "cityWeights", "one weight a known city", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None, weights=None, bias=0.0, cities=None, cityWeights=None):
        super().__init__()
        self._setDefault(bias=0.0, cities=[], cityWeights=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cities, own = self.getOrDefault(self.cities), self.getOrDefault(self.cityWeights)
        if len(cities) != len(own) or len(cities) > MOST_CITIES:
            raise ValueError(f"{len(cities)} cities and {len(own)} weights; at most {MOST_CITIES} cities, one weight each")
        if len(set(cities)) != len(cities):
            raise ValueError("a city has one weight")
        terms = [F.lit(w) * F.col(c) for w, c in zip(self.getOrDefault(self.weights), self.getInputCols(), strict=True)]
        known, weight, out = f"__city_{self.uid}", F.lit(0.0), dataset
        if cities:
            # a hash join of a bounded table; a map literal is searched from its start for every row
            table = pa.table({known: pa.array(cities, pa.string()), f"{known}_w": pa.array(own, pa.float64())})
            out = dataset.join(F.broadcast(dataset.sparkSession.createDataFrame(table)), F.col("city") == F.col(known), "left")
            weight = F.coalesce(F.col(f"{known}_w"), F.lit(0.0))
        made = clip(infer.sigmoid(add_all([*terms, weight, F.lit(self.getOrDefault(self.bias))])), 0.0, 1.0)
        return out.withColumn(self.getOutputCol(), made).drop(known, f"{known}_w")


def pipeline_of(models: list[infer.LinearModel], prefix: str = "p_"):
    """A ``PipelineModel`` of linear models that share a preprocessor; their city tables are read (at most ``MOST_CITIES`` rows each)."""
    from pyspark.ml import PipelineModel

    pre = models[0].pre
    if any(m.pre is not pre for m in models):
        raise ValueError("the models of one pipeline share a preprocessor")
    names = pre.numeric_features
    scaled = [f"__z_{c}" for c in names]
    made = [MedianScalerModel(inputCols=names, outputCols=scaled, **{k: [float(getattr(pre, k)[c]) for c in names] for k in ("medians", "means", "stds")})]
    read: dict[int, list] = {}  # models may share a table
    for m in models:
        if m.city_weights is not None and id(m.city_weights) not in read:
            read[id(m.city_weights)] = m.city_weights.where("city IS NOT NULL").limit(MOST_CITIES + 1).collect()
        rows = read.get(id(m.city_weights), [])
        if len(rows) > MOST_CITIES:
            raise ValueError(f"more than {MOST_CITIES} cities: keep the model as tables")
        made.append(LinearProbability(inputCols=scaled, outputCol=f"{prefix}{m.target}", weights=[float(m.weights[c]) for c in names], bias=float(m.bias),
                                      cities=[r["city"] for r in rows], cityWeights=[float(r[m.city_weight_col]) for r in rows]))
    return PipelineModel(made)
