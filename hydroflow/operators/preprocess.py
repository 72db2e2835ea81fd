"""Preprocessing estimators that MLlib lacks, with fitted models that can be saved and loaded in a ``Pipeline``.

* ``LevelEncoder``: levels of a category whose share of the rows is at least ``minShare`` get indices 0, 1, ... by falling count (ties by
  name); all others, unknown levels and NULL share the next index. At most 1 / ``minShare`` levels can qualify, so the fitted model is bounded
  whatever the column holds. Followed by a ``OneHotEncoder`` it is the threshold one-hot encoder, alone the threshold ordinal encoder.
* ``ExtremeClipper``: values beyond the ``lower`` and ``upper`` quantiles (a mergeable sketch, relative rank error 1e-4) are set to them; NULL
  and NaN stay."""
from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _LevelParams(HasInputCol, HasOutputCol):
    minShare = Param(Params._dummy(), "minShare", "least share of the rows of a level with an index of its own", TypeConverters.toFloat)
    levels = Param(Params._dummy(), "levels", "fitted levels in index order", TypeConverters.toListString)


class LevelEncoder(Estimator, _LevelParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, minShare=0.01):
        super().__init__()
        self._setDefault(minShare=0.01)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame):
        share = self.getOrDefault(self.minShare)
        if not 0 < share <= 1:
            raise ValueError("minShare must be above 0 and at most 1")
        c = F.col(f"`{self.getInputCol()}`").cast("string")
        counts = dataset.groupBy(c.alias("level")).agg(F.count(F.lit(1)).alias("n"))
        least = share * dataset.count()
        rows = counts.where(F.col("level").isNotNull() & (F.col("n") >= least)).orderBy(F.desc("n"), "level").collect()  # at most 1 / share rows
        model = LevelEncoderModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), levels=[r.level for r in rows])
        return model._set(minShare=share)


class LevelEncoderModel(Model, _LevelParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, levels=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        levels = self.getOrDefault(self.levels)
        c = F.col(f"`{self.getInputCol()}`").cast("string")
        at = F.array_position(F.array(*[F.lit(v) for v in levels]).cast("array<string>"), c)
        index = F.when(c.isNull() | (at == 0), F.lit(float(len(levels)))).otherwise((at - 1).cast("double"))
        # declared as nominal with all its values, so that a one-hot encoder has a slot for each
        meta = {"ml_attr": {"type": "nominal", "vals": [*levels, "__rare__"], "name": self.getOutputCol()}}
        return dataset.withColumn(self.getOutputCol(), index.alias(self.getOutputCol(), metadata=meta))


class _ClipParams(HasInputCols, HasOutputCols):
    lower = Param(Params._dummy(), "lower", "quantile below which values are raised", TypeConverters.toFloat)
    upper = Param(Params._dummy(), "upper", "quantile above which values are lowered", TypeConverters.toFloat)
    bounds = Param(Params._dummy(), "bounds", "fitted low and high value of each column, end to end (NaN: none)", TypeConverters.toListFloat)


class ExtremeClipper(Estimator, _ClipParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, lower=0.01, upper=0.99):
        super().__init__()
        self._setDefault(lower=0.01, upper=0.99)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame):
        probs = [self.getOrDefault(self.lower), self.getOrDefault(self.upper)]
        cols = self.getInputCols()
        known = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
        row = dataset.agg(*[F.percentile_approx(known(c), probs, 10_000).alias(f"q{i}") for i, c in enumerate(cols)]).first()
        bounds = [float("nan") if q is None else float(q[j]) for q in row for j in (0, 1)]
        model = ExtremeClipperModel(inputCols=cols, outputCols=self.getOutputCols(), bounds=bounds)
        return model._set(lower=probs[0], upper=probs[1])


class ExtremeClipperModel(Model, _ClipParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, bounds=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        b = self.getOrDefault(self.bounds)
        out = {}
        for i, (c, o) in enumerate(zip(self.getInputCols(), self.getOutputCols(), strict=True)):
            v, lo, hi = F.col(f"`{c}`").cast("double"), b[2 * i], b[2 * i + 1]
            out[o] = v if lo != lo else F.when(F.isnan(v), v).when(v < lo, F.lit(lo)).when(v > hi, F.lit(hi)).otherwise(v)
        return dataset.withColumns(out)
