import random
import tempfile

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from hydroflow.operators import models
from hydroflow.operators.preprocess import ExtremeClipper, LevelEncoder


@pytest.fixture(scope="module")
def table(spark):
    rows = [("a" if i < 500 else "b" if i < 800 else f"r{i}" if i < 990 else None, float(i), None if i % 50 == 0 else float(i % 10)) for i in range(1000)]
    rows.append(("a", 1e9, float("nan")))
    return spark.createDataFrame(rows, "c string, x double, z double").repartition(3)


def test_rare_levels_fold(table):
    m = LevelEncoder(inputCol="c", outputCol="i", minShare=0.01).fit(table)
    assert m.getOrDefault("levels") == ["a", "b"]
    got = {(r.i): r["count"] for r in m.transform(table).groupBy("i").count().collect()}
    assert got == {0.0: 501, 1.0: 300, 2.0: 200}
    with pytest.raises(ValueError):
        LevelEncoder(inputCol="c", outputCol="i", minShare=0.0).fit(table)
    empty = LevelEncoder(inputCol="c", outputCol="i").fit(table.limit(0))
    assert {r.i for r in empty.transform(table).select("i").distinct().collect()} == {0.0}


def test_extremes_are_clipped(table):
    m = ExtremeClipper(inputCols=["x", "z"], outputCols=["x2", "z2"], lower=0.05, upper=0.95).fit(table)
    r = m.transform(table).agg(F.max("x2"), F.min("x2"), F.count("z2"), F.sum(F.isnan("z2").cast("int"))).first()
    assert 940 <= r[0] <= 960 and 40 <= r[1] <= 60 and r[2] == table.where("z is not null").count() and r[3] == 1


def test_pipeline_is_saved_and_loaded(table):
    stages, out = models.preprocessing(["x", "z"], ["c"], min_level_share=0.05, clip=(0.01, 0.99))
    m = Pipeline(stages=stages).fit(table)
    path = tempfile.mkdtemp(prefix="hf-pre-")
    models.save(m, f"{path}/m")
    back = PipelineModel.load(f"{path}/m")
    a, b = (x.transform(table).select("x", out).orderBy("x").collect() for x in (m, back))
    assert a == b and len(a[0][1]) == 2 + 2 + 3
    stages, out = models.preprocessing(["x"], ["c"], ordinal=True)
    assert len(Pipeline(stages=stages).fit(table).transform(table).select(out).first()[0]) == 3


@pytest.mark.parametrize("algo", ["XGB", "RF", "ET", "LR"])
def test_search_ranges(algo):
    est = models.regressor(algo)
    ranges = models.SEARCH_RANGES["linear" if algo == "LR" else "booster"]
    draws = [models.random_params(est, random.Random(i), ranges) for i in range(200)]
    for d in draws:
        v = {p.name: x for p, x in d.items()}
        assert all(est.hasParam(n) for n in v)
        if algo == "LR":
            assert 1e-12 <= v["regParam"] <= 1e-2
        else:
            assert 2 <= v["maxDepth"] <= 8 and 0.3 <= float(v["featureSubsetStrategy"]) <= 1 and 64 <= v.get("maxIter", v.get("numTrees")) <= 1024
            assert ("stepSize" in v) == (algo == "XGB")
