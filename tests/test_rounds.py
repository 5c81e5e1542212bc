"""Boosting in few jobs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridcast.plans import forecast as FC
from gridcast.plans import models as PM
from gridcast.plans import rounds as RO

COLS = ["a", "b", "c"]


def table(spark, n=600):
    r = np.random.default_rng(5)
    x = pd.DataFrame({"a": r.integers(0, 12, n).astype(float), "b": r.integers(0, 25, n).astype(float), "c": r.normal(size=n)})
    t = pd.Timestamp("2024-01-01")
    y = np.where(x.a > 5, 40.0, 0.0) + 3 * x.b + 8 * x.c + r.normal(0, 1, n)
    return spark.createDataFrame(x.assign(load_mw=y, series_id="s", ts=[t + pd.Timedelta(hours=i) for i in range(n)]))


def predictions(m, df):
    return np.array([r[0] for r in m.transform(df).orderBy("ts").select("prediction").collect()])


@pytest.mark.parametrize("blocks", [1, 4])
def test_without_draws_it_is_sparks_model(spark, monkeypatch, blocks):
    """Features of few values: the split points are Spark's, so are the trees."""
    monkeypatch.setattr(RO, "BLOCK_ROWS", 600 // blocks)
    df, cols = table(spark), ["a", "b"]
    plain = dict(maxIter=6, maxDepth=4, stepSize=0.2, subsamplingRate=1.0, featureSubsetStrategy="all", minInstancesPerNode=3)
    m, want = PM.fit("xgboost", df.repartition(3), cols, **plain), PM.boosted_estimator(cols, **plain).fit(df)
    assert np.allclose(predictions(m, df), predictions(want, df), atol=1e-8)
    assert np.allclose(m.stages[-1].featureImportances.toArray(), want.stages[-1].featureImportances.toArray(), atol=1e-8)
    assert m.stages[-1].treeWeights == want.stages[-1].treeWeights


def test_same_trees_for_any_partitioning(spark, monkeypatch):
    df, got = table(spark), []
    for rows, parts in ((600, 1), (600, 9), (100, 5), (25, 2)):  # one block, one, 6, 24 (added up by Spark)
        monkeypatch.setattr(RO, "BLOCK_ROWS", rows)
        monkeypatch.setattr(RO, "WRITE_EVERY", 2)
        got.append(predictions(PM.fit("xgboost", df.repartition(parts), COLS, maxIter=5, maxDepth=4, stepSize=0.3), df))
    assert all(np.allclose(got[0], g, atol=1e-8) for g in got[1:])


def test_a_block_takes_few_jobs(spark):
    """Spark's learner runs a job a level: 40 rounds were over 240 jobs."""
    df, sc = table(spark).persist(), spark.sparkContext
    df.count()
    sc.setJobGroup("rounds", "rounds")
    try:
        m = PM.fit("xgboost", df, COLS, maxIter=40)
        jobs = len(sc.statusTracker().getJobIdsForGroup("rounds"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert m.stages[-1].getNumTrees == 40 and jobs < 40
    error = m.transform(df).agg(F.avg(F.abs(F.col("load_mw") - F.col("prediction")))).first()[0]
    assert error < 8


def test_saved_flattened_and_odd_rows(spark, tmp_path):
    df = table(spark).union(table(spark).limit(1).withColumn("b", F.lit(None).cast("double")))
    m = PM.fit("xgboost", df, COLS, maxIter=4, maxDepth=3)
    again = PM.load_model(spark, PM.save_model(m, str(tmp_path / "m")))
    assert np.allclose(predictions(m, table(spark)), predictions(again, table(spark)))
    trees = FC.tree_arrays(m)
    assert len(trees["roots"]) == 4 and trees["cover"][trees["roots"]].max() <= 600
    flat = PM.fit("xgboost", table(spark).withColumn("load_mw", F.lit(5.0)), COLS, maxIter=3)
    assert set(predictions(flat, table(spark))) == {5.0} and flat.stages[-1].totalNumNodes == 3
    with pytest.raises(ValueError, match="no rows"):
        PM.fit("xgboost", df.limit(0), COLS, maxIter=1)
