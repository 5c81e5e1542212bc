"""Walk-forward search: staged scoring and the table of trials."""

import pytest
from pyspark.sql import functions as F
from test_forecast_models import history

from gridcast.operators.metrics import mae
from gridcast.operators.split import fold_index
from gridcast.plans import features as PF
from gridcast.plans import models as PM
from gridcast.plans import search as SR

SPACE = dict(SR.SEARCH_SPACE, maxIter=("int", 2, 5), maxDepth=("int", 2, 3))


@pytest.fixture(scope="module")
def train(spark):
    return PF.build_features(history(spark, 320), None).checkpoint()


def test_staged_errors_are_those_of_separate_fits(spark, train):
    data = fold_index(train, 2)
    tr, va = (data.where(c).drop("val_fold") for c in ("val_fold is null or val_fold < 1", "val_fold = 1"))
    params = {**SR.draw_candidates(1, 3, SPACE)[0], "maxIter": 5}
    staged = SR.staged_errors(params, tr, va)
    for k in (2, 4, 5):
        model = PM.fit("xgboost", tr, **{**params, "maxIter": k})
        error = model.transform(va).agg(mae(F.col("load_mw"), F.col("prediction"))).first()[0]
        assert abs(error - staged[k - 1]) < 1e-9
    assert SR.staged_errors(params, tr, va.limit(0)) == [None] * 5


def test_search_goes_on_where_it_stopped(spark, train, tmp_path, monkeypatch):
    trials, fits, plain = str(tmp_path / "trials"), [], SR.staged_errors

    def stops(params, tr, va):
        if len(fits) == 3:
            raise RuntimeError("stopped")
        fits.append(params)
        return plain(params, tr, va)

    monkeypatch.setattr(SR, "staged_errors", stops)
    with pytest.raises(RuntimeError, match="stopped"):
        SR.walk_forward_search(spark, train, 2, 2, space=SPACE, trials=trials, parallelism=1)
    more = []
    monkeypatch.setattr(SR, "staged_errors", lambda *a: more.append(a) or plain(*a))
    best, scores, table, _ = SR.walk_forward_search(spark, train, 2, 2, space=SPACE, trials=trials, parallelism=1)
    assert len(more) == 1
    monkeypatch.setattr(SR, "staged_errors", plain)
    again = SR.walk_forward_search(spark, train, 2, 2, space=SPACE, parallelism=2)
    assert best == again[0] and [tuple(r) for r in table.collect()] == [tuple(r) for r in again[2].collect()]
    # the best number of rounds has the lowest mean fold error
    curves = {}
    for r in spark.read.parquet(trials).collect():
        curves.setdefault(r["candidate"], []).append(r["errors"])
    for r in scores.collect():
        mean = [sum(e[k] for e in curves[r["candidate"]]) / 2 for k in range(1, 5)]
        assert r["rounds"] == 2 + mean.index(min(mean))
    # other rows: nothing is taken over
    more.clear()
    monkeypatch.setattr(SR, "staged_errors", lambda *a: more.append(a) or plain(*a))
    SR.walk_forward_search(spark, train.where("hour <> 3"), 1, 2, space=SPACE, trials=trials, parallelism=1)
    assert len(more) == 2


def test_search_with_penalties(spark, train):
    space = dict(SR.PENALISED_SPACE, rounds=("int", 1, 3), depth=("int", 2, 2))
    best, scores, table, model = SR.walk_forward_search(spark, train, 2, 2, space=space, parallelism=1)
    assert 1 <= best["rounds"] <= 3 and len(model.trees) == best["rounds"] and {"l1", "l2"} <= set(best)
    assert scores.count() == 4 and table.count() == 2 and table.first()["n_folds"] == 2
