"""Walk-forward hyper-parameter search for the boosted model.

Candidates are a seeded random draw over the reference's ranges (log-uniform
where it is), for Spark's GBT or for the boosting with penalties
(:mod:`.boosting`).  Each (candidate, fold) pair trains on rows before the
fold's validation block and is scored on that block — never on future folds,
which is why ``CrossValidator`` is not used.

Scoring is staged: a pair is one fit with the most rounds of the space, scored
on its fold after every round, so that all numbers of rounds share it; a
candidate's number of rounds is the one with the lowest mean fold error.  Fits
are independent Spark jobs; a few run at a time from driver threads over one
persisted, fold-labelled training frame.  The best candidate (lowest mean fold
MAE) is refitted on all training rows.

Finished pairs go to a table of trials, each with its parameters and errors by
round.  A search that was stopped goes on from there: it reads the pairs whose
parameters and rows are the same and fits the others.
"""

from __future__ import annotations

import json
import math
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.split import fold_index
from ..schema import TS
from ..sources.metrics_io import _exists
from . import boosting as BO
from . import models as PM

# --- fixed values: search ranges of the reference --------------------------------
SEARCH_SPACE = {
    "maxIter": ("int", 200, 1000),
    "maxDepth": ("int", 3, 10),
    "stepSize": ("log", 0.01, 0.3),
    "subsamplingRate": ("float", 0.5, 1.0),
    "featureSubsetStrategy": ("float", 0.5, 1.0),
    "minInstancesPerNode": ("int", 1, 10),
}
PENALISED_SPACE = {
    "rounds": ("int", 200, 1000),
    "depth": ("int", 3, 10),
    "rate": ("log", 0.01, 0.3),
    "row_share": ("float", 0.5, 1.0),
    "column_share": ("float", 0.5, 1.0),
    "min_child_weight": ("int", 1, 10),
    "l1": ("log", 1e-8, 10.0),
    "l2": ("log", 1e-8, 10.0),
}
# -----------------------------------------------------------------------------


def draw_candidates(n_trials: int, seed: int = 42, space: dict | None = None) -> list[dict]:
    """Seeded random parameter sets (a few numbers each)."""
    rng = random.Random(seed)
    out = []
    for _ in range(n_trials):
        c = {}
        for k, (kind, lo, hi) in (space or SEARCH_SPACE).items():
            if kind == "int":
                c[k] = rng.randint(lo, hi)
            elif kind == "log":
                c[k] = math.exp(rng.uniform(math.log(lo), math.log(hi)))
            else:
                c[k] = rng.uniform(lo, hi)
        if "featureSubsetStrategy" in c:
            c["featureSubsetStrategy"] = f"{c['featureSubsetStrategy']:.4f}"
        out.append(c)
    return out


def cv_score(fold_scores: DataFrame) -> DataFrame:
    """Mean fold MAE per candidate, best first."""
    return (fold_scores.groupBy("candidate").agg(F.avg("mae").alias("cv_mae"), F.count(F.lit(1)).alias("n_folds"))
                       .orderBy(F.col("cv_mae").asc_nulls_last(), "candidate"))


def staged_errors(params: dict, train: DataFrame, valid: DataFrame) -> list[float | None]:
    """Mean absolute error on ``valid`` after each round of one fit (null
    where ``valid`` has no rows)."""
    if "rounds" in params:
        return BO.fit_penalised(train, valid=valid, **params)[1]
    model = PM.fit("xgboost", train, **params)
    rows = model.stages[0].transform(valid.dropna())
    if not rows.take(1):
        return [None] * params["maxIter"]
    return [float(e) for e in model.stages[-1].evaluateEachIteration(rows, "absolute")]


def _refit(params: dict, train: DataFrame):
    return BO.fit_penalised(train, **params) if "rounds" in params else PM.fit("xgboost", train, **params)


def finished_trials(spark: SparkSession, trials: str, said: dict[tuple[int, int], str]) -> dict[tuple[int, int], list]:
    """Errors by round of the (candidate, fold) pairs in the table of trials
    whose description is that of ``said``."""
    done = [f"{trials}/candidate={c}/fold={f}" for c, f in said if _exists(spark, f"{trials}/candidate={c}/fold={f}/_SUCCESS")]
    if not done:
        return {}
    rows = spark.read.option("basePath", trials).parquet(*done).collect()  # a row of each pair
    return {(r["candidate"], r["fold"]): r["errors"] for r in rows if r["params"] == said[r["candidate"], r["fold"]]}


def walk_forward_search(spark: SparkSession, train: DataFrame, n_trials: int = 50, n_splits: int = 3,
                        seed: int = 42, parallelism: int = 4, space: dict | None = None, ts: str = TS,
                        trials: str | None = None):
    """M6: returns ``(best_params, fold_scores, cv_table, refitted_model)``;
    ``trials`` is a folder that keeps the finished pairs."""
    space = space or SEARCH_SPACE
    count = "rounds" if "rounds" in space else "maxIter"
    _, low, top = space[count]
    cands = [{**c, count: top} for c in draw_candidates(n_trials, seed, space)]
    base = train.dropna().persist()  # read by the fold index twice, then by every fit
    data = fold_index(base, n_splits, ts).persist()
    vf = F.col("val_fold")
    rows = data.groupBy("val_fold").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*base.columns) % F.lit(1 << 31)).alias("h"))
    mark = sorted((str(r["val_fold"]), r["n"], r["h"]) for r in rows.collect())
    said = {(c, f): json.dumps([p, n_splits, mark], sort_keys=True) for c, p in enumerate(cands) for f in range(n_splits)}
    curves = finished_trials(spark, trials, said) if trials else {}

    def run(job):
        ci, fold = job
        errors = staged_errors(cands[ci], data.filter(vf.isNull() | (vf < fold)).drop("val_fold"), data.filter(vf == fold).drop("val_fold"))
        if trials:
            (spark.createDataFrame([(said[job], errors)], "params string, errors array<double>").coalesce(1)
             .write.mode("overwrite").parquet(f"{trials}/candidate={ci}/fold={fold}"))
        return job, errors

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        curves |= dict(pool.map(run, [j for j in said if j not in curves]))
    chosen = {}
    for c in range(len(cands)):
        folds = [curves[c, f] for f in range(n_splits) if curves[c, f] and curves[c, f][0] is not None]
        mean = [sum(e[k] for e in folds) / len(folds) for k in range(low - 1, min(map(len, folds)))] if folds else [0.0]
        chosen[c] = low + min(range(len(mean)), key=mean.__getitem__)
    schema = T.StructType([T.StructField("candidate", T.IntegerType()), T.StructField("fold", T.IntegerType()),
                           T.StructField("rounds", T.IntegerType()), T.StructField("mae", T.DoubleType())])
    at = lambda e, k: e[min(k, len(e)) - 1] if e else None  # noqa: E731  (a fit may end early)
    scores = spark.createDataFrame([(c, f, chosen[c], at(curves[c, f], chosen[c])) for c, f in said], schema)
    table = cv_score(scores)
    best = table.first()["candidate"]
    params = {**cands[best], count: chosen[best]}
    model = _refit(params, base)
    data.unpersist()
    base.unpersist()
    return params, scores, table, model


def tuned_run(best: dict, table: DataFrame, model, test: DataFrame, experiment: str = "tuned") -> DataFrame:
    """The refitted best candidate as a run record: its parameters, the best
    mean fold MAE and its scores on the test frame."""
    from ..operators.metrics import evaluate_models
    from ..sources.runs import run_records
    metrics = evaluate_models(PM.predict(model, test, name="xgboost"), rounded=False)
    return run_records(metrics, experiment, {**best, "cv_best_mae": table.first()["cv_mae"]})
