"""Model fitting, scoring and explanation.

One global model per name is fitted over the whole panel (the reference fits
one model to its single series); Spark ML trains it distributed —
normal-equation least squares by one tree-aggregate of XᵀX, forests and
boosted trees by distributed histograms.  The feature frame is persisted
around multi-model fits so it is computed once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import model_code
from ..operators.joins import stack_predictions
from ..operators.metrics import evaluate_models, mae
from ..schema import FEATURE_COLS, KEYS, MODEL_NAMES, TARGET, TS
from ..session import materialize

FEATURES_VEC = "features"

# --- fixed hyper-parameters of the reference's models ------------------------
FOREST_PARAMS = {"numTrees": 200, "maxDepth": 16, "minInstancesPerNode": 4}
BOOSTED_PARAMS = {"maxIter": 500, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8,
                  "featureSubsetStrategy": "0.8", "minInstancesPerNode": 3}
SEED = 42
# -----------------------------------------------------------------------------
# Engine settings for the tree learners (not model semantics): cache each
# row's node id between levels instead of re-walking deep trees, and give the
# per-level node statistics more room so fewer passes are needed.
TREE_ENGINE = {"cacheNodeIds": True, "checkpointInterval": 10}


#: Settings of a boosted fit that :mod:`.rounds` takes; with others Spark's learner fits.
ROUNDS_KNOW = {"maxIter", "maxDepth", "stepSize", "subsamplingRate", "featureSubsetStrategy", "minInstancesPerNode", "minInfoGain",
               "maxBins", "maxMemoryInMB", "cacheNodeIds", "checkpointInterval"}
#: Rows a task of the tree learners can take before another one pays off.
ROWS_PER_TASK = 200_000


def tree_memory_mb(spark: SparkSession) -> int:
    """Per-task budget for the tree learners' node statistics.  Every
    concurrent task may allocate it, so it is sized from the executor heap
    and task slots (local mode: the driver JVM) — a fixed 256-512 MB times
    8 slots exhausts a 1 GB heap."""
    sc = spark.sparkContext
    try:
        if sc.master.startswith("local"):
            heap = sc._jvm.java.lang.Runtime.getRuntime().maxMemory() / (1 << 20)
            slots = max(1, sc.defaultParallelism)
        else:
            mem = spark.conf.get("spark.executor.memory", "4g").lower()
            heap = float(mem[:-1]) * (1024 if mem.endswith("g") else 1) if mem[-1] in "gm" else float(mem) / (1 << 20)
            slots = max(1, int(spark.conf.get("spark.executor.cores", "4")))
    except Exception:  # noqa: BLE001 - fall back to Spark's default
        return 256
    return int(max(16, min(512, heap * 0.25 / slots)))


def _assembler(cols: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol=FEATURES_VEC, handleInvalid="error")


# Ridge of 1e-9 (in standardised units) keeps the normal equations solvable
# when features are exactly collinear (e.g. day of year vs ISO week and
# weekday inside one month); relative effect on a well-posed fit ~1e-9.
OLS_RIDGE = 1e-9


def linear_estimator(cols: Sequence[str] = FEATURE_COLS) -> Pipeline:
    """M3: ordinary least squares with intercept, solved by the normal
    equations (one distributed XᵀX aggregate).  :func:`fit` removes constant
    columns first (the intercept absorbs them, as a least-squares solver's
    minimum-norm answer does)."""
    lr = LinearRegression(featuresCol=FEATURES_VEC, labelCol=TARGET, predictionCol="prediction",
                          regParam=OLS_RIDGE, elasticNetParam=0.0, solver="normal", standardization=True)
    return Pipeline(stages=[_assembler(cols), lr])


def forest_estimator(cols: Sequence[str] = FEATURE_COLS, **overrides) -> Pipeline:
    """M4: random forest; every feature considered at every split (the
    scikit-learn regressor default), bootstrap rows, seed 42."""
    p = {**FOREST_PARAMS, **TREE_ENGINE, **overrides}
    rf = RandomForestRegressor(featuresCol=FEATURES_VEC, labelCol=TARGET, predictionCol="prediction",
                               featureSubsetStrategy="all", seed=SEED, **p)
    return Pipeline(stages=[_assembler(cols), rf])


def boosted_estimator(cols: Sequence[str] = FEATURE_COLS, **overrides) -> Pipeline:
    """M5: gradient-boosted trees (Spark's GBT stands in for xgboost: no
    L1/L2 leaf penalties, column sampling per node)."""
    p = {**BOOSTED_PARAMS, **TREE_ENGINE, "cacheNodeIds": False, **overrides}  # shallow trees: re-walking is cheaper
    gbt = GBTRegressor(featuresCol=FEATURES_VEC, labelCol=TARGET, predictionCol="prediction", seed=SEED, **p)
    return Pipeline(stages=[_assembler(cols), gbt])


ESTIMATORS = {"linear": linear_estimator, "rf": forest_estimator, "xgboost": boosted_estimator}


def estimator(name: str, cols: Sequence[str] = FEATURE_COLS, **overrides) -> Pipeline:
    name = model_code(name)
    if name not in ESTIMATORS:
        raise ValueError(f"no estimator called {name!r}; there are {sorted(ESTIMATORS)}")
    return ESTIMATORS[name](cols, **overrides) if name != "linear" else linear_estimator(cols)


def varying_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns whose min differs from their max (one aggregate row)."""
    row = df.agg(*[(F.min(c) != F.max(c)).alias(c) for c in cols]).first()
    return [c for c in cols if row is not None and row[c]]


def fit(name: str, train: DataFrame, cols: Sequence[str] = FEATURE_COLS, **overrides) -> PipelineModel:
    """Fit the named model on ``train`` (rows with any null feature are
    excluded, as the reference's feature frame has none).  The linear model
    is fitted on the non-constant columns; the others have coefficient 0."""
    t = train.dropna(subset=[*cols, TARGET]).persist()
    if name == "xgboost" and not set(overrides) - ROUNDS_KNOW:
        from .rounds import fit_rounds
        assembler, gbt = boosted_estimator(cols, **overrides).getStages()
        try:
            return PipelineModel([assembler, fit_rounds(t, t.count(), cols, gbt)])
        finally:
            t.unpersist()
    if name in ("rf", "xgboost"):
        # a tree level is a job: no more tasks than the rows can use
        parts = max(1, -(-t.count() // ROWS_PER_TASK))
        if parts < t.rdd.getNumPartitions():
            whole, t = t, t.coalesce(parts).persist()
            t.count()
            whole.unpersist()
    if name in ("rf", "xgboost") and "maxMemoryInMB" not in overrides:
        overrides = dict(overrides, maxMemoryInMB=tree_memory_mb(train.sparkSession))
    try:
        if name == "linear":
            # all constant: the intercept is the fit; one of them (coefficient 0) stands for all
            cols = varying_columns(t, cols) or [cols[0]]
        return estimator(name, cols, **overrides).fit(t)
    finally:
        t.unpersist()


def predict(model: PipelineModel, df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS,
            name: str | None = None) -> DataFrame:
    """Score a frame: ``[model], keys, ts, y, p``."""
    out = model.transform(df).select(*keys, ts, F.col(TARGET).alias("y"), F.col("prediction").alias("p"))
    return out.withColumn("model", F.lit(name)).select("model", *keys, ts, "y", "p") if name else out


def score_test(models: Mapping[str, PipelineModel | None], test: DataFrame,
               keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """Predictions of every available model on the same test frame, as
    one long table; a missing model (``None``) is skipped."""
    frames = {n: m.transform(test).select(*keys, ts, F.col(TARGET).alias("y"), F.col("prediction").alias("p"))
              for n, m in models.items() if m is not None}
    if not frames:
        raise ValueError("no model to score")
    return stack_predictions(frames).select("model", *keys, ts, "y", "p")


# --- persistence (S7) ---------------------------------------------------------

def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    """Reload a saved model; a path that holds none is an error."""
    from ..sources.metrics_io import _exists
    if not _exists(spark, path):
        raise FileNotFoundError(f"no saved model at {path}")
    return PipelineModel.load(path)


def load_models(spark: SparkSession, root: str, names: Sequence[str] = MODEL_NAMES) -> dict[str, PipelineModel | None]:
    """Models under ``root/<name>``; absent ones map to ``None`` (skipped)."""
    from ..sources.metrics_io import _exists
    return {n: (PipelineModel.load(f"{root}/{n}") if _exists(spark, f"{root}/{n}") else None) for n in names}


# --- explanation (M7, M8, M9) ---------------------------------------------------

def linear_coefficients(model: PipelineModel, cols: Sequence[str] = FEATURE_COLS) -> tuple[dict[str, float], float]:
    """Coefficients by feature name (0 for columns the fit dropped) and the
    intercept of a fitted linear pipeline (a handful of numbers)."""
    lr = model.stages[-1]
    used = dict(zip(model.stages[0].getInputCols(), [float(c) for c in lr.coefficients]))
    return {c: used.get(c, 0.0) for c in cols if c in used or cols is FEATURE_COLS}, float(lr.intercept)


def feature_importance(spark: SparkSession, model: PipelineModel, cols: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """M7: importance per feature (tree models: impurity importance; linear:
    |coefficient|), one row per feature."""
    last = model.stages[-1]
    used = model.stages[0].getInputCols()
    if hasattr(last, "featureImportances"):
        got = dict(zip(used, [float(v) for v in last.featureImportances.toArray()]))
    else:
        got = dict(zip(used, [abs(float(v)) for v in last.coefficients]))
    vals = [got.get(c, 0.0) for c in cols]
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())])
    return spark.createDataFrame(list(zip(cols, vals)), schema)


def linear_contributions(df: DataFrame, coefficients: Mapping[str, float], keys: Sequence[str] = KEYS,
                         ts: str = TS) -> DataFrame:
    """M8: per-row additive contributions ``coef·(x − mean(x))`` for a linear
    model (exact Shapley values for linear models with independent
    features).  Long table ``keys, ts, feature, contribution``; the feature
    means are one aggregate row, broadcast by construction."""
    cols = list(coefficients)
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    d = df.crossJoin(F.broadcast(means))
    contrib = {c: F.lit(float(coefficients[c])) * (F.col(c) - F.col(f"_m_{c}")) for c in cols}
    wide = d.select(*keys, ts, *[v.alias(k) for k, v in contrib.items()])
    return wide.unpivot([*keys, ts], cols, "feature", "contribution")


def permutation_importance(model: PipelineModel, df: DataFrame, cols: Sequence[str] = FEATURE_COLS,
                           seed: int = SEED, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """M9: MAE increase when one feature column is shuffled across all rows.

    Rows have two random orders, md5 hashes of their keys and ``seed``.  A row
    takes the feature value of the row whose rank in the second order is its own
    rank in the first.  Ranks are exact and global but made by blocks of the hash
    (:func:`hash_rank`); rows and donors of all features meet in one join on the
    rank, written once, and every feature is a scan of it.  The same data gives
    the same importances on any cluster."""
    from ..operators.ordered import hash_rank
    from ..session import drop_path, scratch_path
    spark = df.sparkSession
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys], F.unix_micros(ts).cast("string"))
    hashed = [F.md5(F.concat(F.lit(f"{s}/"), name)).alias(c) for s, c in ((seed, "_a"), (seed + 1, "_b"))]
    path, paired = scratch_path(spark, "permutation-rows"), scratch_path(spark, "permutation-pairs")
    df.dropna(subset=[*cols, TARGET]).select("*", *hashed).write.parquet(path)
    base = spark.read.parquet(path)
    # renamed before the rank: its order holds a hash of all columns, and an alias above it doubles what the planner
    # knows about that hash, 2 ** 22 facts for all features
    donors = hash_rank(base.select("_b", *[F.col(c).alias(f"_p_{c}") for c in cols]), "_b", "_i").drop("_b")
    hash_rank(base.drop("_b"), "_a", "_i").join(donors, "_i").write.parquet(paired)
    pairs = spark.read.parquet(paired)
    error = mae(F.col(TARGET), F.col("prediction"))
    out = model.transform(pairs).agg(error.alias("mae")).withColumn("feature", F.lit(None).cast("string"))
    for c in cols:
        out = out.unionByName(model.transform(pairs.withColumn(c, F.col(f"_p_{c}"))).agg(error.alias("mae"))
                              .withColumn("feature", F.lit(c)))
    out = materialize(out)
    for p in (path, paired):
        drop_path(spark, p)
    plain = out.where("feature is null").select(F.col("mae").alias("_plain"))  # one row
    return (out.where("feature is not null").crossJoin(F.broadcast(plain))
            .select("feature", (F.col("mae") - F.col("_plain")).alias("importance")))


# --- flows (M15, M16) -------------------------------------------------------------

def train_all(train: DataFrame, test: DataFrame, names: Sequence[str] = MODEL_NAMES,
              overrides: Mapping[str, dict] | None = None, keys: Sequence[str] = KEYS,
              ts: str = TS, fitted: Mapping[str, PipelineModel] | None = None
              ) -> tuple[dict[str, PipelineModel], DataFrame, DataFrame]:
    """Fit every named model on ``train`` (those in ``fitted`` are
    there already), score ``test``, and return ``(models, predictions,
    metrics)``; metrics use the reference's rounding."""
    overrides = overrides or {}
    test = test.persist()  # scored by every model
    models = {n: (fitted or {}).get(n) or fit(n, train, **overrides.get(n, {})) for n in names}
    preds = materialize(score_test(models, test, keys, ts))
    test.unpersist()
    metrics = evaluate_models(preds, rounded=True)
    return models, preds, metrics


def retrain_baseline(train: DataFrame, test: DataFrame, overrides: Mapping[str, dict] | None = None,
                     keys: Sequence[str] = KEYS, ts: str = TS) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Refit only the linear and forest models; returns their metrics
    (to be merged into the stored metrics with upsert, not overwrite)."""
    models, _, metrics = train_all(train, test, ("linear", "rf"), overrides, keys, ts)
    return models, metrics
