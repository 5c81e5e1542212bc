"""Recursive multi-step forecasts for every series at once.

State per series: its last stamp and last ≤168 values (``hist``) — lags
and rolling statistics never look further back, so the state is bounded and
the recursion is exact.  Step ``s`` builds the 22 features of hour
``last + s`` from the state (lags from ``hist``, mean of ``hist`` when it is
shorter than the lag, rolling mean over whatever is there, population std as
the reference does at inference, weather at its defaults), predicts, and
appends the prediction.

* Linear models: the whole recursion is one expression — ``F.aggregate``
  over the steps with the coefficients as literals; one plan, no loop, no
  Python UDF.  What depends on time alone is added up per step beforehand;
  the state carries running sums, so a step costs the same for 1 coefficient
  and for 22.
* Tree ensembles: the same, with the ensemble flattened to arrays (feature,
  threshold, children, value) in a one-row table; a step walks all trees down
  from their roots inside the aggregate.
* Any other fitted pipeline: the loop is over *steps*, each one ``transform``
  of a one-row-per-series frame; the lineage is cut with a reliable
  ``checkpoint()`` (``spark.checkpoint.dir``) every few steps.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import calendar_columns, cyclical_columns, is_holiday_expr
from ..functions.scalar import display_name, model_code
from ..operators.windows import recent_window
from ..schema import FEATURE_COLS, KEYS, MAX_LOOKBACK, MODEL_NAMES, TARGET, TS, WEATHER_DEFAULTS


def _mean(h: Column) -> Column:
    return F.aggregate(h, F.lit(0.0), lambda a, x: a + x) / F.size(h)


def _tail(h: Column, n: int) -> Column:
    return F.slice(h, F.greatest(F.size(h) - F.lit(n - 1), F.lit(1)), n)


def _std(h: Column, ddof: int) -> Column:
    m = _mean(h)
    ss = F.aggregate(h, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
    return F.sqrt(F.try_divide(ss, (F.size(h) - F.lit(ddof)).cast("double")))  # one value, ddof=1 -> null


def step_features(h: Column, t: Column, hol: Column, std_ddof: int = 0) -> dict[str, Column]:
    """The 22 features of the hour ``t`` given the value history ``h``."""
    cal = calendar_columns(t)
    feats = dict(cal)
    feats["is_holiday"] = hol.cast("int")
    feats.update(cyclical_columns(cal["hour"], cal["month"]))
    for n in (1, 24, 168):
        feats[f"lag_{n}h"] = F.element_at(h, -1) if n == 1 else \
            F.when(F.size(h) >= n, F.element_at(h, -n)).otherwise(_mean(h))
    feats["rolling_mean_24h"] = _mean(_tail(h, 24))
    feats["rolling_mean_168h"] = _mean(_tail(h, 168))
    feats["rolling_std_24h"] = _std(_tail(h, 24), std_ddof)
    for c, v in WEATHER_DEFAULTS.items():
        feats[c] = F.lit(v)
    feats["temp_sq"] = F.lit(WEATHER_DEFAULTS["temp"] ** 2)
    return {c: feats[c] for c in FEATURE_COLS}


def history_state(history: DataFrame, horizon: int, keys: Sequence[str] = KEYS, ts: str = TS,
                  value: str = TARGET) -> DataFrame:
    """One row per series: last stamp ``_t``, last ≤168 values ``_h`` in time
    order, holiday flags of the next ``horizon`` hours ``_hols``, empty
    ``_out``.  Groups are bounded (168 rows)."""
    keys = list(keys)
    recent = recent_window(history.select(*keys, ts, value), MAX_LOOKBACK, keys, ts)
    st = recent.groupBy(*keys).agg(
        F.max(ts).alias("_t"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(value).alias("v")))),
                    lambda s: s["v"]).alias("_h"))
    hols = F.transform(F.sequence(F.lit(1), F.lit(horizon)),
                       lambda s: is_holiday_expr(F.to_date(F.timestamp_add("HOUR", s, F.col("_t")))).cast("int"))
    out_t = "array<struct<step:int,ts:timestamp,forecast_mw:double>>"
    return st.withColumn("_hols", hols).withColumn("_out", F.array().cast(out_t))


def _explode_out(state: DataFrame, keys: Sequence[str], name: str | None) -> DataFrame:
    out = state.select(*keys, F.inline("_out"))
    return out.withColumn("model", F.lit(name)).select("model", *keys, "step", "ts", "forecast_mw") if name \
        else out.select(*keys, "step", "ts", "forecast_mw")


def _running_features(st: Column, std_ddof: int) -> dict[str, Column]:
    """Lag and rolling features from the state's values and running sums."""
    h = st["h"]
    n = F.size(h)
    n24 = F.least(n, F.lit(24)).cast("double")
    mean = st["s168"] / n
    m24 = st["s24"] / n24
    spread = F.greatest(st["q24"] / n24 - m24 * m24, F.lit(0.0))
    if std_ddof:
        spread = F.when(n24 > std_ddof, spread * n24 / (n24 - F.lit(float(std_ddof))))
    return {"lag_1h": F.element_at(h, -1),
            "lag_24h": F.when(n >= 24, F.try_element_at(h, F.lit(-24))).otherwise(mean),
            "lag_168h": F.when(n >= 168, F.try_element_at(h, F.lit(-168))).otherwise(mean),
            "rolling_mean_24h": m24, "rolling_mean_168h": mean, "rolling_std_24h": F.sqrt(spread)}


def forecast_linear(history: DataFrame, coefficients: Mapping[str, float], intercept: float,
                    horizon: int = 24, keys: Sequence[str] = KEYS, ts: str = TS, value: str = TARGET,
                    std_ddof: int = 0, name: str | None = None) -> DataFrame:
    """M11 for a linear model: ``keys, step, ts, forecast_mw`` for steps
    1…``horizon`` of every series, as a single plan.

    Running sums are taken about the state's mean value, so that the rolling
    deviation does not lose digits on a high level."""
    keys = list(keys)
    state = history_state(history, horizon, keys, ts, value)
    used = {c: float(b) for c, b in coefficients.items() if b}
    recent = {"lag_1h", "lag_24h", "lag_168h", "rolling_mean_24h", "rolling_mean_168h", "rolling_std_24h"}

    def known(t: Column, holiday: Column) -> Column:
        """Intercept, calendar and weather part of a step's prediction."""
        cal = calendar_columns(t)
        feats = {**cal, "is_holiday": holiday,
                 **cyclical_columns(cal["hour"], cal["month"]),
                 **{c: F.lit(v) for c, v in WEATHER_DEFAULTS.items()}, "temp_sq": F.lit(WEATHER_DEFAULTS["temp"] ** 2)}
        total = F.lit(float(intercept))
        for c, b in used.items():
            if c not in recent:
                total = total + F.lit(b) * feats[c]
        return total

    times = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda s: F.timestamp_add("HOUR", s, F.col("_t")))
    state = state.withColumn("_base", F.zip_with(times, "_hols", known))
    state = state.withColumn("_mid", _mean(F.col("_h")))
    # values about the middle: differences keep the digits of the squares
    state = state.withColumn("_c", F.transform("_h", lambda x: x - F.col("_mid")))
    shift = sum(b for c, b in used.items() if c in recent and c != "rolling_std_24h")
    add = lambda a, x: a + x
    init = F.struct(F.col("_c").alias("h"), F.aggregate(_tail(F.col("_c"), 24), F.lit(0.0), add).alias("s24"),
                    F.aggregate(_tail(F.col("_c"), 24), F.lit(0.0), lambda a, x: a + x * x).alias("q24"),
                    F.aggregate("_c", F.lit(0.0), add).alias("s168"), F.array().cast("array<double>").alias("out"))

    def step(st: Column, base: Column) -> Column:
        feats = _running_features(st, std_ddof)
        pred = base + F.lit(shift) * F.col("_mid")
        for c, b in used.items():
            if c in recent:
                pred = pred + F.lit(b) * feats[c]

        def advance(p: Column) -> Column:  # p is evaluated once
            h, v = st["h"], p - F.col("_mid")
            old24 = F.when(F.size(h) >= 24, F.try_element_at(h, F.lit(-24))).otherwise(F.lit(0.0))
            old168 = F.when(F.size(h) >= MAX_LOOKBACK, F.try_element_at(h, F.lit(-MAX_LOOKBACK))).otherwise(F.lit(0.0))
            grown = F.concat(h, F.array(v))
            return F.struct(
                F.slice(grown, F.greatest(F.size(grown) - F.lit(MAX_LOOKBACK - 1), F.lit(1)), MAX_LOOKBACK).alias("h"),
                (st["s24"] + v - old24).alias("s24"), (st["q24"] + v * v - old24 * old24).alias("q24"),
                (st["s168"] + v - old168).alias("s168"), F.concat(st["out"], F.array(p)).alias("out"))

        return F.transform(F.array(pred), advance)[0]

    res = state.select(*keys, "_t", F.aggregate("_base", init, step, lambda st: st["out"]).alias("_p"))
    out = res.select(*keys, "_t", F.posexplode("_p").alias("_i", "forecast_mw"))
    out = out.select(*keys, (F.col("_i") + 1).alias("step"),
                     F.timestamp_add("HOUR", F.col("_i") + 1, F.col("_t")).alias(TS), "forecast_mw")
    return out.withColumn("model", F.lit(name)).select("model", *keys, "step", TS, "forecast_mw") if name else out


#: Nodes of an ensemble that is flattened (28 bytes each, sent to every task).
FLAT_NODES = 8_000_000


def tree_arrays(model) -> dict:
    """A fitted tree ensemble as arrays: ``roots``, and by node ``feature,
    threshold, left, right, value, cover`` (a leaf leads to itself; values are
    weighted, so that the prediction is their sum; cover: training rows), with
    its ``depth``."""
    import numpy as np

    from ..session import drop_path, scratch_path
    if hasattr(model, "flat"):
        return model.flat()
    spark, last = SparkSession.active(), model.stages[-1]
    path = scratch_path(spark, "trees")
    last.write().save(path)
    split = F.col("nodeData.split")
    nodes = (spark.read.parquet(f"{path}/data")
             .select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild", "nodeData.rawCount",
                     split["featureIndex"].alias("feature"), F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
                     split["numCategories"].alias("categories")).toPandas().sort_values(["treeID", "id"]))
    drop_path(spark, path)
    if (nodes["categories"] >= 0).any():
        raise ValueError("categorical splits cannot be flattened")
    tree, at = nodes["treeID"].to_numpy(), np.arange(len(nodes))
    roots = np.flatnonzero(nodes["id"].to_numpy() == 0)
    first = roots[np.searchsorted(tree[roots], tree)]
    leaf = nodes["leftChild"].to_numpy() < 0
    left = np.where(leaf, at, first + nodes["leftChild"].to_numpy())
    right = np.where(leaf, at, first + nodes["rightChild"].to_numpy())
    weights = np.array(last.treeWeights)
    if type(last).__name__.startswith("RandomForest"):
        weights = weights / weights.sum()
    depth, level = 1, roots
    while len(level := np.concatenate([x[level[~leaf[level]]] for x in (left, right)])):
        depth += 1
    return {"roots": roots, "feature": np.where(leaf, 0, nodes["feature"].to_numpy()),
            "threshold": np.where(leaf, np.inf, nodes["threshold"].to_numpy(dtype=float)), "left": left, "right": right,
            "value": nodes["prediction"].to_numpy() * weights[tree], "cover": nodes["rawCount"].to_numpy(), "depth": depth}


def flat_trees(model) -> DataFrame | None:
    """:func:`tree_arrays` as one row; None if the ensemble has more than
    ``FLAT_NODES`` nodes."""
    if not hasattr(model, "flat") and model.stages[-1].totalNumNodes > FLAT_NODES:
        return None
    trees = tree_arrays(model)
    return flat_frame(SparkSession.active(), trees) if len(trees["feature"]) <= FLAT_NODES else None


def flat_frame(spark: SparkSession, trees: Mapping) -> DataFrame:
    """One row of :func:`flat_trees` from its arrays and ``depth``."""
    import pyarrow as pa
    kinds = {"roots": pa.int32(), "feature": pa.int32(), "threshold": pa.float64(), "left": pa.int32(), "right": pa.int32(),
             "value": pa.float64()}
    row = {k: pa.array([trees[k]], pa.list_(kind)) for k, kind in kinds.items()}
    return spark.createDataFrame(pa.table(row | {"depth": pa.array([trees["depth"]], pa.int32())}))


def walked(x: Column) -> Column:
    """Prediction of the flattened ensemble for the feature array ``x``."""
    part = {k: F.col(f"_trees.{k}") for k in ("feature", "threshold", "left", "right", "value")}
    levels = F.sequence(F.lit(1), F.col("_trees.depth"))

    def down(n: Column, _: Column) -> Column:
        goes_left = F.get(x, F.get(part["feature"], n)) <= F.get(part["threshold"], n)
        return F.when(goes_left, F.get(part["left"], n)).otherwise(F.get(part["right"], n))

    return F.aggregate(F.col("_trees.roots"), F.lit(0.0),
                       lambda total, root: total + F.get(part["value"], F.aggregate(levels, root, down)))


def forecast_trees(model: PipelineModel, history: DataFrame, horizon: int = 24, keys: Sequence[str] = KEYS,
                   ts: str = TS, value: str = TARGET, std_ddof: int = 0, name: str | None = None) -> DataFrame:
    """M11 for tree ensembles, as a single plan: the steps of a series are one
    ``F.aggregate`` over its state, features and ensemble included.  Equal to
    :func:`forecast_model`, which takes over for ensembles too large to send."""
    trees = flat_trees(model)
    if trees is None:
        return forecast_model(model, history, horizon, keys, ts, value, std_ddof, name=name)
    keys, inputs = list(keys), model.cols if hasattr(model, "flat") else model.stages[0].getInputCols()
    # one row of known size
    state = history_state(history, horizon, keys, ts, value).crossJoin(F.broadcast(trees.select(F.struct("*").alias("_trees"))))
    hours = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda s: F.timestamp_add("HOUR", s, F.col("_t")))
    steps = F.zip_with(hours, "_hols", lambda t, holiday: F.struct(t.alias("t"), holiday.alias("holiday")))
    init = F.struct(F.col("_h").alias("h"), F.array().cast("array<double>").alias("out"))

    def step(st: Column, hour: Column) -> Column:
        feats = step_features(st["h"], hour["t"], hour["holiday"], std_ddof)
        x = F.array(*[feats[c].cast("double") for c in inputs])
        predicted = F.transform(F.array(x), lambda x: walked(x))  # the features are evaluated once, so is the prediction

        def advance(p: Column) -> Column:
            grown = F.concat(st["h"], F.array(p))
            return F.struct(F.slice(grown, F.greatest(F.size(grown) - F.lit(MAX_LOOKBACK - 1), F.lit(1)), MAX_LOOKBACK).alias("h"),
                            F.concat(st["out"], F.array(p)).alias("out"))

        return F.get(F.transform(predicted, advance), F.lit(0))

    out = state.select(*keys, "_t", F.aggregate(steps, init, step, lambda st: st["out"]).alias("_p"))
    out = out.select(*keys, "_t", F.posexplode("_p").alias("_i", "forecast_mw"))
    out = out.select(*keys, (F.col("_i") + 1).alias("step"),
                     F.timestamp_add("HOUR", F.col("_i") + 1, F.col("_t")).alias(TS), "forecast_mw")
    return out.withColumn("model", F.lit(name)).select("model", *keys, "step", TS, "forecast_mw") if name else out


def forecast_model(model: PipelineModel, history: DataFrame, horizon: int = 24, keys: Sequence[str] = KEYS,
                   ts: str = TS, value: str = TARGET, std_ddof: int = 0, checkpoint_every: int = 6,
                   name: str | None = None) -> DataFrame:
    """M11 for any fitted pipeline: one distributed ``transform`` per step over
    all series; reliable checkpoints bound the lineage."""
    from ..session import checkpoint_dir
    keys = list(keys)
    checkpoint_dir(history.sparkSession)
    state = history_state(history, horizon, keys, ts, value).checkpoint(eager=True)
    for step in range(1, horizon + 1):
        t1 = F.timestamp_add("HOUR", F.lit(1), F.col("_t"))
        feats = step_features(F.col("_h"), t1, F.element_at("_hols", step), std_ddof)
        scored = model.transform(state.withColumns(feats))
        pred = F.col("prediction")
        h2 = F.concat(F.col("_h"), F.array(pred))
        h2 = F.slice(h2, F.greatest(F.size(h2) - F.lit(MAX_LOOKBACK - 1), F.lit(1)), MAX_LOOKBACK)
        rec = F.struct(F.lit(step).alias("step"), t1.alias("ts"), pred.alias("forecast_mw"))
        state = scored.select(*keys, t1.alias("_t"), h2.alias("_h"), "_hols",
                              F.concat(F.col("_out"), F.array(rec)).alias("_out"))
        if step % checkpoint_every == 0 or step == horizon:
            state = state.checkpoint(eager=True)
    return _explode_out(state, keys, name)


def forecast_models(models: Mapping[str, PipelineModel], history: DataFrame, horizon: int = 24,
                    names: Sequence[str] | None = None, keys: Sequence[str] = KEYS, ts: str = TS,
                    value: str = TARGET, std_ddof: int = 0, display: bool = False) -> DataFrame:
    """Forecasts of each named model as one long table ``model, keys,
    step, ts, forecast_mw``; names may be codes or shown names, ``display``
    gives shown names in the result.  A name that is unknown or not fitted is
    an error.  Linear pipelines and tree ensembles are single plans."""
    names = [model_code(n) for n in (names or models)]
    fitted = {model_code(n): m for n, m in models.items() if m is not None}
    parts = []
    for n in names:
        if n not in MODEL_NAMES or n not in fitted:
            raise ValueError(f"no fitted model called {n!r}; there are {sorted(fitted)}")
        m = fitted[n]
        if hasattr(m, "flat"):
            parts.append(forecast_trees(m, history, horizon, keys, ts, value, std_ddof, n))
            continue
        last = m.stages[-1]
        if hasattr(last, "coefficients") and hasattr(last, "intercept"):
            cols = m.stages[0].getInputCols()
            coef = dict(zip(cols, [float(c) for c in last.coefficients]))
            parts.append(forecast_linear(history, coef, float(last.intercept), horizon, keys, ts, value, std_ddof, n))
        elif hasattr(last, "treeWeights"):
            parts.append(forecast_trees(m, history, horizon, keys, ts, value, std_ddof, n))
        else:
            parts.append(forecast_model(m, history, horizon, keys, ts, value, std_ddof, name=n))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("model", display_name(F.col("model"))) if display else out
