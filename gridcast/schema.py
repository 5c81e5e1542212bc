"""Data contracts and fixed values.

Every operator works on a *panel*: many hourly series keyed by ``series_id``
(any list of key columns is accepted), a ``ts`` TIMESTAMP column read under
a UTC session, and a ``load_mw`` DOUBLE value.
"""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ("series_id",)
TS = "ts"
TARGET = "load_mw"

# --- fixed values that must equal the reference's for equal results ---------
# Feature contract, in this order (22 columns; the target is separate).
FEATURE_COLS = [
    "hour", "day_of_week", "month", "quarter", "day_of_year", "week_of_year",
    "is_weekend", "is_holiday",
    "hour_sin", "hour_cos", "month_sin", "month_cos",
    "lag_1h", "lag_24h", "lag_168h",
    "rolling_mean_24h", "rolling_mean_168h", "rolling_std_24h",
    "temp", "rhum", "wspd", "temp_sq",
]
INT_FEATURES = FEATURE_COLS[:8]
# Chronological train/test cut-off of the reference's single series.
SPLIT_DATE = "2017-01-01"
# Weather used when no weather table exists, and at forecast time.
WEATHER_DEFAULTS = {"temp": 10.0, "rhum": 60.0, "wspd": 8.0}
# Cold-start stand-ins for lags / rolling stats when no history is given.
COLD_LOAD_MEAN = 32000.0
COLD_LOAD_STD = 6500.0
# Lags (rows) and rolling windows (rows, previous rows only).
LAGS = (1, 24, 168)
ROLL_MEANS = (24, 168)
ROLL_STDS = (24,)
MAX_LOOKBACK = 168
# Cleaning: interpolate at most this many hours into a gap; clip |z| above.
INTERP_LIMIT = 6
Z_CLIP = 5.0
# Leaderboard display names.
METRIC_NAMES = {"mae": "MAE (MW)", "rmse": "RMSE (MW)", "mape": "MAPE (%)", "r2": "R2"}
# Load bands for the live-predict gauge (MW).
LOAD_BANDS = [(0.0, 20000.0, "0-20k"), (20000.0, 40000.0, "20-40k"), (40000.0, 60000.0, "40-60k")]
# Model names accepted for scoring / forecasting, the default of a request,
# and the names shown in leaderboards and reports.
MODEL_NAMES = ("linear", "rf", "xgboost")
DEFAULT_MODEL = "xgboost"
DISPLAY_NAMES = {"linear": "Linear Regression", "rf": "Random Forest", "xgboost": "XGBoost", "prophet": "Prophet"}
# ---------------------------------------------------------------------------

FEATURE_SCHEMA = T.StructType(
    [T.StructField(c, T.IntegerType()) for c in INT_FEATURES]
    + [T.StructField(c, T.DoubleType()) for c in FEATURE_COLS[8:]]
    + [T.StructField(TARGET, T.DoubleType())]
)

METRICS_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("mae", T.DoubleType()),
    T.StructField("rmse", T.DoubleType()),
    T.StructField("mape", T.DoubleType()),
    T.StructField("r2", T.DoubleType()),
])

