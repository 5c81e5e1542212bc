"""gridcast: Spark-native cleaning, features, models and forecasts for
panels of hourly load series."""

from .schema import FEATURE_COLS, TARGET, KEYS, TS  # noqa: F401
