"""Scoring plans: deterministic baseline predictions and the scoring of a
test frame by fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEYS, TARGET, TS


def lag_predictions(features: DataFrame, keys=KEYS, ts: str = TS) -> DataFrame:
    """Seasonal-naive predictions read off the feature frame: ``lag24``
    predicts ``lag_24h``, ``lag168`` predicts ``lag_168h``.  Long table
    ``model, keys, ts, y, p``."""
    d = features.select(*keys, ts, F.col(TARGET).alias("y"),
                        F.col("lag_24h").alias("lag24"), F.col("lag_168h").alias("lag168"))
    # one pass (Expand) over the feature frame, not a union of two scans
    return d.unpivot([*keys, ts, "y"], ["lag24", "lag168"], "model", "p").select("model", *keys, ts, "y", "p")
