"""Performance history and degradation alerts.

The history is a metrics table; an alert fires when accuracy drops below 90% of
the previous step's accuracy in the same series (variant, k). ``lag`` runs per
series over a handful of rows (phases or days), never over events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def degradation_alerts(history: DataFrame, order: str, series: Sequence[str] = ("variant", "k"),
                       ratio_pct: int = 90) -> DataFrame:
    """Adds prev_accuracy and alert = accuracy < ratio × prev (NULL-safe: no alert at start)."""
    w = Window.partitionBy(*series).orderBy(order)
    prev = F.lag("accuracy", 1).over(w)
    h = history.withColumn("prev_accuracy", prev)
    alert = F.coalesce(F.col("accuracy") * F.lit(100.0) < F.col("prev_accuracy") * F.lit(float(ratio_pct)),
                       F.lit(False))
    return h.withColumn("alert", alert)
