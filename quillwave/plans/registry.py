"""The modules whose QUERIES and SQL make up the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillwave.plans import core_problems, q_catalog, q_events, q_features, q_metrics, q_reports, q_streaming, q_transfer

MODULES = [core_problems, q_events, q_metrics, q_catalog, q_features, q_streaming, q_transfer, q_reports]


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Scores to candidate events to interval scores, summed by run."""
    return q_events.fold_totals(spark, d)
