"""Sales time-series analytics on Spark."""

import sys

from pyspark import cloudpickle

from .core import (
    AnomalyTable, CohortTable, Decomposition, Forecast, GrowthMetrics, SalesFrame, SegmentRanking,
)
from .operators.annotate import plot_annotated
from .operators.anomalies import detect_anomalies
from .operators.cohort import cohort_analysis
from .operators.forecast import forecast
from .operators.growth import growth_metrics
from .operators.narrate import narrate
from .operators.segments import compare_segments
from .operators.series import load_sales, to_series
from .operators.trend import decompose_trend

__version__ = "0.1.0"

# Kernels travel to the executors by value, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "load_sales", "to_series", "decompose_trend", "growth_metrics", "detect_anomalies",
    "compare_segments", "plot_annotated", "narrate", "forecast", "cohort_analysis",
    "SalesFrame", "Decomposition", "AnomalyTable", "GrowthMetrics", "SegmentRanking",
    "Forecast", "CohortTable",
]
