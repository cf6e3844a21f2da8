"""Table preparation, profiling and analysis as functions from DataFrame to DataFrame."""

from tablewright.functions.columns import ROW_ID, column_groups
from tablewright.operators.anomalies import detect_anomalies, top_anomalies
from tablewright.operators.cleaning import convert_type, deduplicate, drop_field, treat_missing, treat_outliers
from tablewright.operators.filtering import calculated, filter_rows, search_all
from tablewright.operators.forecasting import forecast_series
from tablewright.operators.grouping import group_summary, melt, pivot_table
from tablewright.operators.hypothesis_tests import mean_confidence_interval, statistical_test
from tablewright.operators.joining import join_tables
from tablewright.operators.kpis import evaluate_kpis, kpi_breakdown, kpi_definition
from tablewright.operators.quality import compare_quality, data_health, dataset_summary
from tablewright.operators.segments import segment_rows
from tablewright.operators.timeseries import resample
from tablewright.plans.recipe import apply_operation, operation_record, recipe_json, replay_recipe
from tablewright.sources.tables import read_csv, read_parquet

__all__ = [
    "ROW_ID", "apply_operation", "calculated", "column_groups", "compare_quality", "convert_type",
    "data_health", "dataset_summary", "deduplicate", "detect_anomalies", "drop_field", "evaluate_kpis",
    "filter_rows", "forecast_series", "group_summary", "join_tables", "kpi_breakdown", "kpi_definition",
    "mean_confidence_interval", "melt", "operation_record", "pivot_table", "read_csv", "read_parquet",
    "recipe_json", "replay_recipe", "resample", "search_all", "segment_rows", "statistical_test",
    "top_anomalies", "treat_missing", "treat_outliers",
]
