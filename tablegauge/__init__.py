"""Data quality and profiling on Spark DataFrames."""

from tablegauge.operators.catalog import Rule, customer_rules, load_rule_catalog, select_rules
from tablegauge.operators.drift import compare_schemas, detect_data_drift
from tablegauge.operators.forecast import forecast_next_value, predict_columns_likely_to_fail
from tablegauge.operators.profile import (
    cardinality_analysis, column_health_score, completeness_score, duplicate_detection, null_analysis,
    outlier_detection, overall_quality_score, pattern_validation, statistical_profile,
)
from tablegauge.operators.results import (
    exception_totals, get_exceptions, overall_rule_score, summarize_by_dimension,
)
from tablegauge.operators.rules import apply_rules, rule_rollup
from tablegauge.plans.assessment import record, run_rules, schema_changes, trends
from tablegauge.plans.profile import run_full_profile
from tablegauge.sources.history import History
from tablegauge.sources.inference import infer_schema, infer_types, normalize_missing
from tablegauge.sources.readers import load_dataset
from tablegauge.sources.sampling import exact_sample
from tablegauge.sources.summary import dataset_fingerprint, dataset_summary, schema_fingerprint

__all__ = [
    "History", "Rule", "apply_rules", "cardinality_analysis", "column_health_score", "compare_schemas",
    "completeness_score", "customer_rules", "dataset_fingerprint", "dataset_summary", "detect_data_drift",
    "duplicate_detection", "exact_sample", "exception_totals", "forecast_next_value", "get_exceptions",
    "infer_schema", "infer_types", "load_dataset", "load_rule_catalog", "normalize_missing", "null_analysis",
    "outlier_detection", "overall_quality_score", "overall_rule_score", "pattern_validation",
    "predict_columns_likely_to_fail", "record", "rule_rollup", "run_full_profile", "run_rules",
    "schema_changes", "schema_fingerprint", "select_rules", "statistical_profile", "summarize_by_dimension",
    "trends",
]
