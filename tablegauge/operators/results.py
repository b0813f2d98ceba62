"""Summaries of rule results and the exceptions table.

The summaries accept long results (`apply_rules`) or a roll-up (`rule_rollup`); the roll-up is the cheap way to
the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablegauge.functions.rounding import percent
from tablegauge.operators.checks import ERROR, FAIL, WARNING
from tablegauge.operators.rules import rollup_results

EXCEPTION_COLUMNS = ["record_id", "rule_id", "rule_name", "attribute", "value", "severity", "status"]
CRITICAL = "CRITICAL"


def _rollup(results: DataFrame) -> DataFrame:
    return results if "total" in results.columns else rollup_results(results)


def summarize_by_dimension(results: DataFrame) -> DataFrame:
    """Pass rate and counts per dimension, sorted by dimension.

    Checks that do not apply are in ``total_checks`` but not in the pass rate; ERROR lines are in both.
    """
    applicable = F.sum(F.col("total") - F.col("not_applicable"))
    return (
        _rollup(results).where("dimension is not null").groupBy("dimension")
        .agg(
            F.coalesce(percent(F.sum("passed"), applicable), F.lit(100.0)).alias("pass_rate_pct"),
            F.sum("total").alias("total_checks"),
            F.sum("failed").alias("failed"),
            F.sum("warnings").alias("warnings"),
        )
        .orderBy("dimension")
    )


def overall_rule_score(results: DataFrame) -> DataFrame:
    """Counters over all rules, one row; zeros when there are no results."""
    def total(c) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))
    return _rollup(results).agg(
        F.count_distinct("rule_id").alias("rules_executed"),
        total("passed").alias("passed"),
        total("failed").alias("failed"),
        total("warnings").alias("warnings"),
        total(F.when(F.col("severity") == CRITICAL, F.col("failed"))).alias("critical_issues"),
    )


def exceptions(results: DataFrame) -> DataFrame:
    """The lines that failed, warned or could not be executed, unsorted; for writing out or further queries."""
    return results.where(F.col("status").isin(FAIL, WARNING, ERROR)).select(*EXCEPTION_COLUMNS)


def get_exceptions(results: DataFrame) -> DataFrame:
    """The exceptions in order of severity (as text), rule and record."""
    return exceptions(results).orderBy("severity", "rule_id", "record_id", "attribute", "value", "status")


def exception_totals(results: DataFrame) -> DataFrame:
    """Number of violations and of distinct records that have one."""
    records = exceptions(results).groupBy("record_id").agg(F.count(F.lit(1)).alias("lines"))
    return records.agg(
        F.coalesce(F.sum("lines"), F.lit(0)).alias("violations"), F.count("record_id").alias("records"))
