"""The rule catalogue: rule metadata, its order and its selection."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

# Position of a rule without a priority.
LAST_PRIORITY = 999

CATALOG_SCHEMA = (
    "rule_id string, dimension string, rule_name string, attribute string, rule_type string, "
    "parameter string, severity string, enabled boolean, priority int"
)

# The customer rules, in catalogue order.  Columns: rule_id, dimension, rule_name, attribute,
# rule_type, parameter (JSON, or the text itself), severity, enabled, priority.
CUSTOMER_RULES = [
    ("CUST-001", "Completeness", "Customer ID Mandatory", "customer_id", "NOT_NULL", None, "CRITICAL", True, 1),
    ("CUST-002", "Uniqueness", "Customer ID Unique", "customer_id", "UNIQUE", None, "CRITICAL", True, 2),
    ("CUST-010", "Completeness", "Name Mandatory", "name", "NOT_NULL", None, "ERROR", True, 3),
    ("CUST-012", "Validity", "Name Length", "name", "LENGTH", '{"min": 2, "max": 100}', "WARNING", True, 4),
    ("CUST-020", "Completeness", "Email Mandatory", "email", "NOT_NULL", None, "ERROR", True, 5),
    ("CUST-021", "Validity", "Email Format", "email", "REGEX", r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "ERROR", True, 6),
    ("CUST-030", "Completeness", "Phone Mandatory", "phone", "NOT_NULL", None, "WARNING", True, 7),
    ("CUST-031", "Validity", "Phone Format", "phone", "REGEX", r"^\+?\d{7,15}$", "ERROR", True, 8),
    ("CUST-036", "Validity", "Repeated Digit Phone", "phone", "NOT_REPEATED_DIGITS", None, "WARNING", True, 9),
    ("CUST-050", "Validity", "Age Range", "age", "RANGE", '{"min": 0, "max": 120}', "ERROR", True, 10),
    ("CUST-044", "Consistency", "Region Valid Value", "region", "ENUM", '["North", "South", "East", "West"]',
     "WARNING", True, 11),
]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    dimension: str | None
    rule_name: str | None
    attribute: str
    rule_type: str
    parameter: str | None = None       # JSON for objects and lists, plain text for patterns
    severity: str | None = None
    enabled: bool = True
    priority: int | None = None

    @staticmethod
    def of(row: dict[str, Any]) -> Rule:
        """From a dictionary or Row as found in a catalogue file."""
        known = {k: row[k] for k in Rule.__dataclass_fields__ if k in row}
        if known.get("enabled") is None:
            known["enabled"] = True
        parameter = known.get("parameter")
        if parameter is not None and not isinstance(parameter, str):
            known["parameter"] = json.dumps(parameter)
        return Rule(**known)

    @property
    def parsed(self) -> Any:
        """The parameter as a Python value; None if it is absent or not JSON."""
        if self.parameter is None:
            return None
        try:
            return json.loads(self.parameter)
        except ValueError:
            return None


def customer_rules() -> list[Rule]:
    return [Rule(*r) for r in CUSTOMER_RULES]


# ---------------------------------------------------------------- catalogue as a table

def order_catalog(rules: DataFrame, ordinal: str) -> DataFrame:
    """Sort by priority; rules without one come last, equal ones keep their file order (``ordinal``)."""
    return rules.orderBy(F.coalesce("priority", F.lit(LAST_PRIORITY)), ordinal)


def first_rules(rules: DataFrame, n: int, ordinal: str) -> DataFrame:
    """The first ``n`` rules in catalogue order.  Disabled rules count, so select before filtering."""
    return order_catalog(rules, ordinal).limit(n)


def enabled_rules(rules: DataFrame) -> DataFrame:
    return rules.where(F.coalesce("enabled", F.lit(True)))


# ---------------------------------------------------------------- catalogue for execution

def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array document (or JSON lines) of rules, with the position in the file as ``ordinal``."""
    rules = spark.read.schema(CATALOG_SCHEMA).option("multiLine", True).json(path)
    return rules.withColumn("ordinal", F.monotonically_increasing_id())


def load_rule_catalog(spark: SparkSession, path: str) -> list[Rule]:
    """The catalogue in execution order.  It is metadata, a few rows, and is kept on the driver."""
    return collect_rules(order_catalog(read_catalog(spark, path), "ordinal"))


def collect_rules(rules: DataFrame) -> list[Rule]:
    return [Rule.of(r.asDict()) for r in rules.collect()]


def select_rules(catalog: list[Rule], rule_count: int) -> list[Rule]:
    return catalog[:rule_count]
