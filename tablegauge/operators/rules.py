"""Running a rule catalogue over a DataFrame."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablegauge.functions.lineage import cut_lineage
from tablegauge.functions.missing import quoted
from tablegauge.functions.text import cell_text, matches_from_start
from tablegauge.operators.catalog import Rule
from tablegauge.operators.checks import (
    CHECKS, ERROR, FAIL, NOT_APPLICABLE, PASS, UNIQUE, WARNING, BadParameter, Cell, Check, status_of, violation,
)
from tablegauge.operators.columns import column_types, empty_frame
from tablegauge.operators.uniqueness import digest_key, mark_repeated_lines, rule_key_counts

RESULT_SCHEMA = (
    "row_index string, record_id string, rule_id string, rule_name string, dimension string, "
    "attribute string, severity string, status string, value string"
)
ROLLUP_SCHEMA = (
    "rule_id string, rule_name string, dimension string, severity string, total bigint, passed bigint, "
    "failed bigint, warnings bigint, not_applicable bigint, errors bigint"
)
LABELS = ["rule_id", "rule_name", "dimension", "attribute", "severity"]
ROLLUP_LABELS = ["rule_id", "rule_name", "dimension", "severity"]
RECORD_ID_COLUMN = "customer_id"

# Rules aggregated together in one roll-up pass; keeps the generated code small.
RULE_BLOCK = 32


class CompiledCatalog:
    """The enabled rules of a catalogue, sorted by how they are executed on a given DataFrame."""

    def __init__(self, df: DataFrame, catalog: Sequence[Rule], checks: dict[str, Check]):
        self.single: list[tuple[Rule, str]] = []       # one line for the whole rule, with its status
        self.cell: list[tuple[Rule, Column]] = []      # one status per row
        self.unique: list[Rule] = []                   # needs the whole column
        self.custom = any(checks[r.rule_type] not in CHECKS.values() for r in catalog if r.rule_type in checks)
        types = column_types(df)
        bad_patterns = _bad_patterns(
            df.sparkSession, {r.parameter for r in catalog if r.rule_type == "REGEX" and r.parameter is not None})
        for rule in catalog:
            if not rule.enabled:
                continue
            if rule.attribute not in types:
                self.single.append((rule, NOT_APPLICABLE))
            elif rule.rule_type == UNIQUE:
                self.unique.append(rule)
            elif rule.rule_type not in checks or (rule.rule_type == "REGEX" and rule.parameter in bad_patterns):
                self.single.append((rule, ERROR))
            else:
                try:
                    status = status_of(Cell(rule.attribute, types[rule.attribute]), rule, checks)
                except BadParameter:
                    self.single.append((rule, ERROR))
                else:
                    self.cell.append((rule, status))


    def needed_columns(self, df: DataFrame) -> list[str]:
        """Columns the rules look at, and the record id; all of them if a check is not a built-in one."""
        if self.custom:
            return df.columns
        used = {rule.attribute for rule, _ in self.cell} | {rule.attribute for rule in self.unique}
        return [c for c in df.columns if c in used or c == RECORD_ID_COLUMN]


def _bad_patterns(spark: SparkSession, patterns: set[str]) -> set[str]:
    """Patterns the regular-expression engine rejects; their rules become an ERROR line, not a failed job."""
    def compiles(some: set[str]) -> bool:
        try:
            spark.range(1).selectExpr(*[matches_from_start("''", p) for p in some]).head()
        except PySparkException:
            return False
        return True
    if not patterns or compiles(patterns):
        return set()
    return {p for p in patterns if not compiles({p})}


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Number the rows (unique, not consecutive) and write them out, so that a lost task cannot renumber them."""
    return cut_lineage(df.withColumn(name, F.monotonically_increasing_id()))


def apply_rules(df: DataFrame, catalog: Sequence[Rule], id_cols: Sequence[str] | None = None,
                checks: dict[str, Check] = CHECKS) -> DataFrame:
    """Long results: one line per row and enabled rule.

    ``id_cols`` name the columns that identify a row in ``row_index``.  Without them rows are numbered, or named by
    file and position where a UNIQUE rule needs them twice and they come straight from Parquet files.  Rules on
    single cells are evaluated side by side in one scan that shuffles nothing; a UNIQUE rule adds a pass over its
    own column and the ids.
    """
    compiled = CompiledCatalog(df, catalog, checks)
    types = column_types(df)
    source, index = _identify(df, compiled, id_cols)
    record = _record_id(df, index)
    parts = []
    if compiled.cell:
        lines = [
            F.struct(F.lit(i + 1).alias("rule"), status.alias("status"),
                     F.expr(f"{cell_text(rule.attribute, types[rule.attribute])} as value"))
            for i, (rule, status) in enumerate(compiled.cell)
        ]
        stacked = source.select(index, record, F.inline(F.array(*lines)))
        parts.append(_labelled(stacked, [r for r, _ in compiled.cell], LABELS, ["status", "value"]))
    if compiled.unique:
        # All UNIQUE rules in one count and one marking; the lines carry a digest of the value as their key.
        keyed = [
            F.struct(F.lit(i + 1).alias("rule"), digest_key(rule.attribute, types[rule.attribute]).alias("key"),
                     F.expr(f"{cell_text(rule.attribute, types[rule.attribute])} as value"))
            for i, rule in enumerate(compiled.unique)
        ]
        stacked = source.select(index, record, F.inline(F.array(*keyed)))
        marked = mark_repeated_lines(stacked, "repeated").selectExpr(
            "row_index", "record_id", "rule", f"case when repeated then '{FAIL}' else '{PASS}' end as status", "value")
        parts.append(_labelled(marked, compiled.unique, LABELS, ["status", "value"]))
    if compiled.single:
        parts.append(_single_lines(df.sparkSession, compiled.single))
    if not parts:
        return empty_frame(df, RESULT_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def _identify(df: DataFrame, compiled: CompiledCatalog,
              id_cols: Sequence[str] | None) -> tuple[DataFrame, Column]:
    if id_cols:
        texts = [quoted(c).cast("string") for c in id_cols]
        key = texts[0] if len(texts) == 1 else F.to_json(F.array(*texts))
        return df, key.alias("row_index")
    if compiled.unique:                     # the rows are read several times and must keep their numbers
        placed = _by_place(df)
        if placed is not None:
            return placed, F.col("__row").alias("row_index")
        numbered = with_row_index(df.select(*map(quoted, compiled.needed_columns(df))), "__row")
    else:
        numbered = df.withColumn("__row", F.monotonically_increasing_id())
    return numbered, F.col("__row").cast("string").alias("row_index")


def _by_place(df: DataFrame) -> DataFrame | None:
    """Rows that come straight from Parquet files, with file and position as ``__row``; None for all others."""
    if "_metadata" in df.columns:
        return None
    try:
        return df.withColumn("__row", F.expr("concat(_metadata.file_path, '#', _metadata.row_index)"))
    except PySparkException:
        return None


def _record_id(df: DataFrame, index: Column) -> Column:
    """The id shown to people: the customer id if the table has one."""
    if RECORD_ID_COLUMN in df.columns:
        return quoted(RECORD_ID_COLUMN).cast("string").alias("record_id")
    return index.alias("record_id")


def _labelled(lines: DataFrame, rules: Sequence[Rule], labels: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Replace the position ``rule`` by the rule's labels, from a constant array."""
    text = json.dumps([{name: getattr(r, name) for name in labels} for r in rules])
    schema = f"array<struct<{', '.join(f'{name}: string' for name in labels)}>>"
    label = F.element_at(F.from_json(F.lit(text), schema), F.col("rule"))
    ids = [c for c in ("row_index", "record_id") if c in lines.columns]
    return lines.withColumn("label", label).select(*ids, *[f"label.{name}" for name in labels], *measures)


def _single_lines(spark: SparkSession, rules: list[tuple[Rule, str]]) -> DataFrame:
    lines = [f"struct({i + 1} as rule, '{status}' as status)" for i, (_, status) in enumerate(rules)]
    stacked = spark.range(1).selectExpr(
        "cast(null as string) as row_index", "cast(null as string) as record_id", f"inline(array({', '.join(lines)}))",
        "cast(null as string) as value")
    return _labelled(stacked, [r for r, _ in rules], LABELS, ["status", "value"])


# ---------------------------------------------------------------- fused roll-up

def rule_rollup(df: DataFrame, catalog: Sequence[Rule], checks: dict[str, Check] = CHECKS) -> DataFrame:
    """Counts per rule, without producing rows x rules.

    Rules on single cells become conditional counts in one map-side aggregate.  A UNIQUE rule counts its keys.
    """
    compiled = CompiledCatalog(df, catalog, checks)
    parts = [
        _rollup_block(df, compiled.cell[i:i + RULE_BLOCK]) for i in range(0, len(compiled.cell), RULE_BLOCK)
    ]
    if compiled.unique:
        types = column_types(df)
        keys = F.array(*[F.struct(F.lit(i + 1).alias("rule"), digest_key(rule.attribute, types[rule.attribute]).alias("key"))
                         for i, rule in enumerate(compiled.unique)])
        counts = rule_key_counts(df.select(F.inline(keys))).groupBy("rule").agg(
            F.sum("__copies").alias("total"), F.count_if(F.col("__copies") == 1).alias("passed"))
        parts.append(_rollup_lines(counts.selectExpr(
            "*", "total - passed as failed", "0L as warnings", "0L as not_applicable", "0L as errors"), compiled.unique))
    if compiled.single:
        parts.append(rollup_results(_single_lines(df.sparkSession, compiled.single)))
    if not parts:
        return empty_frame(df, ROLLUP_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


_COUNTS = ["total", "passed", "failed", "warnings", "not_applicable", "errors"]
_STATUS_COUNTS = {PASS: "passed", FAIL: "failed", WARNING: "warnings", NOT_APPLICABLE: "not_applicable",
                  ERROR: "errors"}


def _rollup_lines(counts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return _labelled(counts.where("total > 0"), rules, ROLLUP_LABELS, _COUNTS)


def _rollup_block(df: DataFrame, rules: list[tuple[Rule, Column]]) -> DataFrame:
    statuses = df.select(*[status.alias(f"s{i}") for i, (_, status) in enumerate(rules)])
    aggregates, lines = ["count(1) as total"], []
    for i, (rule, _) in enumerate(rules):
        possible = {PASS, violation(rule), NOT_APPLICABLE, ERROR}
        aggregates += [f"count_if(s{i} = '{status}') as {_STATUS_COUNTS[status]}_{i}" for status in possible]
        cells = [f"{name}_{i} as {name}" if status in possible else f"0L as {name}"
                 for status, name in _STATUS_COUNTS.items()]
        lines.append(f"struct({i + 1} as rule, total, {', '.join(cells)})")
    counts = statuses.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(lines)}))")
    return _rollup_lines(counts, [rule for rule, _ in rules])


def rollup_results(results: DataFrame) -> DataFrame:
    """The same counts from long results."""
    counts = [F.expr(f"count_if(status = '{status}') as {name}") for status, name in _STATUS_COUNTS.items()]
    return results.groupBy(*ROLLUP_LABELS).agg(F.count(F.lit(1)).alias("total"), *counts)
