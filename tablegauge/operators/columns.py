"""One aggregate per column, returned as one row per column.

All columns are aggregated side by side in a single pass (``min, max, count_if ...`` over the wide row), and
the one-row result is turned into a long table afterwards.  The input is never unpivoted, so there is no
shuffle of data: each task sends one partial row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablegauge.functions.missing import literal

# Columns aggregated together.  Wider tables are split into blocks, because generated code has a size limit;
# each block reads its own columns only.
COLUMN_BLOCK = 48

# From a column's name and type to an aggregate, as SQL text.
Metric = Callable[[str, T.DataType], str]

ROWS: Metric = lambda name, dtype: "count(1)"


def column_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def empty_frame(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def name_lines(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """A table ``(column)`` of given names."""
    return df.sparkSession.range(1).selectExpr(f"explode(array({', '.join(map(literal, names))})) as column")


def name_at(names: Sequence[str], position: str) -> str:
    """The name at a 1-based position.  Stacked values carry the position; it is much smaller than a name."""
    return f"element_at(array({', '.join(map(literal, names))}), {position})"


def per_column(df: DataFrame, columns: Sequence[str], metrics: dict[str, Metric], schema: str,
               block: int = COLUMN_BLOCK) -> DataFrame:
    """``(column, <metrics>)`` with one row per entry of ``columns``; ``metrics`` maps names to aggregates."""
    if not columns:
        return empty_frame(df, schema)
    types = column_types(df)
    blocks = [columns[i:i + block] for i in range(0, len(columns), block)]
    return reduce(DataFrame.unionByName, (_one_block(df, block, types, metrics) for block in blocks))


def _one_block(df: DataFrame, columns: Sequence[str], types: dict[str, T.DataType],
               metrics: dict[str, Metric]) -> DataFrame:
    aggregates, rows = [], []
    for i, name in enumerate(columns):
        aggregates += [f"{build(name, types[name])} as {metric}_{i}" for metric, build in metrics.items()]
        cells = [f"{literal(name)} as column", *[f"{metric}_{i} as {metric}" for metric in metrics]]
        rows.append(f"struct({', '.join(cells)})")
    return df.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(rows)}))")
