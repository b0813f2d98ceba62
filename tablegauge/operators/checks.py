"""Rule types compiled to column expressions.

A check turns an attribute and the rule's parameter into a boolean expression per row: true (satisfied), false
(violated) or NULL (does not apply).  All checks of a catalogue are evaluated in the same projection, inside
generated code.  New rule types are added to a copy of `CHECKS`; a check may return SQL text or any Column, so a
pandas UDF works as well, and the text ``ERROR`` instead of a boolean where it cannot be executed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from tablegauge.functions.missing import is_numeric, literal, missing, number, number_literal, quoted
from tablegauge.functions.text import cell_text, matches_from_start, parse_number
from tablegauge.operators.catalog import Rule

# Outcome statuses.
PASS, FAIL, WARNING, NOT_APPLICABLE, ERROR = "PASS", "FAIL", "WARNING", "NOT_APPLICABLE", "ERROR"

UNIQUE = "UNIQUE"


class BadParameter(ValueError):
    """The rule cannot be executed; it yields one ERROR line instead of results per row."""


@dataclass(frozen=True)
class Cell:
    """The attribute a rule looks at, as SQL text and as a Column."""

    name: str
    dtype: T.DataType

    @property
    def column(self) -> Column:
        return quoted(self.name)

    @property
    def missing(self) -> str:
        return missing(self.name, self.dtype)

    @property
    def text(self) -> str:
        return cell_text(self.name, self.dtype)

    @property
    def number(self) -> str:
        """The value as DOUBLE; NULL where it is missing or not a number."""
        if is_numeric(self.dtype) or isinstance(self.dtype, T.BooleanType):
            return number(self.name, self.dtype)
        if isinstance(self.dtype, T.StringType):
            return parse_number(self.text)
        return "double(null)"                            # dates, arrays ... are never numbers


Check = Callable[[Cell, Rule], "str | Column"]


def _if_present(cell: Cell, test: str) -> str:
    return f"case when not {cell.missing} then {test} end"


def not_null(cell: Cell, rule: Rule) -> str:
    return rf"not {cell.missing} and {cell.text} rlike r'(?U)\S'"


def regex(cell: Cell, rule: Rule) -> str:
    if rule.parameter is None:
        raise BadParameter("REGEX needs a pattern")
    return _if_present(cell, matches_from_start(cell.text, rule.parameter))


def length(cell: Cell, rule: Rule) -> str:
    low, high = _bounds(rule)
    size = f"char_length({cell.text})"
    tests = [f"{size} >= {number_literal(low)}"] if low is not None else []
    tests += [f"{size} <= {number_literal(high)}"] if high is not None else []
    return _if_present(cell, " and ".join(tests) or "true")


def value_range(cell: Cell, rule: Rule) -> str:
    # Both bounds are always present: NaN sorts above infinity, so the text "nan" violates an open range too.
    low, high = _bounds(rule)
    low = float("-inf") if low is None else low
    high = float("inf") if high is None else high
    return _if_present(cell, f"{cell.number} between {number_literal(low)} and {number_literal(high)}")


def enum(cell: Cell, rule: Rule) -> str:
    allowed = rule.parsed
    if not isinstance(allowed, list):
        raise BadParameter("ENUM needs a list")
    texts = [literal(x) for x in allowed if isinstance(x, str)]
    return _if_present(cell, f"{cell.text} in ({', '.join(texts)})" if texts else "false")


def not_repeated_digits(cell: Cell, rule: Rule) -> str:
    digits = rf"regexp_replace({cell.text}, r'(?U)\D', '')"
    return (f"case when not {cell.missing} and {digits} <> '' "
            f"then replace({digits}, substring({digits}, 1, 1), '') <> '' end")


CHECKS: dict[str, Check] = {
    "NOT_NULL": not_null,
    "REGEX": regex,
    "LENGTH": length,
    "RANGE": value_range,
    "ENUM": enum,
    "NOT_REPEATED_DIGITS": not_repeated_digits,
    # UNIQUE looks at the whole column; see operators.uniqueness.
}


def _bounds(rule: Rule) -> tuple[float | None, float | None]:
    given = rule.parsed
    if not isinstance(given, dict):
        raise BadParameter(f"{rule.rule_type} needs an object with min and max")
    for key in ("min", "max"):
        if key in given and (isinstance(given[key], bool) or not isinstance(given[key], (int, float))):
            raise BadParameter(f"{rule.rule_type}: {key} is not a number")
    return given.get("min"), given.get("max")


def violation(rule: Rule) -> str:
    """The status of a violated rule; only WARNING severity softens it, and not for UNIQUE."""
    return WARNING if rule.severity == WARNING and rule.rule_type != UNIQUE else FAIL


def status_of(cell: Cell, rule: Rule, checks: dict[str, Check] = CHECKS) -> Column:
    """The status of ``rule`` for every row."""
    outcome = checks[rule.rule_type](cell, rule)
    if checks[rule.rule_type] not in CHECKS.values():
        # A check of one's own may return booleans, or the text ERROR for a value it cannot be executed on.
        said = (outcome if isinstance(outcome, Column) else F.expr(outcome)).cast("string")
        return (F.when(said == "true", PASS).when(said == "false", violation(rule)).when(said == ERROR, ERROR)
                .otherwise(NOT_APPLICABLE))
    # A range cannot be checked on a present value that is not a number.  Satisfied rows are decided first, so
    # that their number is parsed once.
    failed = (f"when not {cell.missing} and {cell.number} is null then '{ERROR}'"
              if checks[rule.rule_type] is value_range else "")
    return F.expr(f"case when {outcome} then '{PASS}' {failed} when not ({outcome}) then '{violation(rule)}' "
                  f"else '{NOT_APPLICABLE}' end")
