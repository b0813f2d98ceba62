"""SQL twins of the registered queries, for another engine on the same tables."""

from __future__ import annotations

from tablegauge.operators.catalog import CUSTOMER_RULES
from tablegauge.registry import inputs as i
from tablegauge.registry.queries import (
    DOLLAR_REGION, FIRST_RULES, HEALTH_THRESHOLD, MISSING_ATTRIBUTE, ORDER_RULES, OWN_CHECK, SAMPLE_ROWS, UNIQUE_TEXT,
    UNKNOWN_TYPE, WORST,
)
from tablegauge.sources.inference import FALSE_TOKENS, MISSING_TOKENS, TRUE_TOKENS

CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
CHANGED_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_phone"]
LINEITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax"]
LINEITEM_COLUMNS = LINEITEM_NUMBERS + ["l_returnflag", "l_linestatus", "l_shipdate"]
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
DIRTY_NUMBERS = ["customer_id", "acctbal"]
CUSTOMER_NUMBERS = ["c_custkey", "c_nationkey", "c_acctbal"]
DIRTY_TYPES = ", ".join(f"('{c}', '{t}')" for c, t in zip(
    i.DIRTY_COLUMNS, ["bigint", "string", "string", "string", "string", "string", "double"]))
WIDE_NUMBERS = DIRTY_NUMBERS + [f"m{k}" for k in range(16)]

DIRTY = ("base AS (" + i.DIRTY_BASE.format(customer="customer") + "), dirty AS ("
         + i.DIRTY.format(base="base") + ")")
WIDE = DIRTY + ", wide AS (" + i.WIDE.format(dirty="dirty") + ")"
CHANGED = "changed AS (" + i.CHANGED_CUSTOMER.format(customer="customer") + ")"
RUNS = "runs AS (" + i.RUNS.format(events="events") + ")"
METRICS = "metrics AS (" + i.METRICS.format(events="events") + ")"
SNAPSHOTS = "snapshots AS (" + i.SNAPSHOTS.format(events="events") + ")"
MIXED_PROPS = "mixed AS (" + i.MIXED_PROPS.format(events="events") + ")"
SCHEMA_COLUMNS = "cols AS (" + i.SCHEMA_COLUMNS.format(events="events") + ")"
COLUMN_HISTORY = "history AS (" + i.COLUMN_HISTORY.format(events="events") + ")"
PART_RULES = "rules AS (" + i.PART_RULES.format(part="part") + ")"


def text(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else "'" + value.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def rounded(x: str, digits: int) -> str:
    return f"(round_even(CAST({x} AS DOUBLE) * 1e{digits}, 0) / 1e{digits})"


def pct(part: str, whole: str) -> str:
    return rounded(f"CAST({part} AS DOUBLE) / NULLIF(CAST({whole} AS DOUBLE), 0) * 1e2", 2)


def union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


# ---------------------------------------------------------------- sources

def missing_tokens() -> str:
    cells = ", ".join(
        c if c in DIRTY_NUMBERS else f"CASE WHEN {c} IN {listed(MISSING_TOKENS)} THEN NULL ELSE {c} END AS {c}"
        for c in i.DIRTY_COLUMNS)
    return f"WITH {DIRTY} SELECT {cells} FROM dirty"


def inferred(table: str, columns: list[str]) -> str:
    """(column, dtype) of a table read as text."""
    number = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])"
    parts = []
    for c in columns:
        value = f"(SELECT NULLIF(CAST({c} AS VARCHAR), '') AS v0 FROM {table})"
        clean = f"(SELECT CASE WHEN v0 IN {listed(MISSING_TOKENS)} THEN NULL ELSE v0 END AS v FROM {value} x)"
        parts.append(f"""
SELECT '{c}' AS "column", CASE WHEN count(v) = 0 THEN 'double'
  WHEN count(*) FILTER (WHERE v IS NOT NULL AND NOT (regexp_full_match(trim(v), '[+-]?[0-9]+')
       AND TRY_CAST(trim(v) AS BIGINT) IS NOT NULL)) = 0 THEN 'bigint'
  WHEN count(*) FILTER (WHERE NOT regexp_full_match(trim(v), '{number}')) = 0 THEN 'double'
  WHEN count(*) FILTER (WHERE v NOT IN {listed(TRUE_TOKENS + FALSE_TOKENS)}) = 0 THEN 'boolean'
  ELSE 'string' END AS dtype FROM {clean} y""")
    return union(parts)


def summary(table: str, columns: list[str], numbers: list[str]) -> str:
    size = " + ".join(
        f"COALESCE(sum(CASE WHEN {c} IS NOT NULL THEN 8 ELSE 0 END), 0)" if c in numbers
        else f"COALESCE(sum(strlen({c})), 0)" for c in columns)
    return (f"SELECT count(*) AS row_count, CAST({len(columns)} AS INT) AS column_count, "
            f"{rounded(f'CAST({size} AS DOUBLE) / 1048576.0', 2)} AS memory_usage_mb, "
            f"'{','.join(columns)}' AS columns FROM {table}")


def schemas() -> str:
    return (f"{CHANGED}, old AS ({inferred('customer', CUSTOMER_COLUMNS)}), "
            f"new AS ({inferred('changed', CHANGED_COLUMNS)})")


def fingerprint() -> str:
    pair = """'"' || "column" || '": "' || dtype || '"'"""
    return f"""WITH {DIRTY}, {schemas()}, seen AS ({inferred('dirty', i.DIRTY_COLUMNS)}),
 every AS (SELECT 'before' AS dataset, * FROM old UNION ALL SELECT 'after', * FROM new
           UNION ALL SELECT 'dirty', * FROM seen)
SELECT dataset, substring(sha256('{{' || string_agg({pair}, ', ' ORDER BY "column") || '}}'), 1, 12) AS dataset_id
FROM every GROUP BY dataset"""


COMPARED = """ differences AS (
 SELECT CASE WHEN o."column" IS NULL THEN 'added' WHEN n."column" IS NULL THEN 'removed' ELSE 'type_changed' END
   AS change, COALESCE(o."column", n."column") AS "column", o.dtype AS old_type, n.dtype AS new_type
 FROM old o FULL OUTER JOIN new n ON o."column" = n."column"
 WHERE o.dtype IS DISTINCT FROM n.dtype)"""


# ---------------------------------------------------------------- rules

def outcome(rule_id: str) -> str:
    """The status of a customer rule as an expression over `dirty`."""
    _, _, _, attribute, kind, _, severity, *_ = next(r for r in CUSTOMER_RULES if r[0] == rule_id)
    bad = "'WARNING'" if severity == "WARNING" and kind != "UNIQUE" else "'FAIL'"
    a, digits = attribute, f"regexp_replace({attribute}, '[^0-9]', '', 'g')"
    number = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
    passed = {
        "NOT_NULL": f"{a} IS NOT NULL AND trim(CAST({a} AS VARCHAR)) <> ''",
        "UNIQUE": f"count(*) OVER (PARTITION BY {a}) = 1",
        "REGEX": (r"regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$')" if a == "email"
                  else r"regexp_matches(phone, '^\+?[0-9]{7,15}$')"),
        "LENGTH": f"length({a}) BETWEEN 2 AND 100",
        "RANGE": f"TRY_CAST({a} AS DOUBLE) BETWEEN 0 AND 120",
        "ENUM": f"{a} IN ('North', 'South', 'East', 'West')",
        "NOT_REPEATED_DIGITS": f"replace({digits}, substring({digits}, 1, 1), '') <> ''",
    }[kind]
    applies = {
        "NOT_NULL": "TRUE", "UNIQUE": "TRUE", "NOT_REPEATED_DIGITS": f"{digits} <> ''",
    }.get(kind, f"{a} IS NOT NULL")
    error = (f"WHEN {a} IS NOT NULL AND NOT regexp_full_match(trim({a}), '{number}') THEN 'ERROR'"
             if kind == "RANGE" else "")
    return (f"CASE {error} WHEN NOT COALESCE({applies}, FALSE) THEN 'NOT_APPLICABLE' "
            f"WHEN {passed} THEN 'PASS' ELSE {bad} END")


def labels(rule) -> str:
    return ", ".join(f"{text(getattr(rule, name))} AS {name}"
                     for name in ("rule_id", "rule_name", "dimension", "attribute", "severity"))


def rule_lines(*types: str) -> str:
    """Long results of the customer rules of the given types over `dirty`."""
    parts = []
    for rule_id, dimension, name, attribute, kind, _, severity, *_ in CUSTOMER_RULES:
        if types and kind not in types:
            continue
        parts.append(f"""
SELECT CAST(customer_id AS VARCHAR) AS row_index, CAST(customer_id AS VARCHAR) AS record_id,
 {text(rule_id)} AS rule_id, {text(name)} AS rule_name, {text(dimension)} AS dimension,
 {text(attribute)} AS attribute, {text(severity)} AS severity, {outcome(rule_id)} AS status,
 CAST({attribute} AS VARCHAR) AS value FROM dirty""")
    return union(parts)


def single_line(rule, status: str) -> str:
    return (f"\nSELECT NULL, NULL, {text(rule.rule_id)}, {text(rule.rule_name)}, {text(rule.dimension)}, "
            f"{text(rule.attribute)}, {text(rule.severity)}, '{status}', NULL")


RESULTS = f"WITH {DIRTY}, results AS ({rule_lines()})"
EXCEPTIONS = ("SELECT record_id, rule_id, rule_name, attribute, value, severity, status FROM results "
              "WHERE status IN ('FAIL', 'WARNING', 'ERROR')")


def count_status(status: str) -> str:
    return f"count(*) FILTER (WHERE status = '{status}')"


ROLLUP = f"""SELECT rule_id, rule_name, dimension, severity, count(*) AS total,
 {count_status('PASS')} AS passed, {count_status('FAIL')} AS failed, {count_status('WARNING')} AS warnings,
 {count_status('NOT_APPLICABLE')} AS not_applicable, {count_status('ERROR')} AS errors
FROM results GROUP BY rule_id, rule_name, dimension, severity"""


def order_results() -> str:
    """Long results of the order rules; the columns have no missing values."""
    passed = {
        "ORD-001": "o_orderkey IS NOT NULL", "ORD-002": "count(*) OVER (PARTITION BY o_orderkey) = 1",
        "ORD-003": "count(*) OVER (PARTITION BY o_custkey) = 1", "ORD-004": "o_totalprice BETWEEN 1000 AND 400000",
        "ORD-005": "o_orderstatus IN ('F', 'O')", "ORD-006": "regexp_matches(o_orderpriority, '^[1-4]-[A-Z]+$')",
    }
    parts = []
    for rule in ORDER_RULES:
        bad = "WARNING" if rule.severity == "WARNING" and rule.rule_type != "UNIQUE" else "FAIL"
        parts.append(f"""
SELECT CAST(o_orderkey AS VARCHAR) AS record_id, {text(rule.rule_id)} AS rule_id, {text(rule.rule_name)} AS rule_name,
 {text(rule.dimension)} AS dimension, {text(rule.attribute)} AS attribute, {text(rule.severity)} AS severity,
 CASE WHEN {passed[rule.rule_id]} THEN 'PASS' ELSE '{bad}' END AS status, CAST({rule.attribute} AS VARCHAR) AS value
FROM orders""")
    return f"WITH results AS ({union(parts)})"


DIMENSIONS = f"""{RESULTS} SELECT dimension,
 COALESCE({pct(count_status('PASS'), f"count(*) - {count_status('NOT_APPLICABLE')}")}, 100.0) AS pass_rate_pct,
 count(*) AS total_checks, {count_status('FAIL')} AS failed, {count_status('WARNING')} AS warnings
FROM results GROUP BY dimension ORDER BY dimension"""


# ---------------------------------------------------------------- profile

def nulls(table: str, columns: list[str]) -> str:
    return union([
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS null_count, {pct(f'count(*) - count({c})', 'count(*)')}
 AS null_pct FROM {table}""" for c in columns])


def duplicates(table: str, columns: list[str]) -> str:
    repeated = f"(SELECT count(*) AS n FROM {table}), d AS (SELECT count(*) AS m FROM (SELECT DISTINCT " \
               f"{', '.join(columns)} FROM {table}) x)"
    return f"a AS {repeated} SELECT n - m AS duplicate_rows, COALESCE({pct('n - m', 'n')}, 0.0) AS duplicate_pct FROM a, d"


def cardinality(table: str, columns: list[str]) -> str:
    return union([
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count,
 {rounded(f'CAST(count(DISTINCT {c}) AS DOUBLE) / CAST(count(*) AS DOUBLE)', 4)} AS unique_ratio FROM {table}"""
        for c in columns])


def statistics(table: str, columns: list[str]) -> str:
    return union([
        f"""SELECT '{c}' AS "column", {rounded(f'avg({c})', 4)} AS mean, {rounded(f'stddev_samp({c})', 4)} AS std,
 {rounded(f'min({c})', 4)} AS "min", {rounded(f'max({c})', 4)} AS "max",
 {rounded(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)', 4)} AS median FROM {table}""" for c in columns])


def outliers(table: str, columns: list[str], method: str = "iqr") -> str:
    parts = []
    for c in columns:
        if method == "iqr":
            limits = (f"SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a, "
                      f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS b FROM {table}")
            test = f"{c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)"
        else:
            limits = f"SELECT avg({c}) AS a, stddev_pop({c}) AS b FROM {table}"
            test = f"abs(({c} - a) / NULLIF(b, 0)) > 3"
        hits = f"count(*) FILTER (WHERE {test})"
        parts.append(f"""SELECT '{c}' AS "column", {hits} AS outlier_count, {pct(hits, f'count({c})')} AS outlier_pct
 FROM {table}, ({limits}) lim HAVING count({c}) > 0""")
    return union(parts)


def health(table: str, columns: list[str], numbers: list[str]) -> str:
    return f"""nulls AS ({nulls(table, columns)}), outliers AS ({outliers(table, numbers)}),
 health AS (SELECT n."column", {rounded("greatest(100 - (n.null_pct * 0.7e0 + COALESCE(o.outlier_pct, 0) * 0.3e0), 0)", 2)}
   AS health_score, n.null_pct, COALESCE(o.outlier_pct, 0.0) AS outlier_pct
  FROM nulls n LEFT JOIN outliers o ON n."column" = o."column")"""


def completeness(table: str, columns: list[str]) -> str:
    filled = " + ".join(f"count({c})" for c in columns)
    return f"SELECT COALESCE({pct(filled, f'count(*) * {len(columns)}')}, 0.0) AS completeness_pct FROM {table}"


def full_profile(table: str, columns: list[str], numbers: list[str]) -> str:
    extremes = union([
        f"""SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS "min", CAST(max({c}) AS DOUBLE) AS "max",
 quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median FROM {table}""" for c in numbers])
    return f"""{health(table, columns, numbers)}, counts AS ({cardinality(table, columns)}), extremes AS ({extremes})
SELECT h."column", n.null_count, h.null_pct, c.unique_count, c.unique_ratio, o.outlier_count, o.outlier_pct,
 e."min", e."max", e.median, h.health_score
FROM health h JOIN nulls n ON h."column" = n."column" JOIN counts c ON h."column" = c."column"
LEFT JOIN outliers o ON h."column" = o."column" LEFT JOIN extremes e ON h."column" = e."column" """


# ---------------------------------------------------------------- drift

def ks(table: str, is_old: str, columns: list[str]) -> str:
    cells = union([f"SELECT '{c}' AS c, CAST({c} AS DOUBLE) AS v, CASE WHEN {is_old} THEN 1 ELSE 0 END AS o FROM {table}"
                   for c in columns])
    # Exact p-values by paths through the lattice, one anti-diagonal a step, while neither side has more than
    # 10,000 values; the limiting distribution beyond.
    return f"""WITH RECURSIVE cells AS ({cells}),
 counted AS (SELECT c, v, sum(o) AS a, sum(1 - o) AS b FROM cells WHERE v IS NOT NULL GROUP BY c, v),
 sizes AS (SELECT c, CAST(sum(a) AS DOUBLE) AS na, CAST(sum(b) AS DOUBLE) AS nb FROM counted GROUP BY c),
 summed AS (SELECT c, CAST(sum(a) OVER w AS DOUBLE) AS fa, CAST(sum(b) OVER w AS DOUBLE) AS fb
            FROM counted WINDOW w AS (PARTITION BY c ORDER BY v)),
 gaps AS (SELECT c, na, nb, max(abs(fa / na - fb / nb)) AS d, round_even(na * nb / (na + nb), 0) AS n
          FROM summed JOIN sizes USING (c) WHERE na >= 2 AND nb >= 2 GROUP BY c, na, nb),
 params AS (SELECT c, CAST(na AS BIGINT) AS n1, CAST(nb AS BIGINT) AS n2, CAST(round(d * na * nb) AS BIGINT) AS m
            FROM gaps WHERE greatest(na, nb) <= 10000),
 dp(c, s, lo, probs) AS (
   SELECT c, 0, 0, [1e0] FROM params
   UNION ALL
   SELECT dp.c, s + 1, greatest(0, s + 1 - n2), list_transform(range(greatest(0, s + 1 - n2), least(s + 1, n1) + 1),
     lambda i: CASE WHEN abs(i * n2 - (s + 1 - i) * n1) < m THEN
       coalesce(CASE WHEN i - 1 >= lo AND i - 1 < lo + len(probs) THEN probs[i - lo] * (n1 - i + 1) / (n1 + n2 - s) END, 0e0)
       + coalesce(CASE WHEN i >= lo AND i < lo + len(probs) THEN probs[i - lo + 1] * (n2 - s + i) / (n1 + n2 - s) END, 0e0)
       ELSE 0e0 END)
   FROM dp JOIN params USING (c) WHERE s < n1 + n2),
 exact AS (SELECT c, least(greatest(1e0 - probs[1], 0e0), 1e0) AS p FROM dp JOIN params USING (c) WHERE s = n1 + n2),
 scaled AS (SELECT c, na, nb, d, sqrt(n) * d + 1e0 / (6e0 * sqrt(n)) + (sqrt(n) * d - 1e0) / (4e0 * n) AS x FROM gaps),
 limiting AS (SELECT c, na, nb, d, CASE WHEN d <= 0 OR x < 0.2 THEN 1e0 ELSE least(greatest(list_sum(list_transform(
   range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2e0 ELSE -2e0 END) * exp(-2e0 * k * k * x * x))), 0e0), 1e0) END AS p
   FROM scaled),
 tested AS (SELECT l.c, na, nb, CASE WHEN d <= 0 THEN 1e0 ELSE coalesce(e.p, l.p) END AS p, d
            FROM limiting l LEFT JOIN exact e USING (c))
SELECT c AS "column", CAST(na AS BIGINT) AS n_old, CAST(nb AS BIGINT) AS n_new, {rounded('d', 4)} AS ks_statistic, {rounded('p', 4)} AS p_value, p < 0.05 AS drift_detected
FROM tested"""


# ---------------------------------------------------------------- forecasts

def trend(source: str, keys: str, value: str) -> str:
    return f"""points AS (SELECT {keys}, {value} AS y, row_number() OVER (PARTITION BY {keys} ORDER BY run_timestamp) - 1 AS x
  FROM {source} WHERE {value} IS NOT NULL),
 trends AS (SELECT {keys}, count(*) AS runs, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
  CAST(arg_max(y, x) AS DOUBLE) AS last_value FROM points GROUP BY {keys})"""


def predicted(steps: int) -> str:
    return f"CASE WHEN runs = 1 THEN last_value ELSE {rounded(f'intercept + slope * (runs - 1 + {steps})', 2)} END"


def run_forecast(value: str) -> str:
    return f"WITH {RUNS}, {trend('runs', 'dataset_name', value)} SELECT dataset_name, {predicted(1)} AS predicted FROM trends"


def oracles() -> dict[str, str]:
    q = '"column"'
    length_lines = rule_lines("LENGTH")
    return {
        "missing_tokens": missing_tokens(),
        "infer_types": f"WITH {DIRTY} {inferred('dirty', i.DIRTY_COLUMNS)}",
        "infer_types_lineitem": inferred("lineitem", LINEITEM_COLUMNS),
        "exact_sample": (f"SELECT * FROM orders ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), '-42')), o_orderkey "
                         f"LIMIT {SAMPLE_ROWS}"),
        "exact_sample_most": ("SELECT * FROM orders ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), '-42')), o_orderkey "
                              "LIMIT (SELECT CAST(count(*) AS BIGINT) * 3 // 5 FROM orders)"),
        "dataset_summary": f"WITH {DIRTY} {summary('dirty', i.DIRTY_COLUMNS, DIRTY_NUMBERS)}",
        "dataset_summary_documents": summary("documents", DOCUMENT_COLUMNS, ["doc_id", "n_chars"]),
        "schema_fingerprint": fingerprint(),
        "catalog_ordered": f"WITH {PART_RULES} SELECT * FROM rules ORDER BY COALESCE(priority, 999), ordinal",
        "catalog_first_n": (f"WITH {PART_RULES} SELECT * FROM (SELECT * FROM rules ORDER BY COALESCE(priority, 999), "
                            f"ordinal LIMIT {FIRST_RULES}) f WHERE COALESCE(enabled, TRUE)"),
        "catalog_enabled": f"WITH {PART_RULES} SELECT * FROM rules WHERE COALESCE(enabled, TRUE)",
        "rule_not_null": f"WITH {DIRTY} {rule_lines('NOT_NULL')}",
        "rule_unique": f"WITH {DIRTY} {rule_lines('UNIQUE')}",
        "rule_unique_documents": f"""SELECT CAST(doc_id AS VARCHAR) AS row_index, CAST(doc_id AS VARCHAR) AS record_id,
 {text(UNIQUE_TEXT.rule_id)} AS rule_id, {text(UNIQUE_TEXT.rule_name)} AS rule_name,
 {text(UNIQUE_TEXT.dimension)} AS dimension, 'text' AS attribute, 'ERROR' AS severity,
 CASE WHEN count(*) OVER (PARTITION BY text) = 1 THEN 'PASS' ELSE 'FAIL' END AS status, text AS value
FROM documents""",
        "rule_regex": f"WITH {DIRTY} {rule_lines('REGEX')}",
        "rule_length": f"WITH {DIRTY} {length_lines}",
        "rule_range": f"WITH {DIRTY} {rule_lines('RANGE')}",
        "rule_enum": f"WITH {DIRTY} {rule_lines('ENUM')}",
        "rule_not_repeated_digits": f"WITH {DIRTY} {rule_lines('NOT_REPEATED_DIGITS')}",
        "rule_results": f"{RESULTS} SELECT * FROM results",
        "rule_missing_column": (f"WITH {DIRTY} " + union([length_lines, single_line(MISSING_ATTRIBUTE, "NOT_APPLICABLE")])),
        "rule_enum_dollar": f"""WITH {DIRTY}, written AS (SELECT customer_id,
   CASE WHEN region = 'North' THEN '${{env:HOME}}' ELSE region END AS region FROM dirty)
SELECT CAST(customer_id AS VARCHAR) AS row_index, CAST(customer_id AS VARCHAR) AS record_id, {labels(DOLLAR_REGION)},
 CASE WHEN region IN ('${{env:HOME}}', 'South') THEN 'PASS' ELSE 'FAIL' END AS status, region AS value FROM written""",
        "rule_custom_error": f"""WITH {DIRTY}
SELECT CAST(customer_id AS VARCHAR) AS row_index, CAST(customer_id AS VARCHAR) AS record_id, {labels(OWN_CHECK)},
 CASE WHEN age IS NULL THEN 'NOT_APPLICABLE' WHEN TRY_CAST(age AS BIGINT) IS NULL THEN 'ERROR'
      WHEN TRY_CAST(age AS BIGINT) % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS status, age AS value FROM dirty""",
        "rule_unique_embeddings": """WITH twice AS (SELECT * FROM embeddings UNION ALL
   SELECT * FROM embeddings WHERE vec_id % 7 = 0),
 counted AS (SELECT vec_id, count(*) OVER (PARTITION BY embedding) AS n FROM twice)
SELECT count(*) AS violations, count(DISTINCT vec_id) AS records FROM counted WHERE n > 1""",
        "rule_results_lineitem": """WITH lines AS (
 SELECT l_orderkey, l_linenumber, CASE WHEN count(*) OVER (PARTITION BY l_partkey) > 1 THEN 1 ELSE 0 END
  + CASE WHEN l_quantity BETWEEN 1 AND 45 THEN 0 ELSE 1 END + CASE WHEN l_returnflag IN ('A', 'R') THEN 0 ELSE 1 END AS bad
 FROM lineitem)
SELECT CAST(sum(bad) AS BIGINT) AS violations, count(DISTINCT (l_orderkey, l_linenumber)) FILTER (WHERE bad > 0) AS records
FROM lines""",
        "rule_results_numbered": f"""{order_results()}, numbered AS (SELECT count(*) AS violations FROM ({EXCEPTIONS}) e),
 failing AS (SELECT DISTINCT record_id FROM ({EXCEPTIONS}) e)
SELECT violations, (SELECT count(*) FROM failing) AS records FROM numbered""",
        "summary_of_nothing": f"""{RESULTS}, dims AS ({DIMENSIONS.removeprefix(RESULTS)})
SELECT CAST(0 AS BIGINT) AS rules_executed, CAST(0 AS BIGINT) AS passed,
 CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS warnings, CAST(0 AS BIGINT) AS critical_issues,
 CAST(NULL AS BIGINT) AS violations, CAST(NULL AS BIGINT) AS records, CAST(NULL AS VARCHAR) AS dimension,
 CAST(NULL AS DOUBLE) AS pass_rate_pct, CAST(NULL AS BIGINT) AS total_checks, 'none' AS catalogue
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 0, 0, NULL, NULL, NULL, 'none'
UNION ALL SELECT count(DISTINCT rule_id), {count_status('PASS')}, {count_status('FAIL')}, {count_status('WARNING')},
 count(*) FILTER (WHERE status = 'FAIL' AND severity = 'CRITICAL'), NULL, NULL, NULL, NULL, NULL, 'customer' FROM results
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, count(*), count(DISTINCT record_id), NULL, NULL, NULL, 'customer'
 FROM ({EXCEPTIONS}) e
UNION ALL SELECT NULL, NULL, failed, warnings, NULL, NULL, NULL, dimension, pass_rate_pct, total_checks, 'customer'
 FROM dims""",
        "rule_unknown_type": f"WITH {DIRTY} " + union([length_lines, single_line(UNKNOWN_TYPE, "ERROR")]),
        "dimension_summary": DIMENSIONS,
        "exceptions": f"{RESULTS} {EXCEPTIONS} ORDER BY severity, rule_id, record_id",
        "overall_rule_score": f"""{RESULTS} SELECT count(DISTINCT rule_id) AS rules_executed,
 {count_status('PASS')} AS passed, {count_status('FAIL')} AS failed, {count_status('WARNING')} AS warnings,
 count(*) FILTER (WHERE status = 'FAIL' AND severity = 'CRITICAL') AS critical_issues FROM results""",
        "exception_totals": f"""{RESULTS} SELECT count(*) AS violations, count(DISTINCT record_id) AS records
FROM ({EXCEPTIONS}) e""",
        "rule_rollup_fused": f"{RESULTS} {ROLLUP}",
        "rule_rollup_orders": f"{order_results()} {ROLLUP}",
        "exceptions_orders": f"{order_results()} {EXCEPTIONS}",
        "null_analysis": f"WITH {DIRTY} {nulls('dirty', i.DIRTY_COLUMNS)}",
        "duplicate_rows": f"WITH {DIRTY}, {duplicates('dirty', i.DIRTY_COLUMNS)}",
        "duplicate_rows_lineitem": f"WITH {duplicates('lineitem', LINEITEM_COLUMNS)}",
        "duplicate_rows_embeddings": ("WITH twice AS (SELECT * FROM embeddings UNION ALL SELECT * FROM embeddings "
                                      f"WHERE vec_id % 7 = 0), {duplicates('twice', ['vec_id', 'embedding', 'label'])}"),
        "cardinality_embeddings": cardinality("embeddings", ["vec_id", "embedding", "label"]),
        "cardinality": f"WITH {DIRTY} {cardinality('dirty', i.DIRTY_COLUMNS)}",
        "cardinality_lineitem": cardinality("lineitem", LINEITEM_COLUMNS),
        "cardinality_documents": cardinality("documents", DOCUMENT_COLUMNS),
        "pattern_validation": f"""WITH {DIRTY}
SELECT 'email' AS {q}, 'email' AS pattern, {pct(
            "count(*) FILTER (WHERE regexp_matches(email, '^[^@" + chr(92) + "s]+@[^@" + chr(92) + "s]+[.][^@" + chr(92) + "s]+$'))",
            "count(email)")} AS match_pct FROM dirty
UNION ALL SELECT 'phone', 'phone', {pct(
            "count(*) FILTER (WHERE regexp_matches(phone, '^[+]?[0-9]{7,15}$'))", "count(phone)")} FROM dirty""",
        "statistical_profile": f"WITH {DIRTY} {statistics('dirty', DIRTY_NUMBERS)}",
        "statistical_profile_lineitem": statistics("lineitem", LINEITEM_NUMBERS),
        "outliers_iqr": f"WITH {DIRTY} {outliers('dirty', DIRTY_NUMBERS)}",
        "outliers_iqr_lineitem": outliers("lineitem", LINEITEM_NUMBERS),
        "outliers_iqr_documents": outliers("documents", ["doc_id", "n_chars"]),
        "outliers_zscore": f"WITH {DIRTY} {outliers('dirty', DIRTY_NUMBERS, 'zscore')}",
        "outliers_zscore_documents": outliers("documents", ["doc_id", "n_chars"], "zscore"),
        "outliers_zscore_infinite": """SELECT 'few' AS "column", CAST(0 AS BIGINT) AS outlier_count, 0.0e0 AS outlier_pct
FROM customer HAVING count(c_acctbal) > 0 UNION ALL SELECT 'many', 0, 0.0e0 FROM customer HAVING count(c_acctbal) > 0""",
        "outliers_iqr_infinite": f"""WITH x AS (
 SELECT CASE WHEN c_custkey % 100 = 1 THEN CAST('Infinity' AS DOUBLE) ELSE c_acctbal END AS few FROM customer)
{outliers('x', ['few'])} UNION ALL SELECT 'many', 0, 0.0e0 FROM customer HAVING count(*) > 0""",
        "overall_quality_empty": f"""WITH {health('customer', CUSTOMER_COLUMNS, CUSTOMER_NUMBERS)},
 filled AS ({completeness('customer', CUSTOMER_COLUMNS)}), {duplicates('customer', CUSTOMER_COLUMNS).replace(
            ' SELECT n - m', ', dup AS (SELECT n - m', 1)})
SELECT {rounded("f.completeness_pct * 0.4e0 + (100 - dup.duplicate_pct) * 0.2e0 + h.average * 0.4e0", 2)} AS quality_score,
 'all' AS "rows" FROM filled f, dup, (SELECT avg(health_score) AS average FROM health) h
UNION ALL SELECT CAST(NULL AS DOUBLE), 'none'""",
        "completeness": f"WITH {DIRTY} {completeness('dirty', i.DIRTY_COLUMNS)}",
        "column_health": (f"WITH {DIRTY}, {health('dirty', i.DIRTY_COLUMNS, DIRTY_NUMBERS)} "
                          f"SELECT {q}, health_score FROM health"),
        "overall_quality": f"""WITH {DIRTY}, {health('dirty', i.DIRTY_COLUMNS, DIRTY_NUMBERS)},
 filled AS ({completeness('dirty', i.DIRTY_COLUMNS)}), {duplicates('dirty', i.DIRTY_COLUMNS).replace(
            'd AS (', 'd AS (', 1).replace(' SELECT n - m', ', dup AS (SELECT n - m', 1)})
SELECT {rounded("f.completeness_pct * 0.4e0 + (100 - dup.duplicate_pct) * 0.2e0 + h.average * 0.4e0", 2)} AS quality_score
FROM filled f, dup, (SELECT avg(health_score) AS average FROM health) h""",
        "full_profile": f"WITH {DIRTY}, {full_profile('dirty', i.DIRTY_COLUMNS, DIRTY_NUMBERS)}",
        "distinct_over_deliveries": " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", (SELECT count(*) FROM orders) AS n_rows, true AS within_bound"
            for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")),
        "quantile_bounds_lineitem": " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", q.prob, (SELECT count({c}) FROM lineitem) AS n, true AS within_bound "
            "FROM (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) q(prob)" for c in LINEITEM_NUMBERS),
        "full_profile_lineitem": f"WITH {full_profile('lineitem', LINEITEM_COLUMNS, LINEITEM_NUMBERS)}",
        "schema_added": f"WITH {schemas()}, {COMPARED} SELECT {q} FROM differences WHERE change = 'added'",
        "schema_removed": f"WITH {schemas()}, {COMPARED} SELECT {q} FROM differences WHERE change = 'removed'",
        "schema_type_changes": (f"WITH {schemas()}, {COMPARED} SELECT {q}, old_type, new_type FROM differences "
                                f"WHERE change = 'type_changed'"),
        "schema_compare": f"WITH {schemas()}, {COMPARED} SELECT * FROM differences",
        "schema_has_changes": f"WITH {schemas()}, {COMPARED} SELECT count(*) > 0 AS has_changes FROM differences",
        "ks_drift": ks("events", "event_type = 'click'", ["event_id", "user_id", "value"]),
        "ks_drift_orders": ks("orders", "o_orderdate < TIMESTAMP '1996-01-01'",
                              ["o_orderkey", "o_custkey", "o_totalprice"]),
        "column_metrics": (f"WITH {DIRTY}, {health('dirty', i.DIRTY_COLUMNS, DIRTY_NUMBERS)} "
                           f"SELECT {q} AS column_name, null_pct, outlier_pct, health_score FROM health"),
        "run_line": f"""WITH {DIRTY}, {health('dirty', i.DIRTY_COLUMNS, DIRTY_NUMBERS)},
 filled AS ({completeness('dirty', i.DIRTY_COLUMNS)}), {duplicates('dirty', i.DIRTY_COLUMNS).replace(
            ' SELECT n - m', ', dup AS (SELECT n - m', 1)}),
 types("column", dtype) AS (VALUES {DIRTY_TYPES})
SELECT (SELECT count(*) FROM dirty) AS row_count, CAST({len(i.DIRTY_COLUMNS)} AS INT) AS column_count,
 {rounded("f.completeness_pct * 0.4e0 + (100 - dup.duplicate_pct) * 0.2e0 + h.average * 0.4e0", 2)} AS quality_score,
 f.completeness_pct, dup.duplicate_pct, h.nulls AS avg_null_pct,
 (SELECT substring(sha256('{{' || string_agg('"' || "column" || '": "' || dtype || '"', ', ' ORDER BY "column") || '}}'),
         1, 12) FROM types) AS dataset_id
FROM filled f, dup, (SELECT avg(health_score) AS average, {rounded('avg(null_pct)', 2)} AS nulls FROM health) h""",
        "snapshot_line": f"""WITH {DIRTY}, seen AS ({inferred('dirty', i.DIRTY_COLUMNS)}),
 line AS (SELECT '{{' || string_agg('"' || "column" || '": "' || dtype || '"', ', ' ORDER BY "column") || '}}' AS schema_json
          FROM seen)
SELECT 'customers' AS dataset_name, substring(sha256(schema_json), 1, 12) AS dataset_id, schema_json FROM line""",
        "run_history_by_id": (f"WITH {RUNS} SELECT * FROM runs WHERE dataset_id = (SELECT min(dataset_id) FROM runs)"),
        "run_history": f"WITH {RUNS} SELECT * FROM runs WHERE dataset_name = 'set-1' ORDER BY run_timestamp",
        "column_metric_history": f"""WITH {RUNS}, {METRICS}
SELECT r.run_timestamp, r.dataset_name, r.dataset_id, m.column_name, m.null_pct, m.outlier_pct, m.health_score
FROM metrics m JOIN runs r ON m.run_id = r.run_id ORDER BY r.run_timestamp""",
        "variant_kinds_events": f"""WITH {MIXED_PROPS},
j AS (SELECT props, json_valid(props) AS ok, CASE WHEN json_valid(props) THEN json_type(props) END AS t FROM mixed),
f AS (SELECT key, json_type(json_extract(props, '$."' || key || '"')) AS t
      FROM (SELECT props, unnest(json_keys(props)) AS key FROM j WHERE ok AND t = 'OBJECT')),
lines AS (SELECT '$' AS path, CASE WHEN props IS NULL THEN 'missing' WHEN NOT ok THEN 'invalid' ELSE t END AS t
          FROM j WHERE props IS NULL OR NOT ok OR t <> 'OBJECT'
          UNION ALL SELECT key, t FROM f)
SELECT path, CASE WHEN t IN ('missing', 'invalid') THEN t WHEN t IN ('UBIGINT', 'BIGINT') THEN 'integer'
                  WHEN t = 'DOUBLE' THEN 'number' WHEN t = 'VARCHAR' THEN 'string' ELSE lower(t) END AS kind,
       count(*) AS n_values FROM lines GROUP BY 1, 2""",
        "variant_nulls_events": f"""WITH {MIXED_PROPS},
v AS (SELECT event_id, CASE WHEN json_valid(props) THEN props END AS props FROM mixed),
t AS (SELECT event_id, json_extract_string(props, '$.k') AS k,
             TRY_CAST(json_extract(props, '$.v') AS BIGINT) AS v,
             TRY_CAST(json_extract(props, '$.e.code') AS INTEGER) AS code FROM v)
{nulls('t', ['event_id', 'k', 'v', 'code'])}""",
        "schema_change_log": f"""WITH {SCHEMA_COLUMNS},
s AS (SELECT dataset_name, snapshot_timestamp, CAST(row_number() OVER w AS INTEGER) AS version,
             lag(snapshot_timestamp) OVER w AS previous_timestamp
      FROM (SELECT DISTINCT dataset_name, snapshot_timestamp FROM cols)
      WINDOW w AS (PARTITION BY dataset_name ORDER BY snapshot_timestamp)),
k AS (SELECT DISTINCT s.*, c.column_name FROM s JOIN cols c ON c.dataset_name = s.dataset_name
        AND (c.snapshot_timestamp = s.snapshot_timestamp OR c.snapshot_timestamp = s.previous_timestamp)
      WHERE s.previous_timestamp IS NOT NULL),
j AS (SELECT k.*, o.dtype AS old_type, n.dtype AS new_type FROM k
      LEFT JOIN cols o ON o.dataset_name = k.dataset_name AND o.snapshot_timestamp = k.previous_timestamp
        AND o.column_name = k.column_name
      LEFT JOIN cols n ON n.dataset_name = k.dataset_name AND n.snapshot_timestamp = k.snapshot_timestamp
        AND n.column_name = k.column_name)
SELECT dataset_name, version, snapshot_timestamp, previous_timestamp,
       CASE WHEN old_type IS NULL THEN 'added' WHEN new_type IS NULL THEN 'removed' ELSE 'type_changed' END AS change,
       column_name AS "column", old_type, new_type
FROM j WHERE old_type IS DISTINCT FROM new_type""",
        "latest_schema": (f"WITH {SNAPSHOTS} SELECT dataset_name, arg_max(schema_json, snapshot_timestamp) AS schema_json "
                          f"FROM snapshots GROUP BY dataset_name"),
        "known_datasets": f"""WITH {RUNS} SELECT dataset_name, arg_max(dataset_label, run_timestamp) AS dataset_label,
 max(run_timestamp) AS last_run, count(*) AS run_count FROM runs GROUP BY dataset_name ORDER BY last_run DESC""",
        "trend_fit": f"""WITH {COLUMN_HISTORY}, {trend('history', 'column_name', 'health_score')}
SELECT column_name, runs, {rounded('slope', 6)} AS slope, {rounded('intercept', 6)} AS intercept, last_value FROM trends""",
        "forecast_next": (f"WITH {COLUMN_HISTORY}, {trend('history', 'column_name', 'health_score')} "
                          f"SELECT column_name, {predicted(3)} AS predicted FROM trends"),
        "forecast_quality": run_forecast("quality_score"),
        "forecast_duplicates": run_forecast("duplicate_pct"),
        "forecast_nulls": run_forecast("avg_null_pct"),
        "forecast_volume": run_forecast("row_count"),
        "columns_at_risk": f"""WITH {COLUMN_HISTORY}, {trend('history', 'column_name', 'health_score')}
SELECT column_name AS {q}, {rounded('last_value', 2)} AS current_health_score,
 {predicted(1)} AS predicted_next_health_score, {predicted(1)} < {HEALTH_THRESHOLD} AS at_risk FROM trends""",
        "worst_health": (f"WITH {WIDE}, {health('wide', i.WIDE_COLUMNS, WIDE_NUMBERS)} "
                         f"SELECT {q}, health_score FROM health ORDER BY health_score, {q} LIMIT {WORST}"),
        "worst_health_all": (f"WITH {WIDE}, {health('wide', i.WIDE_COLUMNS, WIDE_NUMBERS)} "
                             f"SELECT {q}, health_score FROM health"),
        "worst_nulls": (f"WITH {WIDE}, {health('wide', i.WIDE_COLUMNS, WIDE_NUMBERS)} "
                        f"SELECT * FROM nulls ORDER BY null_pct DESC, {q} LIMIT {WORST}"),
        "worst_outliers": (f"WITH {WIDE}, {health('wide', i.WIDE_COLUMNS, WIDE_NUMBERS)} "
                           f"SELECT * FROM outliers ORDER BY outlier_pct DESC, {q} LIMIT {WORST}"),
        "quality_trend": f"""WITH {RUNS} SELECT dataset_name, run_timestamp, quality_score FROM runs
WHERE dataset_name IN (SELECT dataset_name FROM runs GROUP BY dataset_name HAVING count(*) > 1)""",
        "dimension_profile": DIMENSIONS,
    }
