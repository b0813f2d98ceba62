"""Secret scan over an incremental ledger of content-addressed blobs.

Every historical version of a path is a blob, named by the SHA-256 of its text.  The ledger says which blobs were
scanned with which version of which rule.  A run scans only pairs of blob and rule version that the ledger lacks,
each blob once however many paths hold it, appends what it found, and joins the findings back to all paths.
DataFrame functions only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tablegauge.functions.missing import quoted
from tablegauge.llm.shared import new_folder


@dataclass(frozen=True)
class SecretRule:
    """Matches of ``pattern``, leftmost and not overlapping, whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        text = f"{self.kind}\n{self.pattern}\n{self.group}\n{self.least}"
        return f"{self.kind}:{hashlib.sha256(text.encode()).hexdigest()[:16]}"


def either_case(words: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in words)


# The base rules.  A run of hexadecimal digits (or of the letters after AKIA) that is too short holds no
# match that is long enough, so the least length stands in the pattern where it saves the many short matches.
BASE_RULES = (
    SecretRule("assign", "(" + either_case("password|passwd|secret|token|api_?key")
               + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", "AKIA[A-Z0-9]{16,}"),
    SecretRule("hex", "[0-9a-f]{24,}"),
)
MORE_RULES = (
    SecretRule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

SPAN = "struct<start:int,rank:int,kind:string,end:int,version:string>"
LEDGER = f"blob string, versions array<string>, spans array<{SPAN}>"


def _raw(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def spans_of(text: str, rule: SecretRule, rank: int) -> str:
    """All spans of one rule in a text (SQL): the pieces between the matches give the places of the matches."""
    pattern = _raw(rule.pattern)
    return f"""aggregate(
        arrays_zip(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0),
                   regexp_extract_all({text}, {pattern}, {rule.group})),
        named_struct('at', 0, 'spans', cast(array() as array<{SPAN}>)),
        (acc, x) -> named_struct(
            'at', acc.at + length(x['0']) + coalesce(length(x['1']), 0),
            'spans', if(length(x['2']) >= {rule.least},
                array_append(acc.spans, named_struct(
                    'start', acc.at + length(x['0']), 'rank', {rank}, 'kind', '{rule.kind}',
                    'end', acc.at + length(x['0']) + length(x['1']), 'version', '{rule.version}')),
                acc.spans)),
        acc -> acc.spans)"""


def findings(text: str, rules: tuple[SecretRule, ...], wanted: str) -> Column:
    """Spans of those rules whose version is in the array ``wanted``; a text without a match costs one search a rule."""
    empty = f"cast(array() as array<{SPAN}>)"
    parts = [f"case when array_contains({wanted}, '{rule.version}') and {text} rlike {_raw(rule.pattern)} "
             f"then {spans_of(text, rule, rank)} else {empty} end" for rank, rule in enumerate(rules)]
    return F.expr(f"array_sort(concat({', '.join(parts)}))")


def scan_secrets(versions: DataFrame, path_cols: list[str], text_col: str = "text", ledger: str | None = None,
                 rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Findings of every version of every path: the path columns, ``blob`` and ``spans``, a row for each input row.

    ``ledger`` is a Parquet folder that grows with each run (a new one below the shared folder if not given).  A null
    text is an empty text; null, repeated or tied paths keep their rows; other columns are ignored, whatever their
    names.  An empty table gives an empty result.  The rules of a run need different kinds.  One run at a time may
    write to a ledger.
    """
    spark = versions.sparkSession
    ledger = ledger or new_folder(spark, "secret-ledger")
    places = [F.col(f"p{i}") for i in range(len(path_cols))]
    paths = versions.select(*[quoted(c).alias(f"p{i}") for i, c in enumerate(path_cols)],
                            F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("body"))
    paths = paths.select("*", F.sha2("body", 256).alias("blob"), F.xxhash64(*places).alias("place"))
    current = F.array(*[F.lit(rule.version) for rule in rules])

    known = _read_ledger(spark, ledger)
    seen = known.select("blob", F.explode("versions").alias("version")).groupBy("blob").agg(
        F.collect_set("version").alias("seen"))
    unseen = (
        paths.groupBy("blob").agg(F.min("place").alias("place"))
        .join(seen, "blob", "left")
        .select("blob", "place", F.array_except(current, F.coalesce("seen", F.array().cast("array<string>")))
                .alias("versions"))
        .filter(F.size("versions") > 0)
    )
    new = (
        paths.select("blob", "place", "body").join(unseen, ["blob", "place"])
        .select("blob", "versions", findings("body", rules, "versions").alias("spans"))
        .dropDuplicates(["blob"])
    )
    new.write.mode("append").parquet(ledger)

    mine = F.filter("spans", lambda s: F.array_contains(current, s["version"]))
    found = (
        _read_ledger(spark, ledger).select("blob", mine.alias("spans")).filter(F.size("spans") > 0)
        .groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    )
    return paths.drop("body", "place").join(found, "blob", "left").select(
        *[p.alias(c) for p, c in zip(places, path_cols)], "blob",
        F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def _read_ledger(spark, ledger: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(ledger)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, id_cols: list[str], text_col: str = "text", ledger: str | None = None,
           rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """The same rows and columns, with every character of a secret's span masked by ``*``.

    Overlapping spans are masked once.  Rows are matched to their findings by blob, so repeated rows stay repeated.
    """
    found = (scan_secrets(docs, id_cols, text_col, ledger, rules)
             .filter(F.size("spans") > 0).groupBy(F.col("blob").alias("__blob")).agg(F.first("spans").alias("__spans")))
    body = quoted(text_col)
    masked = F.expr("""aggregate(__spans, named_struct('at', 0, 'out', ''),
        (acc, s) -> if(s.`end` <= acc.at, acc, named_struct('at', s.`end`, 'out', concat(
            acc.out, if(s.start > acc.at, substring(__text, acc.at + 1, s.start - acc.at), ''),
            repeat('*', s.`end` - greatest(s.start, acc.at))))),
        acc -> concat(acc.out, substring(__text, acc.at + 1)))""")
    keyed = docs.select("*", body.alias("__text"), F.sha2(F.coalesce(body.cast("string"), F.lit("")), 256).alias("__blob"))
    return keyed.join(found, "__blob", "left").select(
        *[F.when(F.col("__spans").isNull(), F.col("__text")).otherwise(masked).alias(c) if c == text_col else quoted(c)
          for c in docs.columns])
