"""Text views of values: cell text, anchored patterns, number parsing, width-bounded grouping keys (SQL text)."""

from __future__ import annotations

from pyspark.sql import types as T

from tablegauge.functions.missing import ident, literal, value_or_null

# Regular expressions for the columns whose name suggests an e-mail address or a phone number.
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE_PATTERN = r"^\+?\d{7,15}$"

# Plain decimals with an optional exponent, or an infinity / not-a-number word, with blanks around.
# Type suffixes such as 1.0d, which a cast to DOUBLE would accept, are not numbers here.
_DECIMAL = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_INFINITY = r"[+-]?[iI][nN][fF](?:[iI][nN][iI][tT][yY])?"
_NAN = r"[+-]?[nN][aA][nN]"
NUMBER_TEXT = rf"\A\s*(?:{_DECIMAL}|{_INFINITY}|{_NAN})\s*\z"
NAN_TEXT = rf"\A\s*{_NAN}\s*\z"
INTEGER_TEXT = r"\A\s*[+-]?[0-9]+\s*\z"
_PLAIN_NUMBER = rf"\A\s*(?:{_DECIMAL}|{_INFINITY})\s*\z"
_NAN_ONLY = rf"\A{_NAN}\z"
# What needs a second look if it is not a plain number: digit separators, blanks outside ASCII, signed NaN.
_UNUSUAL_TEXT = r"_|[^\x00-\x7F]|[nN][aA][nN]"
_OUTER_BLANKS = r"(?U)\A\s+|\s+\z"

# A grouping key never gets wider than this many bytes, except for the digest that replaces longer values.
KEY_BYTES = 64

NESTED_TYPES = (T.ArrayType, T.StructType, T.MapType, T.VariantType)


def cell_text(name: str, dtype: T.DataType) -> str:
    """The text a rule sees; booleans read ``True`` / ``False``."""
    c = ident(name)
    if isinstance(dtype, T.BooleanType):
        return f"initcap(cast({c} as string))"
    if isinstance(dtype, NESTED_TYPES):
        return f"to_json({c})"
    return c if isinstance(dtype, T.StringType) else f"cast({c} as string)"


def matches_from_start(text: str, pattern: str) -> str:
    """Match anchored at the start only.

    ``(?U)`` makes ``\\d``, ``\\s`` and ``\\w`` Unicode-aware, ``(?d)`` makes ``\\n`` the only line end.
    """
    anchored = rf"(?Ud)\A(?:{pattern})"
    return f"({text} rlike {literal(anchored)})"


def parse_number(text: str) -> str:
    """Text to DOUBLE.  NULL when the text is not a number; underscores between digits are allowed."""
    plain = f"regexp_replace({text}, {literal('(?<=[0-9])_(?=[0-9])')}, '')"
    bare = f"regexp_replace({plain}, {literal(_OUTER_BLANKS)}, '')"
    return (f"(case when {text} rlike {literal(_PLAIN_NUMBER)} "
            f"then try_cast({text} as double) "
            f"when not {text} rlike {literal(_UNUSUAL_TEXT)} then null "
            f"when {bare} rlike {literal(_NAN_ONLY)} then double('NaN') "
            f"when {bare} rlike {literal(NUMBER_TEXT)} then try_cast({bare} as double) end)")


def compact_key(name: str, dtype: T.DataType) -> str:
    """A grouping key of bounded width that is equal exactly when the values are.

    Long text is replaced by the SHA-256 digest of the whole value before it is shuffled.  A digest key has
    65 bytes and no short value has, so the two kinds cannot be confused.
    """
    c = ident(name)
    if isinstance(dtype, NESTED_TYPES):
        return f"(case when {c} is not null then {_short_or_digest(encoded(c, dtype))} end)"
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return _short_or_digest(c)
    return value_or_null(name, dtype)


def _short_or_digest(value: str) -> str:
    return (f"(case when octet_length({value}) > {KEY_BYTES} then concat('#', sha2({value}, 256)) "
            f"else cast({value} as string) end)")


def encoded(value: str, dtype: T.DataType, depth: int = 0) -> str:
    """Text that is equal exactly when two values of one type are (SQL), never NULL.

    Texts carry their length, so that parts cannot run into each other; maps are in the order of their entries;
    both zeros are one value, and so are all NaNs; timestamps keep their microseconds.
    """
    x = f"x{depth}"
    if isinstance(dtype, T.ArrayType):
        body = f"array_join(transform({value}, {x} -> {encoded(x, dtype.elementType, depth + 1)}), '')"
        body = f"concat('[', {body}, ']')"
    elif isinstance(dtype, T.MapType):
        pair = f"concat({encoded(x + '.key', dtype.keyType, depth + 1)}, {encoded(x + '.value', dtype.valueType, depth + 1)})"
        body = f"concat('{{', array_join(array_sort(transform(map_entries({value}), {x} -> {pair})), ''), '}}')"
    elif isinstance(dtype, T.StructType):
        fields = [encoded(f"{value}.{ident(f.name)}", f.dataType, depth) for f in dtype.fields]
        body = f"concat('(', {', '.join([*fields, chr(39) + ')' + chr(39)])})"
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        body = f"concat(case when isnan({value}) then 'nan' when {value} = 0 then '0' else cast({value} as string) end, ';')"
    elif isinstance(dtype, T.TimestampType):
        body = f"concat(cast(unix_micros({value}) as string), ';')"
    elif isinstance(dtype, T.BinaryType):
        body = f"concat(hex({value}), ';')"
    else:
        text = f"to_json(struct({value}))" if isinstance(dtype, T.VariantType) else f"cast({value} as string)"
        body = f"concat(octet_length({text}), ':', {text})"
    return f"(case when {value} is null then '-' else {body} end)"
