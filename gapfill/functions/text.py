"""Text expressions: blanks, tokens, n-grams, term counts, value rendering."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns added by missingness injection; excluded wherever "all columns" is meant,
# so the true text never leaks into features or prompts.
AUX_COLUMNS = ("text_original", "text_is_missing", "text_missing_rate")

# Token for unknown values and fill constants.
UNKNOWN = "未知"
MISSING_TEXT = "[MISSING_TEXT]"
MISSING_SCREEN_TEXT = "[MISSING]"

# Python's str.strip() also removes the four information separators.
_STRIP = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"
_NON_SPACE = r"(?U)[^\s\x1C-\x1F]"


def _col(c: Column | str) -> Column:
    return F.col(quote(c)) if isinstance(c, str) else c


def quote(name: str) -> str:
    """Back-tick a column name (names such as ``factual?`` need it)."""
    return "`" + name.replace("`", "``") + "`"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(col: Column | str) -> Column:
    """Unicode-aware strip of leading and trailing whitespace."""
    return F.regexp_replace(_col(col), _STRIP, "")


def is_blank(col: Column | str) -> Column:
    """``null_or_blank``: null, empty or whitespace only. Stops at the first visible character."""
    c = _col(col)
    return c.isNull() | ~c.rlike(_NON_SPACE)


def is_null_like(col: Column | str, dtype: T.DataType) -> Column:
    """Null, and NaN for floating-point columns."""
    c = _col(col)
    return (c.isNull() | F.isnan(c)) if isinstance(dtype, (T.DoubleType, T.FloatType)) else c.isNull()


def fill_text(col: Column | str, value: str = MISSING_SCREEN_TEXT) -> Column:
    """Replace null text by a constant before vectorising."""
    return F.coalesce(_col(col), F.lit(value))


def rate_tag(rate: Column | float) -> Column:
    """Two-digit percentage tag of a missing rate: 0.05 -> '05' (rounded, not truncated)."""
    c = F.lit(float(rate)) if isinstance(rate, (int, float)) else rate
    pct = F.round(c * 100).cast("int").cast("string")
    return F.when(F.length(pct) < 2, F.lpad(pct, 2, "0")).otherwise(pct)


def rate_tag_of(rate: float) -> str:
    return f"{int(round(rate * 100)):02d}"


def tokens(col: Column | str, min_len: int = 1) -> Column:
    """Lower-cased word tokens of at least ``min_len`` letters, digits or underscores."""
    word = r"([\p{L}\p{N}_]+)" if min_len <= 1 else r"([\p{L}\p{N}_]{%d,})" % min_len
    found = F.regexp_extract_all(F.lower(_col(col)), F.lit(word), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def truncate_tokens(col: Column | str, n: int = 256, min_len: int = 1) -> Column:
    """The first ``n`` tokens."""
    return F.slice(tokens(col, min_len), 1, n)


def ngrams(col: Column | str, n: Sequence[int] = (1, 2), min_len: int = 1) -> Column:
    """All word n-grams with ``n[0] <= n <= n[1]`` of one row."""
    low, high = n[0], n[-1]

    def of_size(t: Column, size: int) -> Column:
        if size == 1:
            return t
        joined = F.transform(
            F.sequence(F.lit(1), F.size(t) - (size - 1)), lambda i: F.array_join(F.slice(t, i, size), " ")
        )
        return F.when(F.size(t) >= size, joined).otherwise(F.array().cast("array<string>"))

    def grams(t: Column) -> Column:
        parts = [of_size(t, size) for size in range(low, high + 1)]
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    return let(tokens(col, min_len), grams)


def term_counts(terms: Column) -> Column:
    """``array<struct<term, tf>>`` of one row's terms: sort, then run lengths; no shuffle."""

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda p, j: F.struct(
                    F.get(s, p).alias("term"),
                    (F.coalesce(F.get(st, j + 1), F.size(s)) - p).alias("tf"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<term:string,tf:int>>")
    return let(F.array_sort(terms), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(empty))


def render_value(col: Column | str, dtype: T.DataType, unknown: str = UNKNOWN) -> Column:
    """A value as prompt text: unknown token for missing, ``%.3f`` floats, ISO timestamps."""
    c = _col(col)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(is_null_like(c, dtype), F.lit(unknown)).otherwise(F.format_string("%.3f", c))
    if isinstance(dtype, T.BooleanType):
        return F.when(c.isNull(), F.lit(unknown)).when(c, F.lit("True")).otherwise(F.lit("False"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(c, "SSSSSS")
        iso = F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))
        return F.when(c.isNull(), F.lit(unknown)).otherwise(iso)
    text = c.cast("string")
    return F.when(is_blank(text), F.lit(unknown)).otherwise(text)


def context_columns(df: DataFrame, text: str, exclude: Sequence[str] = AUX_COLUMNS) -> list[str]:
    """Every column but the text and the excluded ones, in table order."""
    dropped = {text, *exclude}
    return [c for c in df.columns if c not in dropped]


def metadata_text(
    df: DataFrame, text: str, exclude: Sequence[str] = AUX_COLUMNS, unknown: str = UNKNOWN
) -> Column:
    """``column: value`` pairs of a row joined by blanks."""
    parts = [
        F.concat(F.lit(f"{c}: "), render_value(c, df.schema[c].dataType, unknown))
        for c in context_columns(df, text, exclude)
    ]
    return F.concat_ws(" ", *parts)


def row_payload(
    df: DataFrame,
    text: str,
    include_text: bool = False,
    exclude: Sequence[str] = AUX_COLUMNS,
    unknown: str = UNKNOWN,
) -> Column:
    """A row as JSON: numbers stay numbers (NaN -> null), everything else is rendered text."""
    fields = []
    for field in df.schema:
        if field.name in exclude and field.name != text:
            continue
        c = _col(field.name)
        if field.name == text:
            value = c if include_text else F.lit(None).cast("string")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = F.nanvl(c, F.lit(None).cast("double"))
        elif isinstance(field.dataType, (T.NumericType, T.BooleanType)):
            value = c
        else:
            value = render_value(c, field.dataType, unknown)
        fields.append(value.alias(field.name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def label_lookup(col: Column | str, mapping: Mapping[str, str]) -> Column:
    """Display label of a key; keys without a label stay as they are."""
    c = _col(col)
    if not mapping:
        return c
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[c], c)
