"""Score expressions: order keys, label bins, severity levels, completion gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gapfill.functions.text import _col, strip

# Bin edges of the five label classes, severity thresholds and names,
# length limits and phrases of the completion gate.
LABEL_THRESHOLDS = (1.5, 2.5, 3.5, 4.5)
SEVERITY_THRESHOLDS = (1.5, 2.5, 3.5)
SEVERITY_LABELS = ("benign", "low", "medium", "high")
MIN_CHARS = 10
MAX_CHARS = 1200
DISALLOWED_PHRASES = ("unknown", "无法确定", "not provided", "missing information", "cannot infer")


def uniform(key: Column | str, seed: int) -> Column:
    """A reproducible uniform in (0, 1) from a row key: first 52 bits of a seeded MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), _col(key).cast("string")))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def weighted_order_key(key: Column | str, weight: Column | str, seed: int) -> Column:
    """Ascending order key of weighted sampling without replacement.

    ``u ** (1 / w)`` descending equals ``-ln(u) / w`` ascending, which cannot underflow.
    """
    return -F.log(uniform(key, seed)) / _col(weight)


def number(col: Column | str) -> Column:
    """Numeric value, null when it does not parse; NaN counts as null."""
    value = _col(col).try_cast("double")
    return F.nanvl(value, F.lit(None).cast("double"))


def at_least(col: Column | str, threshold: float) -> Column:
    """``value >= threshold``, false for null, NaN and text that is no number."""
    return F.coalesce(number(col) >= F.lit(float(threshold)), F.lit(False))


def label_bins(col: Column | str, thresholds: Sequence[float] = LABEL_THRESHOLDS, keep: bool = False) -> Column:
    """Class number of a score, bins closed on the left.

    Missing scores have no class; ``keep=True`` puts them in the top class instead.
    """
    value = number(col)
    total = F.lit(0)
    for t in sorted(thresholds):
        total = total + F.when(value >= F.lit(float(t)), 1).otherwise(0)
    missing = F.lit(len(thresholds)) if keep else F.lit(None).cast("int")
    return F.when(value.isNull(), missing).otherwise(total)


def severity_bucket(
    col: Column | str,
    thresholds: Sequence[float] = SEVERITY_THRESHOLDS,
    labels: Sequence[str] = SEVERITY_LABELS,
    unknown: str = "unknown",
) -> Column:
    """Severity level of a score by three rising thresholds."""
    value = number(col)
    level = F.when(value.isNull(), F.lit(unknown))
    for t, name in sorted(zip(thresholds, labels[1:]), reverse=True):
        level = level.when(value >= F.lit(float(t)), F.lit(name))
    return level.otherwise(F.lit(labels[0]))


def severity_guidance(col: Column | str, label: str, **kwargs) -> Column:
    """One line telling a provider which level the filled text should have."""
    score = F.coalesce(_col(col).cast("string"), F.lit("unknown"))
    return F.concat(F.lit(f"{label}="), score, F.lit(" -> expected level "), F.upper(severity_bucket(col, **kwargs)))


def extract_completion(col: Column | str, field: str = "text") -> Column:
    """Text of a provider answer.

    A JSON object with a string ``field`` gives that field; failing that, an object between the
    first ``{`` and the last ``}``; failing that, the raw answer. Empty answers give null.
    """
    raw = strip(col)
    path = f"$.{field}"

    def string_field(json: Column) -> Column:
        parsed = F.try_parse_json(json)
        kind = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
        return F.when(kind == "STRING", strip(F.try_variant_get(parsed, path, "string")))

    whole_ok = F.try_parse_json(raw).isNotNull()
    inner = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    value = F.when(whole_ok, F.coalesce(string_field(raw), raw)).otherwise(F.coalesce(string_field(inner), raw))
    return F.when(F.coalesce(_col(col), F.lit("")) == "", F.lit(None).cast("string")).otherwise(value)


def valid_completion(
    col: Column | str,
    min_chars: int = MIN_CHARS,
    max_chars: int = MAX_CHARS,
    disallowed: Sequence[str] = DISALLOWED_PHRASES,
) -> Column:
    """Length within limits after stripping and none of the phrases inside (case-insensitive)."""
    text = strip(col)
    lowered = F.lower(text)
    ok = F.length(text).between(min_chars, max_chars)
    for phrase in disallowed:
        ok = ok & ~lowered.contains(phrase.lower())
    return F.coalesce(ok, F.lit(False))


def lexicon_gate(col: Column | str, level: Column | str, high: Sequence[str], medium: Sequence[str]) -> Column:
    """Does the text match the severity level, judged by the lexicon terms it contains?

    The lexicons are the caller's; overlapping terms count separately.
    """
    lowered = F.lower(_col(col))

    def hits(terms: Sequence[str]) -> Column:
        total = F.lit(0)
        for term in dict.fromkeys(terms):
            total = total + F.when(lowered.contains(term.lower()), 1).otherwise(0)
        return total

    h, m, lvl = hits(high), hits(medium), _col(level)
    return (
        F.when(lvl == "high", h >= 1)
        .when(lvl == "medium", h + m >= 1)
        .when(lvl == "low", h <= 1)
        .when(lvl == "benign", (h == 0) & (m == 0))
        .otherwise(F.lit(True))
    )
