"""Quality rules: base counts, and Jensen-Shannon distance of a document's histograms to its language's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfill.session import materialize

from .common import let

# Fixed by the contract.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
NOT_SYMBOL = r"[^#*$%&|<>]+"
MIN_WORDS = 50

#: The most frequent words of the languages, in lower case (fixed values).
COMMON_WORDS = (
    "the of and to in is that for it with on as "
    "der die und den von das mit sich nicht ein zu ist "
    "de la le et les des en un du une que est pour qui dans "
    "el y los del se las por con no para"
).split()
#: Character classes, as what a text keeps of each.
CHAR_CLASSES = {"lower": r"[^\p{Ll}]+", "upper": r"[^\p{Lu}]+", "digit": r"[^0-9]+", "stop": r"[^.,;:!?'\"()-]+", "symbol": NOT_SYMBOL}
#: Largest Jensen-Shannon distances (base 2, 0 to 1) of a kept document.
MAX_CHAR_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.27


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def repeat_words(w: Column) -> Column:
    """How many words lie in a window of three that the text has twice or more.

    Windows are sorted by hash, so equal ones are neighbours: n log n, whatever the text repeats.
    """

    def windows(wh: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(0), F.size(wh) - 3),
            lambda i: F.struct(F.xxhash64(F.get(wh, i), F.get(wh, i + 1), F.get(wh, i + 2)).alias("h"), i.alias("i")),
        )
        return let(F.sort_array(grams), twins)

    def twins(s: Column) -> Column:
        again = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        starts = F.transform(again, lambda x: x["i"])
        return let(starts, lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2)))))

    return F.when(F.size(w) < 4, 0).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), windows))


def features(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns``, ``lang`` (null: empty), the base counts and the raw histograms, in one pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*columns, F.coalesce(F.col("lang"), F.lit("")).alias("lang_"), text.alias("t_"), words(text).alias("w_"))
    count = {name: F.char_length(F.regexp_replace("t_", keep, "")) for name, keep in CHAR_CLASSES.items()}
    lines = F.filter(F.split("t_", "\n"), lambda x: x.rlike(NOT_SPACE))
    common = F.filter("w_", lambda x: x.isin(COMMON_WORDS))
    df = df.select(
        *columns,
        "lang_",
        F.size("w_").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("t_", SPACE, "")).cast("long").alias("word_chars"),
        *(c.cast("long").alias(f"c_{n}") for n, c in count.items()),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w_")).cast("long").alias("n_repeat_words"),
        let(common, lambda c: F.array(*(F.size(c) - F.size(F.array_remove(c, w)) for w in COMMON_WORDS))).alias("common"),
    )
    return df.withColumnRenamed("c_symbol", "n_symbols")


def _shares(df: DataFrame) -> DataFrame:
    """Histograms as shares: characters of words by class (the rest last), words by common word (the rest last)."""
    chars = [F.col(f"c_{n}") if n != "symbol" else F.col("n_symbols") for n in CHAR_CLASSES]
    rest = F.col("word_chars") - reduce(Column.__add__, chars)
    common = [F.get("common", F.lit(i)) for i in range(len(COMMON_WORDS))]
    other = F.col("n_words") - reduce(Column.__add__, common)
    return df.withColumns(
        {
            "p_char": F.array(*(F.try_divide(c, "word_chars") for c in (*chars, rest))),
            "p_word": F.array(*(F.try_divide(c, "n_words") for c in (*common, other))),
        }
    )


def _entropy_gap(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance: the root of the mean divergence from the middle, base 2."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def judge(
    docs: DataFrame,
    max_char: float = MAX_CHAR_DISTANCE,
    max_word: float = MAX_WORD_DISTANCE,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """Base counts and verdict for every row of ``docs`` (``doc_id, text, lang``).

    A language's reference is the mean of the shares of all its documents of at least ``min_words`` words,
    so a huge document counts once. ``base_failed`` documents are never kept. Shorter ones than ``min_words``
    are not measured (distance null); nor are those whose language has no reference.

    Null texts are empty; empty ones have no words, so they fail the base. A null language is one of its own.
    Repeated rows and ids are judged row by row; an empty table gives an empty result.
    """
    got = materialize(features(docs, ["doc_id"]), "quality-rules")
    got = _shares(got)
    refs = got.filter(F.col("n_words") >= min_words).groupBy("lang_").agg(
        *(
            F.array(*(F.round(F.avg(F.get(p, F.lit(i))), 9) for i in range(n))).alias(q)
            for p, q, n in (("p_char", "q_char", len(CHAR_CLASSES) + 1), ("p_word", "q_word", len(COMMON_WORDS) + 1))
        )
    )  # one row per language: Spark broadcasts it by its size, or joins by language and splits a hot one
    measured = F.col("n_words") >= min_words
    joined = got.join(refs, "lang_", "left").withColumns(
        {
            "char_distance": F.when(measured, _entropy_gap(F.col("p_char"), F.col("q_char"))),
            "word_distance": F.when(measured, _entropy_gap(F.col("p_word"), F.col("q_word"))),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )
    far = (F.col("char_distance") > max_char) | (F.col("word_distance") > max_word)
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"), "char_distance", "word_distance",
    )
