"""Vocabulary selection and TF-IDF.

The vocabulary is an aggregate over terms that are counted and summed in place; vectors are made batch by
batch, so vectorising a table never shuffles it. Both also take rows whose terms are counted already.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfill.functions.text import _col
from gapfill.operators.terms import counted_sums, term_bounds, term_sums, tfidf_vector
from gapfill.session import input_bytes, materialize, spread

#: Input from which on rare terms are left out before the shuffle, which takes one pass more.
PRUNE_BYTES = 32 << 20


def term_stats(
    df: DataFrame, text: str, ngram: Sequence[int] = (1, 2), min_len: int = 1, weight: str | None = None, counted: bool = False
) -> DataFrame:
    """Corpus frequency ``tf`` and document frequency ``df`` of every term.

    ``weight`` is the number of rows a (de-duplicated) row stands for. ``counted`` says that ``text`` holds counted terms.
    """
    w = _col(weight) if weight else F.lit(1)
    return counted_sums(df, text, w) if counted else term_sums(df, text, ngram, min_len, w)


def vocabulary(
    df: DataFrame,
    text: str,
    max_features: int | None = None,
    min_df: int = 1,
    ngram: Sequence[int] = (1, 2),
    min_len: int = 1,
    weight: str | None = None,
    counted: bool = False,
) -> DataFrame:
    """Terms with ``df >= min_df``; the ``max_features`` most frequent ones, ties alphabetical."""
    if max_features is None or counted or input_bytes(df) < PRUNE_BYTES:
        stats = term_stats(df, text, ngram, min_len, weight, counted).filter(F.col("df") >= min_df)
    else:
        stats = _frequent(df, text, max_features, min_df, ngram, min_len, _col(weight) if weight else F.lit(1))
    return stats if max_features is None else stats.orderBy(F.desc("tf"), "term").limit(max_features)


def _frequent(df: DataFrame, text: str, n: int, min_df: int, ngram: Sequence[int], min_len: int, weight: Column) -> DataFrame:
    """The statistics of all terms that can be among the ``n`` most frequent ones, and perhaps of more.

    Most terms are rare and would only be shuffled to be dropped. A term occurs no more often than its bucket, so buckets
    under a limit are left out unseen. If ``n`` terms reach the limit, all others are rarer than these; else the limit falls.
    """
    bounds = term_bounds(df, text, ngram, min_len, weight)
    top = np.partition(bounds, max(len(bounds) - n, 0))[max(len(bounds) - n, 0)]
    limit = int(max(0.8 * (top - np.median(bounds)), 0))
    while True:
        # A term's beginnings occur as often as the term at least, so they are kept where it is.
        stats = term_sums(df, text, ngram, min_len, weight, None if limit < 2 else bounds >= limit).filter(F.col("df") >= min_df)
        if limit < 2:
            return stats
        stats = materialize(stats.filter(F.col("tf") >= limit), "frequent-terms")
        if stats.count() >= n:
            return stats
        limit //= 4


@dataclass(frozen=True)
class TfIdf:
    """TF-IDF with smoothed idf and unit-length rows.

    ``max_features`` bounds the vocabulary, and with it everything that is held on the driver
    or broadcast.
    """

    text: str
    max_features: int
    ngram: Sequence[int] = (1, 2)
    min_len: int = 1
    min_df: int = 1
    weight: str | None = None
    #: Whether ``text`` is a column of counted terms (see ``terms.counted``) instead of texts.
    counted: bool = False

    def fit(self, df: DataFrame) -> TfIdfModel:
        docs = df.filter(_col(self.text).isNotNull())
        n = docs.agg(F.sum(_col(self.weight)) if self.weight else F.count("*")).first()[0] or 0
        vocab = vocabulary(
            docs, self.text, self.max_features, self.min_df, self.ngram, self.min_len, self.weight, self.counted
        ).collect()
        if not vocab:
            raise ValueError("empty vocabulary: no text with any term to fit on")
        rows = sorted((r["term"], r["df"]) for r in vocab)
        idf = [math.log((1 + n) / (1 + d)) + 1.0 for _, d in rows]
        return TfIdfModel(self, tuple(t for t, _ in rows), tuple(idf), n)


@dataclass(frozen=True)
class TfIdfModel:
    config: TfIdf
    terms: tuple[str, ...] = field(repr=False)
    idf: tuple[float, ...] = field(repr=False)
    n: int = 0

    @property
    def dim(self) -> int:
        return len(self.terms)

    def transform(self, df: DataFrame, out: str = "vector") -> DataFrame:
        """``df`` with a sparse unit vector; terms outside the vocabulary are ignored."""
        cfg = self.config
        return df.withColumn(out, tfidf_vector(cfg.text, self.terms, self.idf, cfg.ngram, cfg.min_len, cfg.counted))

    def weights(self, df: DataFrame, *key: str) -> DataFrame:
        """Long form ``(key..., term, weight)``: one narrow pass and a lookup of the term names."""
        spark = df.sparkSession
        vec = F.unwrap_udt("vector")
        long = self.transform(spread(df)).select(
            *key, F.explode(F.arrays_zip(vec["indices"].alias("i"), vec["values"].alias("w"))).alias("_e")
        )
        names = spark.createDataFrame(list(enumerate(self.terms)), "_i int, term string")
        return long.select(*key, F.col("_e.i").alias("_i"), F.col("_e.w").alias("weight")).join(
            F.broadcast(names), "_i"  # at most max_features rows
        ).select(*key, "term", "weight")
