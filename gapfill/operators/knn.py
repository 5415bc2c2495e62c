"""Nearest-neighbour text imputation.

The text dimensions of a row are missing together, so its distance to a donor depends on the
context columns only. Work is therefore done once per distinct context ("profile"), and each
donor profile contributes its k smallest keys at most: nothing else can be among the k nearest.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapfill.functions.text import AUX_COLUMNS, MISSING_TEXT, _col, is_blank
from gapfill.operators.chained import ChainedRidgeImputer, ChainedRidgeModel, Solver, bayesian_ridge
from gapfill.operators.context import ContextEncoder, ContextModel
from gapfill.operators.embed import SvdEmbed
from gapfill.operators.similar import nearest_text, topk_similar
from gapfill.operators.tfidf import TfIdf
from gapfill.session import materialize, spread


def profiles(df: DataFrame, key: str, encoder: ContextModel) -> DataFrame:
    """Distinct contexts, each named by its smallest row key."""
    return df.groupBy(*[_col(c) for c in encoder.columns]).agg(F.min(_col(key)).alias("profile"))


def match_profile(df: DataFrame, by_profile: DataFrame, encoder: ContextModel, how: str = "left") -> DataFrame:
    """Join per-profile results back to rows on the (null-safe) context."""
    right = by_profile.withColumnsRenamed({c: f"_p_{i}" for i, c in enumerate(encoder.columns)})
    cond = [_col(c).eqNullSafe(F.col(f"_p_{i}")) for i, c in enumerate(encoder.columns)]
    on = reduce(lambda a, b: a & b, cond) if cond else F.lit(True)
    return df.join(right, on, how).drop(*[f"_p_{i}" for i in range(len(encoder.columns))])


def donor_rows(observed: DataFrame, key: str, encoder: ContextModel, k: int) -> DataFrame:
    """The k smallest keys of every donor profile with their encoded context."""
    first = Window.partitionBy(*[_col(c) for c in encoder.columns]).orderBy(_col(key))
    return (
        observed.select(_col(key), *[_col(c) for c in encoder.columns])
        .withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") <= k)
        .select(_col(key).alias("id"), encoder.encode().alias("vec"))
    )


def profile_donors(blank_profiles: DataFrame, donors: DataFrame, encoder: ContextModel, k: int, weights: str) -> DataFrame:
    """``(profile, donor, distance, weight)`` of the k nearest donors per blank profile."""
    queries = blank_profiles.select(F.col("profile").alias("id"), encoder.encode().alias("vec"))
    near = topk_similar(queries, donors, k, metric="nan_distance").select(
        F.col("query").alias("profile"), F.col("match").alias("donor"), (-F.col("score") + 0.0).alias("distance"), "rank"
    )
    if weights == "uniform":
        return near.withColumn("weight", F.lit(1.0))
    if weights != "distance":
        raise ValueError("weights must be 'uniform' or 'distance'")
    exact = F.min("distance").over(Window.partitionBy("profile")) == 0
    return near.withColumn(
        "weight",
        F.when(exact, (F.col("distance") == 0).cast("double")).otherwise(F.lit(1.0) / F.col("distance")),
    )


def knn_donors(
    df: DataFrame,
    key: str,
    text: str = "text",
    context: Sequence[str] | None = None,
    k: int = 5,
    weights: str = "distance",
) -> DataFrame:
    """Donors of every blank row: ``(key, donor, distance, weight)``."""
    encoder = ContextEncoder(text, context, (key, *AUX_COLUMNS)).fit(df)
    blank = df.filter(is_blank(text))
    by_profile = profiles(blank, key, encoder)
    donors = donor_rows(df.filter(~is_blank(text)), key, encoder, k)
    near = profile_donors(by_profile, donors, encoder, k, weights)
    rows = match_profile(blank.select(_col(key), *[_col(c) for c in encoder.columns]), by_profile, encoder, "inner")
    return rows.select(_col(key), "profile").join(near, "profile").select(key, "donor", "rank", "distance", "weight")


@dataclass(frozen=True)
class KnnTextImputer:
    """Fill blank text with the observed text nearest to the donors' mean embedding."""

    key: str
    text: str = "text"
    context: Sequence[str] | None = None
    k: int = 5
    weights: str = "distance"
    max_features: int = 3000
    svd: int = 256
    seed: int = 42
    placeholder: str = MISSING_TEXT

    def fit(self, df: DataFrame) -> KnnModel:
        encoder = ContextEncoder(self.text, self.context, (self.key, *AUX_COLUMNS)).fit(df)
        observed = df.filter(~is_blank(self.text))
        corpus = embed_observed(observed, self.key, self.text, self.max_features, self.svd, self.seed)
        return KnnModel(self, encoder, observed, corpus)


def embed_observed(observed: DataFrame, key: str, text: str, max_features: int, svd: int, seed: int) -> DataFrame:
    """Embeddings of the observed texts, written once: ``(key, embedding)``."""
    tfidf = TfIdf(text, max_features).fit(observed)
    vectors = materialize(tfidf.transform(spread(observed.select(_col(key), _col(text)))).drop(text), "vectors")
    model = SvdEmbed(svd, seed=seed).fit(vectors, tfidf.dim, stored=True)
    return materialize(model.transform(vectors).select(key, "embedding"), "embeddings")


@dataclass(frozen=True)
class KnnModel:
    config: KnnTextImputer
    encoder: ContextModel
    observed: DataFrame
    corpus: DataFrame

    def profile_embeddings(self, by_profile: DataFrame) -> DataFrame:
        """Weighted mean embedding of each blank profile's donors.

        A profile that shares no context dimension with any donor takes the overall mean.
        """
        cfg = self.config
        donors = donor_rows(self.observed, cfg.key, self.encoder, cfg.k)
        near = materialize(profile_donors(by_profile, donors, self.encoder, cfg.k, cfg.weights), "donors")
        vec = array_to_vector("embedding")
        means = (
            near.join(self.corpus.withColumnRenamed(cfg.key, "donor"), "donor")
            .groupBy("profile")
            .agg(vector_to_array(Summarizer.mean(vec, F.col("weight"))).alias("_mean"))
        )
        overall = self.corpus.agg(vector_to_array(Summarizer.mean(vec)).alias("_all"))  # one row
        return (
            by_profile.join(means, "profile", "left")
            .join(F.broadcast(overall))
            .withColumn("embedding", F.coalesce("_mean", "_all"))
            .drop("_mean", "_all")
        )

    def transform(self, df: DataFrame) -> DataFrame:
        return fill_by_profile(df, self)


def fill_by_profile(df: DataFrame, model) -> DataFrame:
    """Fill blanks with the observed text nearest to the embedding the model gives each profile."""
    key, text = model.config.key, model.config.text
    columns = [_col(c) for c in df.columns]
    blank = df.filter(is_blank(text))
    by_profile = materialize(profiles(blank, key, model.encoder), "profiles")
    embedded = materialize(model.profile_embeddings(by_profile).select("profile", "embedding"), "profile-embeddings")
    fills = nearest_text(embedded, model.corpus, "profile", key, "embedding", text, texts=model.observed)
    by_profile = by_profile.join(fills.select("profile", _col(text).alias("_fill")), "profile").drop("profile")
    filled = (
        match_profile(blank, by_profile, model.encoder)
        .withColumn(text, F.coalesce("_fill", F.lit(model.config.placeholder)))
        .select(*columns, F.lit(True).alias("was_filled"))
    )
    kept = df.filter(~is_blank(text)).select(*columns, F.lit(False).alias("was_filled"))
    return kept.unionByName(filled)


@dataclass(frozen=True)
class IterativeTextImputer:
    """Like :class:`KnnTextImputer`, with embeddings from chained ridge regressions."""

    key: str
    text: str = "text"
    context: Sequence[str] | None = None
    max_iter: int = 10
    solver: Solver = bayesian_ridge
    max_features: int = 3000
    svd: int = 256
    seed: int = 42
    placeholder: str = MISSING_TEXT

    def fit(self, df: DataFrame) -> IterativeTextModel:
        encoder = ContextEncoder(self.text, self.context, (self.key, *AUX_COLUMNS)).fit(df)
        observed = df.filter(~is_blank(self.text))
        corpus = embed_observed(observed, self.key, self.text, self.max_features, self.svd, self.seed)
        first = corpus.select(F.size("embedding")).first()
        width = first[0] if first else 0
        rows = df.select(_col(self.key), encoder.encode().alias("_context")).join(corpus, self.key, "left")
        spread = rows.select(*_spread(width, encoder.dim))
        chain = ChainedRidgeImputer(spread.columns, self.max_iter, self.solver).fit(spread)
        return IterativeTextModel(self, encoder, observed, corpus, chain, width)


def _spread(width: int, dim: int) -> list:
    text = [F.get("embedding", F.lit(i)).alias(f"t{i}") for i in range(width)]
    return text + [F.get("_context", F.lit(i)).alias(f"x{i}") for i in range(dim)]


@dataclass(frozen=True)
class IterativeTextModel:
    config: IterativeTextImputer
    encoder: ContextModel
    observed: DataFrame
    corpus: DataFrame
    chain: ChainedRidgeModel
    width: int

    def profile_embeddings(self, by_profile: DataFrame) -> DataFrame:
        empty = F.lit(None).cast("array<double>")
        rows = by_profile.withColumns({"_context": self.encoder.encode(), "embedding": empty})
        spread = rows.select("profile", *_spread(self.width, self.encoder.dim))
        return spread.select("profile", F.slice(self.chain.filled_array(), 1, self.width).alias("embedding"))

    def transform(self, df: DataFrame) -> DataFrame:
        return fill_by_profile(df, self)
