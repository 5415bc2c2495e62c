"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapfill.session import materialize

from .common import map_slices

#: Random features; the normal equations are a square matrix of that side.
N_FEATURES = 256
RIDGE = 1e-3
SEED = 20_240
#: Equal-width bins of the ridge score that the isotonic fit pools; their counts cover all labelled rows.
N_BINS = 2_000
ACCEPT = 0.7
CLIP = 6.0

STATISTICS = (
    "log_chars", "log_words", "mean_word", "longest_word", "lower", "upper", "digit", "symbol", "stop", "bar", "bang", "high",
    "log_lines", "distinct_words", "top_word", "same_as_before", "short_words", "distinct_lines", "bare_words", "entropy",
)
_CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "symbol": b"#*$%&<>@^~=+_\\{}[]", "stop": b".,;:?'\"()-",
    "bar": b"|", "bang": b"!", "high": range(128, 256),
}
_MASK = np.zeros((256, len(_CLASSES)))
for _i, _bytes in enumerate(_CLASSES.values()):
    _MASK[list(_bytes), _i] = 1
_BARE = re.compile(r"[^\W\d_]+[.,]?")


def statistics(text: str | None) -> list[float]:
    """Counts and shares of one whole text; all are 0 for an empty one."""
    raw = (text or "").encode("utf-8", "replace")
    words = (text or "").split()
    if not words:
        return [0.0] * len(STATISTICS)
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = bytes_ @ _MASK / len(raw)
    seen = bytes_[bytes_ > 0] / len(raw)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    n = len(words)
    lines = text.split("\n")
    sizes = list(map(len, words))
    return [
        np.log1p(len(text)), np.log1p(n), sum(sizes) / n, np.log1p(max(sizes)), *shares, np.log1p(len(lines)), len(counts) / n,
        max(counts.values()) / n, sum(map(str.__eq__, words, words[1:])) / n, sum(s <= 3 for s in sizes) / n, len(set(lines)) / len(lines),
        sum(map(bool, map(_BARE.fullmatch, words))) / n, float(-(seen * np.log2(seen)).sum()),
    ]


@dataclass(frozen=True)
class Model:
    """What scoring needs; a few hundred kilobytes, whatever it was fitted on. ``weights`` is None without labels."""

    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    freq: np.ndarray | None = None
    phase: np.ndarray | None = None
    weights: np.ndarray | None = None
    low: float = 0.0
    high: float = 1.0
    knots: np.ndarray | None = None  # raw scores
    levels: np.ndarray | None = None  # calibrated, not falling

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -CLIP, CLIP)
        phi = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.freq + self.phase)
        return np.hstack([phi, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.fourier(stats) @ self.weights

    def predict(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(stats))
        return np.interp(self.raw(stats), self.knots, self.levels)


def with_statistics(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and ``stats`` (array of doubles) of every row, in one pass over ``text``."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", stats array<double>"

    def work(rows: dict[str, list]) -> dict[str, list]:
        return {c: rows[c] for c in columns} | {"stats": [statistics(t) for t in rows["text"]]}

    return map_slices(docs.select(*columns, "text"), schema, work)


def pool(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: the blocks' mean positions and levels."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, w, strict=True):
        blocks.append([xi * wi, yi * wi, wi])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def fit(stats: DataFrame, n_features: int = N_FEATURES, ridge: float = RIDGE, n_bins: int = N_BINS, seed: int = SEED) -> Model:
    """Fit on ``stats, label`` (a stored table; labels 0 to 1, null rows are left out).

    Three passes over the labelled statistics: mean and scale; the normal equations, of which every task sums its own
    rows and Spark adds the sums row of the matrix by row; counts and labels per score bin for the calibration. The
    driver gets ``n_features`` squared numbers and ``n_bins`` counts. A class that is missing makes a constant score;
    no label at all makes a model that rejects nothing (score 1).
    """
    rows = stats.filter("label is not null").select("stats", F.col("label").cast("double").alias("label"))
    k = len(STATISTICS)
    columns = [f(F.get("stats", F.lit(i))).alias(f"{n}{i}") for n, f in (("m", F.avg), ("s", F.stddev_pop)) for i in range(k)]
    first = rows.agg(F.count(F.lit(1)).alias("n"), *columns).first()
    if not first["n"]:
        return Model()
    mean = np.array([first[f"m{i}"] for i in range(k)])
    scale = np.array([first[f"s{i}"] or 0.0 for i in range(k)])
    rng = np.random.default_rng(seed)
    start = {
        "mean": mean, "scale": np.where(scale > 1e-9, scale, 1.0), "freq": rng.normal(size=(k, n_features)) / np.sqrt(k),
        "phase": rng.uniform(0, 2 * np.pi, n_features),
    }
    blank = Model(**start)
    side = n_features + 1

    def sums(batches):
        import pyarrow as pa

        total, any_row = np.zeros((side, side + 1)), False
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                phi = blank.fourier(np.array(part.column(0).to_pylist()))
                y = np.array(part.column(1).to_pylist())
                total += phi.T @ np.hstack([phi, y[:, None]])
                any_row = True
        if any_row:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(side), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "part"]
            )

    added = [F.sum(F.get("part", F.lit(j))).alias(f"c{j}") for j in range(side + 1)]
    got = rows.mapInArrow(sums, "i int, part array<double>").groupBy("i").agg(*added).orderBy("i").toPandas().to_numpy()[:, 1:]
    gram, right = got[:, :side], got[:, side]
    penalty = ridge * first["n"] * np.eye(side)
    penalty[-1, -1] = 0
    fitted = Model(**start, weights=np.linalg.solve(gram + penalty + 1e-9 * np.eye(side), right))

    low, high = -0.5, 1.5

    def binned(rows: dict[str, list]) -> dict[str, list]:
        raw = fitted.raw(np.array(rows["stats"]))
        at = np.clip(((raw - low) / (high - low) * n_bins).astype(int), 0, n_bins - 1)
        return {"bin": at.tolist(), "label": rows["label"]}

    bins = map_slices(rows, "bin int, label double", binned).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("y"))
    got = bins.orderBy("bin").toPandas()
    x = low + (got["bin"].to_numpy() + 0.5) * (high - low) / n_bins
    knots, levels = pool(x, got["y"].to_numpy(), got["n"].to_numpy().astype(float))
    return Model(**start, weights=fitted.weights, low=low, high=high, knots=knots, levels=np.clip(levels, 0.0, 1.0))


def score_stats(stats: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` and ``score`` of stored statistics."""
    schema = ", ".join(f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in columns) + ", score double"

    def work(rows: dict[str, list]) -> dict[str, list]:
        return {c: rows[c] for c in columns} | {"score": model.predict(np.array(rows["stats"])).tolist()}

    return map_slices(stats.select(*columns, "stats"), schema, work)


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from; a null id is never held out, nor does it have a label."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """``stats, label`` of the labelled rows that may be learned from; several labels of a document are averaged."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("label"))
    return stats.filter(~held_out()).join(known, "doc_id").select("stats", "label")


def classify(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs`` (``doc_id, text``), learned from ``labels``.

    Statistics are worked out once and stored; fit and scores read them. Null texts are empty, and empty ones are scored
    like any (all statistics 0). Repeated rows and ids are scored row by row; an empty table gives an empty result.
    """
    stats = materialize(with_statistics(docs, ["doc_id"]), "quality-stats")
    model = fit(materialize(training(stats, labels), "quality-train"))
    scored = score_stats(stats, model, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``docs`` (any columns) without those that score below ``accept``.

    The model learns from the labelled documents first; then every document is scored where it is read, so no text
    is shuffled.
    """
    stats = with_statistics(docs, ["doc_id"])
    model = fit(materialize(training(stats, labels), "quality-train"))

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(model.predict(np.array([statistics(t) for t in texts])) if len(texts) else [], dtype="float64")

    return docs.filter(score(docs["text"]) >= accept)


