"""Whitening of embeddings: principal components by spectral divide-and-conquer over polar decompositions.

The covariance is summed by Spark; its eigenvectors come from QDWH-eig (Nakatsukasa and Higham 2013): the polar
factor U of the covariance less a shift gives the projector (U + I) / 2 on the subspace of all larger eigenvalues.
An orthonormal basis of that subspace and of the rest splits the matrix in two, and each half is split again.
The components are then broadcast (``MAX_DIMENSIONS`` times 32 doubles at most) and every vector is projected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMPONENTS = 32
#: Entries count as whole steps of 1/SCALE from -OFFSET / SCALE on.
SCALE, OFFSET = 64, 1_000_000
#: The covariance (its square in doubles) is solved on the driver: 32 MB at most.
MAX_DIMENSIONS = 2048
BATCH_ROWS = 4096
EPS = np.finfo(float).eps


def polar_factor(a: np.ndarray) -> np.ndarray | None:
    """The orthogonal factor of a symmetric matrix by QR-based dynamically weighted Halley steps; None if singular."""
    m = len(a)
    eye = np.eye(m)
    x = a / np.linalg.norm(a)
    low = _least_value(x)
    if low <= EPS:
        return None
    for _ in range(60):
        square = low * low
        d = (4 * max(0.0, 1 - square) / (square * square)) ** (1 / 3)
        p = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d)))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        last = x
        if r > 100:  # far from orthogonal: a QR step is stable however badly conditioned x is
            both, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, eye]))
            x = q / r * x + (p - q / r) / np.sqrt(r) * both[:m] @ both[m:].T
        else:
            lower = np.linalg.cholesky(eye + r * x.T @ x)
            half = np.linalg.solve(lower, x.T)
            x = q / r * x + (p - q / r) * np.linalg.solve(lower.T, half).T
        x = (x + x.T) / 2
        low = min(1.0, low * (p + q * square) / (1 + r * square))
        if np.linalg.norm(x - last) <= (5 * EPS) ** (1 / 3) and 1 - low <= 10 * EPS:
            break
    return x


def _least_value(x: np.ndarray) -> float:
    """A lower bound of the least singular value of a symmetric matrix; 0 if it has no inverse."""
    try:
        return float(1 / np.abs(np.linalg.inv(x)).sum(axis=0).max())
    except (np.linalg.LinAlgError, ZeroDivisionError, FloatingPointError):
        return 0.0


def _split(a: np.ndarray, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the subspaces of the eigenvalues above and below some shift; None if they can't be told apart."""
    m = len(a)
    eye = np.eye(m)
    diagonal = np.sort(np.diag(a))
    shifts = {float(np.median(diagonal)), float(diagonal.mean()), *map(float, (diagonal[:-1] + diagonal[1:])[:: max(1, m // 8)] / 2)}
    # The farther a shift lies from all eigenvalues, the fewer steps and the sharper the projector.
    tried = sorted(shifts, key=lambda s: -_least_value((a - s * eye) / scale))
    best = None
    for shift in tried:
        factor = polar_factor(a - shift * eye) if np.linalg.norm(a - shift * eye) > 0 else None
        if factor is None:
            continue
        projector = (factor + eye) / 2
        k = round(float(np.trace(projector)))
        if not 0 < k < m:
            continue
        upper, _ = np.linalg.qr(projector @ rng.standard_normal((m, k)))
        for _ in range(2):
            upper, _ = np.linalg.qr(projector @ upper)
        whole, _ = np.linalg.qr(upper, mode="complete")
        lower = whole[:, k:]
        left = np.linalg.norm(lower.T @ a @ upper)
        if best is None or left < best[0]:
            best = left, upper, lower
        if left <= 4 * EPS * scale * np.sqrt(m):
            break
    return None if best is None else best[1:]


def components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    scale = float(np.linalg.norm(covariance))
    m = len(covariance)
    rng = np.random.default_rng(0)
    done: list[np.ndarray] = []
    todo = [((covariance + covariance.T) / 2, np.eye(m))]
    while todo:
        a, basis = todo.pop()
        off = np.linalg.norm(a - np.diag(np.diag(a)))
        halves = None if len(a) == 1 or off <= EPS * scale else _split(a, scale, rng)
        if halves is None:
            done.append(basis)
            continue
        for half in halves:
            part = half.T @ a @ half
            todo.append(((part + part.T) / 2, basis @ half))
    vectors = np.hstack(done) if done else np.zeros((m, 0))
    vectors, _ = np.linalg.qr(vectors) if m else (vectors, None)
    values = np.einsum("ij,ij->j", vectors, covariance @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: tuple[int, ...]
    #: Kept eigenvalues, falling, and their vectors as columns.
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def scales(self) -> np.ndarray:
        """What projections are divided by; NaN where there is no spread at all to whiten."""
        return np.where(self.values > len(self.sums) * EPS * self.trace, np.sqrt(np.maximum(self.values, 0)), np.nan)


def usable(rows: DataFrame, vec: str = "embedding") -> DataFrame:
    """Rows whose vector has only finite entries that make a long, and as many as most vectors have (ties: more)."""
    limit = float(1 << 62) / SCALE
    fine = F.forall(vec, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < limit) & ~F.isnan(v.cast("double")))
    kept = rows.filter(F.coalesce(fine, F.lit(False)) & (F.size(vec) > 0))
    usual = kept.groupBy(F.size(vec).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return kept.filter(F.size(vec) == (usual["d"] if usual else 0))


def _steps(column, d: int) -> np.ndarray:
    """Whole steps of a batch of vectors, as longs."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, d) + OFFSET


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n x - S``, exact; Python numbers where longs are too short."""
    largest = float(np.abs(x).max(initial=0))
    if largest * n < 2.0**61:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _batches(batches, at: int, d: int):
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(start, BATCH_ROWS)
            yield part, _steps(part.column(at), d)


def _summed_blocks(vectors: DataFrame, rows: int, work) -> np.ndarray:
    """``work``'s square blocks of all batches, added up per task, then by Spark; a row per entry, no more."""
    schema = StructType.fromDDL("cell int, value double")

    def run(batches):
        import pyarrow as pa

        total = np.zeros((rows, rows))
        for _, block in work(batches):
            total += block
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows * rows, dtype=np.int32)), pa.array(total.ravel())], ["cell", "value"])

    out = np.zeros(rows * rows)
    for row in vectors.mapInArrow(run, schema).groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[row["cell"]] = row["value"]
    return out.reshape(rows, rows)


def fit(rows: DataFrame, vec: str = "embedding", count: int = COMPONENTS) -> Whitening | None:
    """Count, exact sums and components of :func:`usable` rows, in two passes; None without rows."""
    vectors = rows.select(vec)
    size = vectors.select(F.size(vec)).first()
    if size is None:
        return None
    d = size[0]
    if d > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {d} entries; the covariance is solved for at most {MAX_DIMENSIONS}")

    def add(batches):
        import pyarrow as pa

        n, total = 0, np.zeros(d, dtype=object)
        for _, x in _batches(batches, 0, d):
            small = np.abs(x).max(initial=0) < 1 << 40
            total += (x if small else x.astype(object)).sum(axis=0).astype(object)
            n += len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, d, dtype=np.int32)), pa.array([str(v) for v in (n, *total)])], ["cell", "value"]
        )

    exact = F.sum(F.col("value").cast("decimal(38,0)")).alias("value")
    got = {r["cell"]: int(r["value"]) for r in vectors.mapInArrow(add, "cell int, value string").groupBy("cell").agg(exact).collect()}
    n, sums = got[-1], tuple(got[i] for i in range(d))
    exact_sums = np.array(sums, dtype=object)

    def products(batches):
        for part, x in _batches(batches, 0, d):
            c = _centred(x, n, exact_sums).astype(float) / n
            yield part, c.T @ c

    covariance = _summed_blocks(vectors, d, products) / n
    values, basis = components(covariance)
    k = min(count, d)
    return Whitening(n, sums, values[:k], basis[:, :k], float(np.trace(covariance)))


def _sent(rows: DataFrame, model: Whitening):
    """Count, sums and the matrix from ``n x - S`` to whitened coordinates, broadcast as plain values."""
    return rows.sparkSession.sparkContext.broadcast((model.n, model.sums, model.vectors / model.scales / model.n))


def transform(rows: DataFrame, model: Whitening, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``key, deviation, whitened array<double>`` of every row; a coordinate without spread is null.

    ``deviation`` is the exact sum of (n x - S)^2, null where that exceeds a long.
    """
    kind = rows.schema[key].dataType.simpleString()
    shared = _sent(rows, model)
    d, k = len(model.sums), len(model.values)
    schema = StructType.fromDDL(f"id {kind}, deviation long, whitened array<double>")

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        n, sums, matrix = shared.value
        sums = np.array(sums, dtype=object)
        out = to_arrow_schema(schema)
        for part, x in _batches(batches, 1, d):
            c = _centred(x, n, sums)
            if c.dtype == object or np.square(c.astype(float)).sum(axis=1).max(initial=0) > 2.0**62:
                exact = [sum(int(v) ** 2 for v in row) for row in c]
                deviation = [v if v < 1 << 63 else None for v in exact]
            else:
                deviation = (c * c).sum(axis=1)
            w = pa.array((c.astype(float) @ matrix).ravel(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * k + 1, k, dtype=np.int32)), w)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviation, pa.int64()), lists.cast(out.field(2).type)], schema=out)

    return rows.select(key, vec).mapInArrow(run, schema).withColumnRenamed("id", key)


def identity_error(rows: DataFrame, model: Whitening, vec: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over coordinates with spread.

    A pass of its own: coordinates are centred already, as ``n x - S`` is projected, and multiplied then.
    """
    fine = ~np.isnan(model.scales)
    d, k = len(model.sums), int(fine.sum())
    if not k:
        return 0.0
    shared = _sent(rows, model)

    def products(batches):
        n, sums, matrix = shared.value
        sums = np.array(sums, dtype=object)
        for part, x in _batches(batches, 0, d):
            w = (_centred(x, n, sums).astype(float) @ matrix)[:, fine]
            yield part, w.T @ w

    return float(np.abs(_summed_blocks(rows.select(vec), k, products) / model.n - np.eye(k)).max())


def whiten(rows: DataFrame, key: str = "vec_id", vec: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` for every usable row and component.

    Rows whose vector is null, has null or non-finite entries, or another length than most, are left out; so are
    entries of 2^56 and more, which make no long. Repeated rows and keys count each, a null key stays null, other
    columns are not read. An empty table, or one without a usable row, gives no rows. Vectors that do not vary (one
    row, copies of one) have null coordinates, 0 explained and an identity error of 0. Equal eigenvalues have any
    orthonormal vectors of their subspace, the same for all rows.
    """
    kind = rows.schema[key].dataType.simpleString()
    good = usable(rows.select(key, vec), vec)
    model = fit(good, vec, count)
    if model is None:
        empty = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], empty)
    share = [float(v) / model.trace if model.trace > 0 else 0.0 for v in model.values]
    error = identity_error(good, model, vec)
    long = transform(good, model, key, vec).select(key, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        key,
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        _pick(share, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def _pick(values: list[float], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at)
