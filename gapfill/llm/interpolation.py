"""Language-model scores by deleted interpolation (Jelinek and Mercer 1980).

Maximum-likelihood estimates of all orders up to n are mixed; the mixture depends on how often the context was seen
(buckets by powers of two). Part of the training documents is kept back ("deleted") from a first count; the weights are
learned from it by expectation-maximisation. The model then uses the counts of all training documents.

Documents are dealt to slices by hash. A slice asks for each of its distinct n-grams once, with its own counts; the
requests of a range of n-gram hashes meet in one task, which adds the counts up and answers every slice. So a frequent
word is one entry per slice however often it occurs, nothing that grows with the corpus is broadcast or collected, and
the counts cover every training document. N-grams are 64-bit hashes: among 10^7 distinct ones the odds that any two
share a hash are 3 in a million, among 10^9 3 %, and such a pair would merely be counted together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gapfill.session import materialize

ORDER = 2
#: Characters of the texts of one slice, and of those whose n-grams one counting task adds up, on average.
SLICE_CHARS, PART_CHARS = 8_000_000, 16_000_000
#: Every how manieth training document is kept back for the weights.
DELETED_EVERY = 20
MAX_ROUNDS, MIN_GAIN = 30, 1e-4
END = 0x9E3779B97F4A7C15
START = 0xC2B2AE3D27D4EB4F
_SPACE = r"[\x20\x09-\x0D]+"
REQUEST = "part long, slice long, n_gram int, size int, words binary, kept binary, seen binary"
ANSWER = "slice long, part long, n_gram int, size int, kept binary, seen binary"
TOTALS = -1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all tokens of a column of texts, one end per text, and where each text begins (and the last ends)."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks else pa.array([], pa.string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), _SPACE)
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    firsts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
    n_words = np.add.reduceat(real.astype(np.int64), firsts)
    words = flat.filter(pa.array(real)).dictionary_encode()
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)
    starts = np.concatenate([[0], np.cumsum(n_words + 1)])
    out = np.full(starts[-1], END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[starts[1:] - 1] = False
    out[inside] = table[words.indices.to_numpy()]
    return out, starts


def grams(words: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order, the hash of the n-gram that ends at each token; texts begin with start marks."""
    out = [words]
    for n in range(2, order + 1):
        before = np.empty_like(words)
        before[1:] = out[-1][:-1]
        before[starts[:-1]] = START
        out.append(_mix(before * np.uint64(0xFF51AFD7ED558CCD) + words + np.uint64(n)))
    return out


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in the shortest whole numbers that hold them all."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes()


def unpack_counts(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // size}").astype(np.int64)


def pack_sorted(values: np.ndarray, low: int) -> bytes:
    """Rising 64-bit numbers from ``low`` on, as differences of as few bytes as the largest needs."""
    gaps = np.diff(values, prepend=np.uint64(low))
    width = max(1, -(-int(gaps.max(initial=0)).bit_length() // 8))
    return np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_sorted(raw: bytes, size: int, low: int) -> np.ndarray:
    wide = np.zeros((size, 8), np.uint8)
    wide[:, : len(raw) // size] = np.frombuffer(raw, np.uint8).reshape(size, -1)
    gaps = wide.view("<u8").ravel()
    gaps[0] += np.uint64(low)
    return np.cumsum(gaps, dtype=np.uint64)


def _lows(parts: int) -> list[int]:
    """Where the hash range of each part begins."""
    return [-(-(p << 64) // parts) for p in range(parts)]


def _total(counts: np.ndarray, where: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(where, weights=counts, minlength=size).astype(np.int64)


def _requests(order: int, parts: int):
    schema = StructType.fromDDL(REQUEST)

    def run(key, table):
        words, starts = tokens(table["text"])
        train, dev = (np.repeat(table[c].to_numpy(), np.diff(starts)) for c in ("_train", "_dev"))
        lows = np.array(_lows(parts), np.uint64)
        rows = []
        for n, gram in enumerate(grams(words, starts, order), 1):
            distinct, at = np.unique(gram, return_inverse=True)
            seen = _total(train, at, len(distinct))
            kept = _total(train & ~dev, at, len(distinct))
            cuts = [*np.searchsorted(distinct, lows), len(distinct)]
            for part in range(parts):
                a, b = cuts[part], cuts[part + 1]
                if a < b:
                    packed = pack_sorted(distinct[a:b], int(lows[part]))
                    rows.append((part, key[0].as_py(), n, b - a, packed, pack_counts(kept[a:b]), pack_counts(seen[a:b])))
        return _arrow(rows, schema)

    return run


def _answers(parts: int):
    schema = StructType.fromDDL(ANSWER)

    def run(key, table):
        part = key[0].as_py()
        rows = []
        every = table.to_pylist()
        low = _lows(parts)[part]
        for n in sorted({r["n_gram"] for r in every}):
            asked = [r for r in every if r["n_gram"] == n]
            hashes = np.concatenate([unpack_sorted(r["words"], r["size"], low) for r in asked])
            distinct, at = np.unique(hashes, return_inverse=True)
            sums = [
                _total(np.concatenate([unpack_counts(r[c], r["size"]) for r in asked]), at, len(distinct)) for c in ("kept", "seen")
            ]
            start = 0
            for r in asked:
                mine = at[start : start + r["size"]]
                rows.append((r["slice"], part, n, r["size"], *(pack_counts(s[mine]) for s in sums)))
                start += r["size"]
            if n == 1:
                # One row of totals: tokens, distinct tokens, texts.
                ends = np.flatnonzero(distinct == np.uint64(END))
                totals = [np.array([s.sum(), (s > 0).sum(), s[ends].sum()], np.int64).tobytes() for s in sums]
                rows.append((TOTALS, part, 0, 3, *totals))
        return _arrow(rows, schema)

    return run


def _arrow(rows: list[tuple], kind: StructType):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(kind)
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


@dataclass(frozen=True)
class Totals:
    tokens: int
    distinct: int
    texts: int


class Counted:
    """The tokens of one slice with the counts of their n-grams: ``of[n - 1][i]``, and those of their contexts."""

    def __init__(self, texts, answers, order: int, column: str, totals: Totals):
        self.words, self.starts = tokens(texts)
        by_order: dict[int, list] = {}
        for r in sorted(answers.to_pylist(), key=lambda r: (r["n_gram"], r["part"])):
            by_order.setdefault(r["n_gram"], []).append(unpack_counts(r[column], r["size"]))
        self.of: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        for n, gram in enumerate(grams(self.words, self.starts, order), 1):
            _, at = np.unique(gram, return_inverse=True)
            self.of.append(np.concatenate(by_order[n])[at])
            context = np.empty(len(gram), np.int64)
            if n == 1:
                context[:] = totals.tokens
            else:
                context[1:] = self.of[n - 2][:-1]
                context[self.starts[:-1]] = totals.texts
            self.before.append(context)

    def buckets(self) -> np.ndarray:
        """64 times the highest order whose context was seen, plus the power of two of how often; 0 if nothing was."""
        out = np.zeros(len(self.words), np.int64)
        for n, context in enumerate(self.before, 1):
            seen = context > 0
            out[seen] = 64 * n + np.frexp(context[seen].astype(float))[1] - 1
        return out

    def estimate(self, n: int, totals: Totals) -> np.ndarray:
        """Likelihood of each token by order ``n``; by order 0, that of any token at all (unknown ones are one more)."""
        if n == 0:
            return np.full(len(self.words), 1 / (totals.distinct + 1))
        return self.of[n - 1] / np.maximum(self.before[n - 1], 1)

    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """One token of every kind (those of a kind have the same counts throughout), and how many there are."""
        counts = [*self.of, *self.before]
        order = np.lexsort(counts)
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in counts:
            sorted_ = c[order]
            new[1:] |= sorted_[1:] != sorted_[:-1]
        first = np.flatnonzero(new)
        return order[first], np.diff(np.append(first, len(order)))


def _crc(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def is_training(key: Column) -> Column:
    return _crc(key) % 7 != 2


def _sliced(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int, int, int]:
    """Rows with the slice they are in; those kept back for the weights have slices of their own."""
    chars = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    slices, parts = -(-chars // SLICE_CHARS) or 1, -(-chars // PART_CHARS) or 1
    crc = _crc(F.col(key))
    train = crc % 7 != 2
    dev = train & (F.floor(crc / 7) % DELETED_EVERY == 0)
    few = -(-slices // DELETED_EVERY)
    own = F.xxhash64(F.col(key), F.col(text))
    place = F.when(dev, slices + F.pmod(own, F.lit(few))).otherwise(F.pmod(own, F.lit(slices)))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), train.alias("_train"), dev.alias("_dev"), place.alias("slice"))
    return rows, slices, few, parts


def _totals(answers: DataFrame) -> tuple[Totals, Totals]:
    """Totals of the kept and of all training documents."""

    def add(batches):
        import pyarrow as pa

        kept, seen = np.zeros(3, np.int64), np.zeros(3, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                kept += np.frombuffer(row["kept"], np.int64)
                seen += np.frombuffer(row["seen"], np.int64)
        values = [pa.array([int(v)], pa.int64()) for v in (*kept, *seen)]
        yield pa.RecordBatch.from_arrays(values, [f"v{i}" for i in range(6)])

    schema = ", ".join(f"v{i} long" for i in range(6))
    rows = answers.filter(F.col("slice") == TOTALS).select("kept", "seen").mapInArrow(add, schema)
    got = rows.agg(*(F.coalesce(F.sum(f"v{i}"), F.lit(0)) for i in range(6))).first()
    return Totals(*got[:3]), Totals(*got[3:])


@dataclass(frozen=True)
class Mixture:
    """Weights of the estimates by bucket; a bucket without any takes those of the nearest one of its order."""

    order: int
    weights: dict[int, tuple[float, ...]]

    def of(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row of weights per bucket there is, and which row each of ``buckets`` takes."""
        distinct, at = np.unique(buckets, return_inverse=True)
        return np.array([self._weights(int(b)) for b in distinct]).reshape(-1, self.order + 1), at

    def _weights(self, bucket: int) -> tuple[float, ...]:
        near = [b for b in self.weights if b // 64 == bucket // 64]
        if near:
            return self.weights[min(near, key=lambda b: (abs(b - bucket), b))]
        return even(bucket, self.order)


def even(bucket: int, order: int) -> tuple[float, ...]:
    """The same weight for every estimate whose context a bucket's tokens have."""
    n = bucket // 64
    return tuple(1 / (n + 1) if i <= n else 0.0 for i in range(order + 1))


def learn(events: DataFrame, order: int) -> Mixture:
    """Expectation-maximisation over ``bucket, p array<double>, n`` (held-out tokens): a row per bucket is gathered a round.

    One imaginary token per estimate keeps all weights above zero. Rounds end when a token gains less than ``MIN_GAIN``.
    """
    spark = events.sparkSession
    weights = {r["bucket"]: even(r["bucket"], order) for r in events.select("bucket").distinct().collect()}
    last = None
    for _ in range(MAX_ROUNDS if weights else 0):
        table = F.broadcast(spark.createDataFrame([(b, list(w)) for b, w in weights.items()], "bucket long, w array<double>"))
        parts = [F.col("p")[i] * F.col("w")[i] for i in range(order + 1)]
        whole = sum(parts[1:], parts[0])
        mixed = events.join(table, "bucket").select("bucket", "n", whole.alias("whole"), *(p.alias(f"p{i}") for i, p in enumerate(parts)))
        sums = [F.sum(F.col("n") * F.col(f"p{i}") / F.col("whole")) for i in range(order + 1)]
        got = mixed.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("whole")).alias("gain"), *(s.alias(f"s{i}") for i, s in enumerate(sums))).collect()
        for r in got:
            used = r["bucket"] // 64 + 1
            weights[r["bucket"]] = tuple((r[f"s{i}"] + 1) / (r["n"] + used) if i < used else 0.0 for i in range(order + 1))
        now = sum(r["gain"] for r in got) / sum(r["n"] for r in got)
        if last is not None and now - last < MIN_GAIN:
            break
        last = now
    return Mixture(order, weights)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """Every row's ``key, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Null and empty texts, and those of white space, are their end alone. A null key counts as an empty one: the row is
    trained on. Repeated rows and keys are counted and scored each; other columns are not read, whatever their names.
    An empty table gives no rows. Without training documents every token has likelihood 1. A task holds one slice's
    texts, or one text if that is longer.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows, slices, few, parts = _sliced(docs.select(key, text), key, text)
    asked = rows.select("slice", "text", "_train", "_dev").groupBy("slice").applyInArrow(_requests(order, parts), REQUEST)
    answers = materialize(asked.groupBy("part").applyInArrow(_answers(parts), ANSWER), "ngram-counts")
    kept, seen = _totals(answers)

    event = StructType.fromDDL("bucket long, p array<double>, n long")

    def events(key, texts, counts):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        if not texts.num_rows or not kept.tokens:
            return _arrow([], event)
        counted = Counted(texts["text"], counts, order, "kept", kept)
        one, times = counted.kinds()
        p = pa.array(np.stack([counted.estimate(n, kept)[one] for n in range(order + 1)], axis=1).ravel())
        offsets = pa.array(np.arange(0, len(p) + 1, order + 1, dtype=np.int32))
        columns = [pa.array(counted.buckets()[one]), pa.ListArray.from_arrays(offsets, p), pa.array(times)]
        out = to_arrow_schema(event)
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    def of_slices(where: Column):
        return rows.filter(where).select("slice", "id", "text").groupBy("slice"), answers.filter(where).groupBy("slice")

    texts, counts = of_slices(F.col("slice") >= slices)
    mixture = learn(materialize(texts.cogroup(counts).applyInArrow(events, event), "held-out"), order)

    scored = StructType.fromDDL(f"id {kind}, n_tokens long, n_known long, base_score double, score double")

    def judge(key, texts, counts):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        if not texts.num_rows:
            return _arrow([], scored)
        counted = Counted(texts["text"], counts, order, "seen", seen)
        firsts = counted.starts[:-1]
        plain = np.log10((counted.of[0] + 1) / (seen.tokens + seen.distinct + 1))
        table, at = mixture.of(counted.buckets())
        mixed = np.zeros(len(at))
        for n in range(order + 1):
            mixed += counted.estimate(n, seen) * table[at, n]
        mixed = np.log10(mixed)
        columns = [
            texts["id"].combine_chunks(),
            np.diff(counted.starts),
            np.add.reduceat((counted.of[0] > 0).astype(np.int64), firsts),
            np.add.reduceat(plain, firsts),
            np.add.reduceat(mixed, firsts),
        ]
        out = to_arrow_schema(scored)
        return pa.Table.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(columns, out, strict=True)], schema=out)

    texts, counts = of_slices(F.col("slice") >= 0)
    got = texts.cogroup(counts).applyInArrow(judge, scored)
    return got.select(
        F.col("id").alias(key),
        (~is_training(F.col("id"))).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(seen.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
