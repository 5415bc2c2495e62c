"""Terms of texts, counted in Arrow batches.

A batch's words become numbers once; n-grams, counts per row and sums over rows are then array arithmetic, and a
term is written out once per batch. Nothing is looked at word by word, and nothing is shuffled here but sums per term.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfill.functions.text import _col
from gapfill.operators.blocks import BLOCK_SCHEMA, emit_blocks, sum_blocks
from gapfill.session import spread

#: Text that is counted at once.
SLICE_BYTES = 4 << 20
_BREAK = r"[^\p{L}\p{N}_]+"
#: Buckets of terms by hash, with which rare terms are left out before they are shuffled.
BUCKET_BITS = 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
COUNTED = "struct<terms:array<string>,tf:array<int>>"


def _letters() -> np.ndarray:
    """Which code points are part of a word, by the same expression that cuts texts; worked out once per process."""
    if "letters" not in _KEPT:
        points = np.arange(0x110000, dtype=np.uint32)
        points = points[(points < 0xD800) | (points >= 0xE000)]
        words = pc.split_pattern_regex(pa.array([points.tobytes().decode("utf-32-le")], pa.string()), _BREAK).flatten()
        table = np.zeros(0x110000, bool)
        table[np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)] = True
        _KEPT["letters"] = table
    return _KEPT["letters"]


_KEPT: dict[str, np.ndarray] = {}


def split_words(texts: pa.Array, min_len: int) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts (none null) in a row, and where each text begins among them (and the last ends).

    The bytes of a slice are looked up at once; a regular expression would go through them one by one.
    """
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    letters = _letters()
    if (raw < 128).all():
        inside, chars = letters[raw], np.arange(len(raw) + 1)
    else:
        first = (raw & 0xC0) != 0x80
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        inside = letters[points][np.cumsum(first) - 1]
        chars = np.concatenate([[0], np.cumsum(first)])
    before, after = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
    before[1:], after[:-1] = inside, inside
    before[ends], after[ends] = False, False  # a word ends where its text ends
    begin = np.flatnonzero(inside & ~before[:-1])
    end = np.flatnonzero(inside & ~after[1:]) + 1
    fits = chars[end] - chars[begin] >= max(min_len, 1)
    sizes = end - begin
    kept = raw[inside] if fits.all() else raw[inside][np.repeat(fits, sizes)]
    offsets = np.concatenate([[0], np.cumsum(sizes[fits])]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept)))
    return words, np.searchsorted(begin[fits], ends)


def _words(texts: pa.Array, min_len: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word numbers of all texts in a row, the words by number, and where each text begins (and the last ends)."""
    words, starts = split_words(texts, min_len)
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, starts


def count_terms(
    texts: pa.Array, ngram: Sequence[int], min_len: int, keep: Callable[[np.ndarray], np.ndarray] | None = None
) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of some lower-cased texts, and a ``(text, term, times)`` entry per text and term, by text.

    ``keep`` tells by the terms' buckets (see :func:`term_bounds`) which to count; it may only leave out terms whose
    continuations it leaves out too. Words are then among the distinct terms without any entry.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if not len(texts):
        return pa.array([], pa.string()), *(np.zeros(0, np.int64) for _ in range(3))
    words, vocabulary, starts = _words(texts, min_len)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    stop = np.repeat(starts[1:], np.diff(starts))
    names, place, numbers = vocabulary, np.arange(len(words)), words
    found, parts, before = [], [], 0
    of_word = _hashes(vocabulary) if keep else None
    hashes = of_word[words] if keep else None
    for n in range(1, ngram[-1] + 1):
        inside = place + n <= stop[place]
        if keep:
            if n > 1:
                hashes = hashes * _STEP + of_word[words[np.minimum(place + n - 1, len(words) - 1)]]
            inside &= keep(_bucket(hashes))
            hashes = hashes[inside]
        place, numbers = place[inside], numbers[inside]
        if n > 1:
            distinct, numbers = np.unique(numbers * len(vocabulary) + words[place + n - 1], return_inverse=True)
            left, right = np.divmod(distinct, max(len(vocabulary), 1))
            names = pc.binary_join_element_wise(names.take(pa.array(left)), vocabulary.take(pa.array(right)), " ")
        if n >= ngram[0]:
            size = max(len(names), 1)
            both, times = np.unique(owner[place] * size + numbers, return_counts=True)
            own, term = np.divmod(both, size)
            found.append(names)
            parts.append((own, term + before, times))
            before += len(names)
    own, term, times = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.argsort(own, kind="stable")
    return pa.concat_arrays(found), own[order], term[order], times[order]


class KnownTerms:
    """Numbers of a vocabulary's terms, found in texts word by word along the terms' beginnings.

    A term that the vocabulary lacks is never put together: a place of a text holds the number of the beginning that was
    found there, and the next word leads to a longer one or to none.
    """

    def __init__(self, terms: Sequence[str], ngram: Sequence[int]):
        split = [t.split(" ") for t in terms]
        words = sorted({w for t in split for w in t})
        of = {w: i for i, w in enumerate(words)}
        self.words, self.low, self.size = pa.array(words, pa.string()), ngram[0], len(terms)
        coded = [(tuple(of[w] for w in t), i) for i, t in enumerate(split)]
        #: Of every length: the beginnings (number of the one without the last word times ``step`` plus that word), and their terms.
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.step = max(len(words), 1)
        before = {(): 0}
        for n in range(1, ngram[-1] + 1):
            codes = {t[:n]: before[t[: n - 1]] * self.step + t[n - 1] for t, _ in coded if len(t) >= n}
            found = sorted(codes, key=codes.get)
            before = {t: i for i, t in enumerate(found)}
            term = np.full(len(found), -1)
            for t, i in coded:
                if len(t) == n:
                    term[before[t]] = i
            self.levels.append((np.array([codes[t] for t in found], np.int64), term))

    def count(self, texts: pa.Array, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A ``(text, term, times)`` entry per lower-cased text and term of the vocabulary, by text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        words, starts = split_words(texts, min_len)
        word = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), np.diff(starts))
        stop = np.repeat(starts[1:], np.diff(starts))
        place, state, parts = np.arange(len(word)), np.zeros(len(word), np.int64), []
        for n, (codes, term) in enumerate(self.levels, 1):
            inside = place + n <= stop[place]
            place, state = place[inside], state[inside]
            last = word[place + n - 1]
            have = last >= 0
            place, code = place[have], state[have] * self.step + last[have]
            at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            have = codes[at] == code if len(codes) else np.zeros(len(code), bool)
            place, state = place[have], at[have]
            if n >= self.low:
                own = term[state]
                parts.append((owner[place] * max(self.size, 1) + own)[own >= 0])
        both, times = np.unique(np.concatenate(parts), return_counts=True)
        own, term = np.divmod(both, max(self.size, 1))
        return own, term, times


def _slices(texts: pa.Array):
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
        yield start, texts.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1])


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def counted(text: Column | str, ngram: Sequence[int] = (1, 2), min_len: int = 1) -> Column:
    """A row's distinct terms and how often it has each, as ``struct<terms, tf>``; null counts as empty."""

    @F.arrow_udf(COUNTED)
    def count(texts: pa.Array) -> pa.Array:
        out = []
        for _, part in _slices(texts):
            names, owner, term, times = count_terms(part, ngram, min_len)
            terms = names.take(pa.array(term))
            columns = [_lists(owner, len(part), terms), _lists(owner, len(part), pa.array(times.astype(np.int32)))]
            out.append(pa.StructArray.from_arrays(columns, ["terms", "tf"]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("terms", pa.list_(pa.string())), ("tf", pa.list_(pa.int32()))]))

    return count(F.lower(_col(text)))


def term_sums(
    df: DataFrame, text: str, ngram: Sequence[int], min_len: int, weight: Column, kept: np.ndarray | None = None
) -> DataFrame:
    """``(term, tf, df)`` over all rows, each counted ``weight`` (a long) times; sums leave a task once per slice and term.

    ``kept`` says of every bucket whether its terms are counted.
    """
    shared = None if kept is None else df.sparkSession.sparkContext.broadcast(kept)  # a byte per bucket

    def run(batches):
        keep = None if shared is None else lambda bucket: shared.value[bucket]
        for batch in batches:
            for start, part in _slices(batch.column(1)):
                names, owner, term, times = count_terms(part, ngram, min_len, keep)
                w = batch.column(0).slice(start, len(part)).to_numpy(zero_copy_only=False)[owner]
                sums = [pa.array(np.bincount(term, x, len(names)).astype(np.int64)) for x in (times * w, w)]
                found = pa.RecordBatch.from_arrays([names, *sums], ["term", "tf", "df"])
                yield found if keep is None else found.filter(pc.greater(found.column(2), 0))

    rows = spread(df.select(weight.cast("long").alias("_w"), F.lower(_col(text)).alias("_text")))
    parts = rows.mapInArrow(run, "term string, tf long, df long")
    return parts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def _hashes(words: pa.Array) -> np.ndarray:
    return hash_array(np.array(words.to_pylist(), object), categorize=False)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def term_bounds(df: DataFrame, text: str, ngram: Sequence[int], min_len: int, weight: Column) -> np.ndarray:
    """How often all terms of a bucket (by hash) and their beginnings occur together: no term of it occurs more often.

    A task adds up its own numbers, whatever it reads, and the tasks' numbers are added up in a tree.
    """

    def run(batches):
        total = np.zeros(1 << BUCKET_BITS)
        for batch in batches:
            for start, part in _slices(batch.column(1)):
                words, vocabulary, starts = _words(pc.fill_null(part.cast(pa.string()), ""), min_len)
                of_word, sizes = _hashes(vocabulary), np.diff(starts)
                w = np.repeat(batch.column(0).slice(start, len(part)).to_numpy(zero_copy_only=False), sizes).astype(float)
                stop, place = np.repeat(starts[1:], sizes), np.arange(len(words))
                hashes = of_word[words]
                for n in range(1, ngram[-1] + 1):
                    if n > 1:
                        inside = place + n <= stop[place]
                        place = place[inside]
                        hashes = hashes[inside] * _STEP + of_word[words[place + n - 1]]
                    total += np.bincount(_bucket(hashes), w[place], len(total))
        yield pa.RecordBatch.from_pandas(emit_blocks({b"": total}), preserve_index=False)

    rows = spread(df.select(weight.cast("long").alias("_w"), F.lower(_col(text)).alias("_text")))
    parts = df.sparkSession.sparkContext.defaultParallelism
    shape = (1 << BUCKET_BITS,)
    return sum_blocks(rows.coalesce(parts).mapInArrow(run, BLOCK_SCHEMA), shape, parts).get(b"", np.zeros(shape))


def counted_sums(df: DataFrame, terms: str, weight: Column) -> DataFrame:
    """The same over rows that are counted already (a column made by :func:`counted`)."""
    entries = df.select(weight.cast("long").alias("_w"), F.explode(F.arrays_zip(F.col(f"{terms}.terms"), F.col(f"{terms}.tf"))).alias("_t"))
    return entries.groupBy(F.col("_t.terms").alias("term")).agg(F.sum(F.col("_t.tf") * F.col("_w")).alias("tf"), F.sum("_w").alias("df"))


def _vectors(n: int, owner: np.ndarray, index: np.ndarray, times: np.ndarray, idf: np.ndarray) -> pa.Array:
    """Sparse unit vectors of ``n`` rows in the storage form of Spark's vectors."""
    order = np.lexsort((index, owner))
    owner, index = owner[order], index[order]
    value = times[order] * idf[index]
    norm = np.sqrt(np.bincount(owner, value * value, n))
    value = value / norm[owner]
    kind, size = pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, len(idf), np.int32))
    lists = [_lists(owner, n, pa.array(index.astype(np.int32))), _lists(owner, n, pa.array(value))]
    return pa.StructArray.from_arrays([kind, size, *lists], ["type", "size", "indices", "values"])


def tfidf_vector(text: Column | str, terms: Sequence[str], idf: Sequence[float], ngram: Sequence[int], min_len: int, is_counted: bool = False) -> Column:
    """TF-IDF weights of a text (or of counted terms) as a sparse unit vector; unknown terms are ignored."""
    known = pa.array(terms, pa.string()) if is_counted else KnownTerms(terms, ngram)
    weight = np.array(idf)

    def numbers(names: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(names, value_set=known), -1).to_numpy(zero_copy_only=False)

    @F.arrow_udf(VectorUDT())
    def of_text(texts: pa.Array) -> pa.Array:
        out = [_vectors(0, *(np.zeros(0, np.int64) for _ in range(3)), weight)]
        for _, part in _slices(texts):
            out.append(_vectors(len(part), *known.count(part, min_len), weight))
        return pa.concat_arrays(out)

    @F.arrow_udf(VectorUDT())
    def of_counts(names: pa.Array, tf: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(names), 0).to_numpy(zero_copy_only=False)
        owner, index = np.repeat(np.arange(len(names)), sizes), numbers(names.flatten())
        have = index >= 0
        return _vectors(len(names), owner[have], index[have], tf.flatten().to_numpy(zero_copy_only=False)[have], weight)

    c = _col(text)
    return of_counts(c["terms"], c["tf"]) if is_counted else of_text(F.lower(c))
