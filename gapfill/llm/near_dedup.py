"""Near-duplicates: consistent weighted samples of TF-IDF word shingles, banded, then weighted Jaccard similarity."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gapfill.session import materialize

from .common import fresh, map_slices, worker_cache
from .components import components
from .interpolation import PART_CHARS, SLICE_CHARS, _arrow, _lows, pack_counts, pack_sorted, unpack_counts, unpack_sorted

SHINGLE = 5
SIMILARITY = 0.8
#: A pair at 0.8 shares a band of three samples with probability 0.51, so one of twelve with 0.9998.
BANDS, ROWS = 12, 3
#: Share of the documents from which on a shingle has the weight of its idf (all have), and the weight of one that all have.
COMMON_SHARE, LEAST_IDF = 0.0, 0.5
#: In buckets up to so many members every pair is verified; larger ones go by anchors, hubs and blocks.
SMALL_BUCKET = 8
HUB_ROUNDS = 2
#: Texts on one side of a block comparison.
BLOCK = 256
_EVEN = 1e-9

_M1, _M2, _M3 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_STEP = np.array([(0x9E3779B97F4A7C15 * k | 1) & (1 << 64) - 1 for k in (3, 7, 13, 29, 61)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def normal(text: Column) -> Column:
    """Lower-case words with one blank between; empty for null."""
    gaps = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"  # a single blank, the usual gap, needs no replacement
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), gaps, " ")))


def content_key(norm: Column) -> Column:
    """128 bits for a normal text; null for one without words, which is nobody's duplicate."""
    return F.when(norm != "", F.unhex(F.md5(norm.cast("binary"))))


#: A random number per byte, and the odd base of the words' polynomials with its inverse modulo 2^64.
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)
_BASE = 0x9FB21C651E98DF25
_UNBASE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), base, np.uint64))])


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words between single blanks; equal words hash alike wherever they stand."""
    raw = np.frombuffer(text, np.uint8)
    cache = worker_cache("powers")
    if len(cache.get("up", ())) <= len(raw):
        n = max(1 << 20, 2 * len(raw))
        cache["up"], cache["down"] = _powers(_BASE, n), _powers(_UNBASE, n)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * cache["up"][: len(raw)], out=total[1:])
    blanks = np.flatnonzero(raw == 32)
    start, end = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(raw)]])
    return _mix((total[end] - total[start]) * cache["down"][start] + (end - start).astype(np.uint64))


def shingle_lists(norms: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the sorted 64-bit hashes of its distinct shingles of five words, and how often each occurs.

    A text of fewer words is one shingle. Several texts are hashed in one go, up to a few megabytes.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for at, stop in _runs([len(t) for t in norms], 1 << 20):
        raw = [t.encode("utf-8", "surrogatepass") for t in norms[at:stop]]
        w = word_hashes(b" ".join(raw))
        h = np.zeros(max(len(w) - SHINGLE + 1, 0), np.uint64)
        for i in range(SHINGLE):
            h += w[i : i + len(h)] * _STEP[i]
        h = _mix(h)
        first = 0
        for text in raw:
            n = text.count(b" ") + 1
            if n >= SHINGLE:
                mine = h[first : first + n - SHINGLE + 1]
            else:
                mine = _mix((w[first : first + n] * _STEP[:n]).sum(keepdims=True, dtype=np.uint64))
            out.append(np.unique(mine, return_counts=True))
            first += n
    return out


def _runs(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Cut a list into runs of about ``most`` in sum."""
    out, at, held = [], 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most:
            out.append((at, i + 1))
            at, held = i + 1, 0
    return [*out, (at, len(sizes))] if at < len(sizes) else out


def shingles(norm: str) -> tuple[np.ndarray, np.ndarray]:
    return shingle_lists([norm])[0]


@dataclass(frozen=True)
class Weights:
    """IDF of the common shingles (sorted); all others weigh 1, as those of one text do."""

    common: np.ndarray
    idf: np.ndarray

    def of(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = 1 + np.log(counts)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, hashes), len(self.common) - 1)
            out *= np.where(self.common[at] == hashes, self.idf[at], 1.0)
        return out

    def weigh(self, norm: str) -> tuple[np.ndarray, np.ndarray]:
        return self.weigh_all([norm])[0]

    def weigh_all(self, norms: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(hashes, self.of(hashes, counts)) for hashes, counts in shingle_lists(norms)]


def idf(df: float | np.ndarray, n: int) -> float | np.ndarray:
    """Weight of the shingles that ``df`` of ``n`` texts have: falls with the logarithm from 1 (one text) to ``LEAST_IDF`` (all).

    Fewer than ten texts count as ten: what two of three share is not common for that.
    """
    return 1 - (1 - LEAST_IDF) * np.log(df) / np.log(max(n, 10))


REQUEST = "part long, slice long, size int, hashes binary, seen binary"
ANSWER = "slice long, part long, size int, seen binary"


def _requests(parts: int):
    """The distinct shingles of a slice by ranges of hashes, each with the number of the slice's texts that have it."""
    schema = StructType.fromDDL(REQUEST)

    def run(key, table):
        rows = []
        found = shingle_lists([t for t in table["norm"].to_pylist() if t])
        if found:
            distinct, seen = np.unique(np.concatenate([h for h, _ in found]), return_counts=True)
            lows = _lows(parts)
            cuts = [*np.searchsorted(distinct, np.array(lows, np.uint64)), len(distinct)]
            for part in range(parts):
                a, b = cuts[part], cuts[part + 1]
                if a < b:
                    rows.append((part, key[0].as_py(), b - a, pack_sorted(distinct[a:b], lows[part]), pack_counts(seen[a:b])))
        return _arrow(rows, schema)

    return run


def _answers(parts: int):
    """How many texts of all have the shingles of a range of hashes, for every slice that asks."""
    schema = StructType.fromDDL(ANSWER)

    def run(key, table):
        part = key[0].as_py()
        asked = table.select(["slice", "size", "hashes", "seen"]).to_pylist()
        low = _lows(parts)[part]
        hashes = np.concatenate([unpack_sorted(r["hashes"], r["size"], low) for r in asked])
        distinct, at = np.unique(hashes, return_inverse=True)
        seen = np.concatenate([unpack_counts(r["seen"], r["size"]) for r in asked])
        total = np.bincount(at, seen, len(distinct)).astype(np.int64)[at]
        ends = np.cumsum([r["size"] for r in asked])
        return _arrow([(r["slice"], part, r["size"], pack_counts(total[e - r["size"] : e])) for r, e in zip(asked, ends, strict=True)], schema)

    return run


def weigh(counts: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    return (1 + np.log(counts)) * idf(df, n)


def _weighed(norm: str, df: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = shingles(norm)
    return hashes, weigh(counts, unpack_counts(df, len(hashes)), n)


def _sketched(docs: DataFrame) -> tuple[DataFrame, int]:
    """``doc_id, key, weight, bands, norm, df`` of every row, and the number of those with words.

    ``df`` has for each of the text's distinct shingles (by hash) how many rows have it. All are counted exactly: rows are
    dealt to slices, a slice asks once for each of its distinct shingles, the requests of a range of hashes meet in one
    task, and the sums go back to the slices that asked. The texts are shuffled once for both.
    """
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    chars, n = docs.agg(F.sum(F.octet_length("text")), F.count_if(worded)).first()
    slices, parts = (-(-(chars or 0) // size) or 1 for size in (SLICE_CHARS, PART_CHARS))
    norms = docs.select("doc_id", normal(F.col("text")).alias("norm")).select("doc_id", content_key(F.col("norm")).alias("key"), "norm")
    # copies of a text go to different slices
    rows = norms.withColumn("slice", F.pmod(F.xxhash64("doc_id", "key"), F.lit(slices)))
    asked = rows.groupBy("slice").applyInArrow(_requests(parts), REQUEST)
    answers = asked.groupBy("part").applyInArrow(_answers(parts), ANSWER)
    sampler = Sampler()
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"doc_id {id_kind}, key binary, weight double, bands array<long>, norm string, df binary")

    def sketch(key, texts, totals):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        norms = texts["norm"].to_pylist()
        found = shingle_lists([t for t in norms if t])
        bands, weight, seen = [[] for _ in norms], [0.0] * len(norms), [None] * len(norms)
        if found:
            total = np.concatenate([unpack_counts(r["seen"], r["size"]) for r in sorted(totals.to_pylist(), key=lambda r: r["part"])])
            _, at = np.unique(np.concatenate([h for h, _ in found]), return_inverse=True)
            total = total[at]
            each = weigh(np.concatenate([c for _, c in found]), total, n)
            start = 0
            for i, (h, _) in zip((i for i, t in enumerate(norms) if t), found, strict=True):
                own = slice(start, start + len(h))
                bands[i], weight[i], seen[i] = sampler.band_keys(h, each[own]), float(each[own].sum()), pack_counts(total[own])
                start += len(h)
        out = to_arrow_schema(schema)
        made = {"weight": weight, "bands": bands, "df": seen}
        columns = [pa.array(made[f.name], f.type) if f.name in made else texts[f.name].cast(f.type) for f in out]
        return pa.Table.from_arrays(columns, schema=out)

    sketched = rows.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(sketch, schema)
    return materialize(sketched, "near-sketches", "zstd"), n


def common_shingles(normals: DataFrame, share: float = 0.1) -> Weights:
    """IDF of the shingles that at least a ``share`` of the texts of ``normals`` (``norm``) have, for tables that fit on the driver."""
    sketches, n = _sketched(normals.select(F.lit(None).cast("long").alias("doc_id"), F.col("norm").alias("text")))
    seen: dict[int, int] = {}
    for r in sketches.filter("key is not null").select("norm", "df").collect():
        hashes, _ = shingles(r["norm"])
        seen.update(zip(hashes.tolist(), unpack_counts(r["df"], len(hashes)).tolist(), strict=True))
    common = np.array(sorted(h for h, df in seen.items() if df >= share * n), np.uint64)
    return Weights(common, np.array([idf(seen[int(h)], n) for h in common]))


class Sampler:
    """Improved consistent weighted sampling: one (shingle, level) per hash; equal with the probability of the similarity.

    The variates of a shingle and hash (two of Gamma(2, 1), one uniform) come from one 64-bit product, the former through
    tables of 4,096 quantiles.
    """

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factor = rng.integers(1, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        quantiles = np.sort(rng.gamma(2, 1, 1 << 20)).reshape(1 << 12, -1).mean(1)
        self.r = rng.permutation(quantiles).astype(np.float32)
        self.ln_c = np.log(rng.permutation(quantiles)).astype(np.float32)

    def samples(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        k = len(self.factor)
        best, sample = np.full(k, np.inf, np.float32), np.zeros(k, np.uint64)
        rows = np.arange(k)
        for at in range(0, len(hashes), 1024):
            h = hashes[at : at + 1024]
            x = self.factor[:, None] * h
            halves = x.astype("<u8", copy=False).view("<u4").reshape(*x.shape, 2)
            high = halves[..., 1]
            r = self.r.take(high >> np.uint32(20))
            ln_a = self.ln_c.take((high >> np.uint32(8)) & np.uint32(0xFFF))
            beta = halves[..., 0].astype(np.float32)
            beta *= np.float32(2.0**-32)
            # ln a = ln c - r (level - beta + 1); the level of weight 1 is 0
            ln_a -= r
            ln_a += r * beta
            ln_w = np.log(weights[at : at + 1024]).astype(np.float32)
            other = np.flatnonzero(ln_w)
            levels = np.zeros(x.shape, np.int64) if len(other) else None
            if len(other):
                level = np.floor(ln_w[other] / r[:, other] + beta[:, other])
                ln_a[:, other] -= r[:, other] * level
                levels[:, other] = level
            i = ln_a.argmin(1)
            won = ln_a[rows, i]
            mine = h[i] if levels is None else h[i] + levels[rows, i].astype(np.uint64) * _M1
            take = won < best
            best = np.where(take, won, best)
            sample = np.where(take, _mix(mine), sample)
        return sample

    def band_keys(self, hashes: np.ndarray, weights: np.ndarray) -> list[int]:
        s = self.samples(hashes, weights).reshape(self.bands, self.rows)
        key = np.arange(1, self.bands + 1, dtype=np.uint64) * _M1
        for j in range(self.rows):
            key = _mix(key ^ s[:, j]) + _M1
        return key.astype(np.int64).tolist()


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    (ha, wa), (hb, wb) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    common = hb[at] == ha
    least = np.minimum(wa[common], wb[at[common]]).sum()
    return float(least / (wa.sum() + wb.sum() - least))


def _close(x: str, y: str) -> Column:
    """Weights so far apart that no overlap could reach the similarity are out."""
    return F.least(x, y) >= (SIMILARITY - _EVEN) * F.greatest(x, y)


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("x"), F.greatest(a, b).alias("y")]


def _verify(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """The pairs (``x, y``) whose weighted Jaccard similarity reaches the threshold."""
    a, b = (texts.select(F.col("key").alias(c), F.struct("norm", "df").alias(f"text_{c}")) for c in "xy")

    def work(rows: dict[str, list]) -> dict[str, list]:
        cache: dict[bytes, tuple] = {}
        out: dict[str, list] = {"x": [], "y": []}
        for x, y, text_x, text_y in zip(rows["x"], rows["y"], rows["text_x"], rows["text_y"], strict=True):
            for k, t in ((x, text_x), (y, text_y)):
                if k not in cache:
                    cache[k] = _weighed(t["norm"], t["df"], n)
            if weighted_jaccard(cache[x], cache[y]) >= SIMILARITY - _EVEN:
                out["x"].append(x)
                out["y"].append(y)
        return out

    return map_slices(pairs.join(a, "x").join(b, "y").select("x", "y", "text_x", "text_y"), "x binary, y binary", work)


def _with_class(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` of the buckets in which more than one class is left, with ``class`` and ``links`` (of the member)."""
    label = components(links)
    degree = links.select("x").unionAll(links.select("y")).groupBy("x").agg(F.count(F.lit(1)).alias("links"))
    known = label.join(degree, label["node"] == degree["x"]).select(F.col("node").alias("key"), "class", "links")
    got = members.join(known, "key", "left").withColumns(
        {"class": F.coalesce("class", "key"), "links": F.coalesce("links", F.lit(0))}
    )
    got = materialize(got, "near-members")
    open_ = got.groupBy("bucket").agg((F.min("class") != F.max("class")).alias("open")).filter("open").select("bucket")
    return got.join(open_, "bucket")


def _hub_pairs(members: DataFrame) -> DataFrame:
    """Every member of another class against its bucket's best-linked member."""
    hub = members.groupBy("bucket").agg(F.max(F.struct("links", "key", "weight", "class")).alias("hub"))
    pairs = members.join(hub, "bucket").filter((F.col("class") != F.col("hub.class")) & _close("weight", "hub.weight"))
    return pairs.select(*_pair("key", "hub.key")).distinct()


def _block_links(members: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Exactly the rest: in every bucket, members outside the largest class against all of other classes.

    Blocks of a few hundred texts meet block by block, each meeting a group of its own; inside one, an inverted list
    adds up all overlaps of a text at once, and only one link per text and class leaves it.
    """
    sizes = members.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"))
    shape = sizes.groupBy("bucket").agg(F.sum("n").alias("all"), F.max(F.struct("n", "class")).alias("top"))
    shape = shape.select("bucket", F.ceil(F.col("all") / BLOCK).cast("int").alias("y_blocks"),
                         F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("x_blocks"), F.col("top.class").alias("top_class"))
    placed = members.join(shape, "bucket").select("bucket", "key", "class", "y_blocks", "x_blocks", (F.col("class") != F.col("top_class")).alias("minor"))
    mine = lambda n: F.pmod(F.xxhash64("bucket", "key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.filter("minor").select("bucket", "key", "class", mine("x_blocks").alias("x_block"), every("y_blocks").alias("y_block"), F.lit(True).alias("asks"))
    right = placed.select("bucket", "key", "class", every("x_blocks").alias("x_block"), mine("y_blocks").alias("y_block"), F.lit(False).alias("asks"))
    rows = left.unionByName(right).join(texts, "key")

    def compare(frame):
        import pandas as pd

        own = dict(zip(frame["key"], zip(frame["norm"], frame["df"], strict=True), strict=True))
        bags = {k: _weighed(*t, n) for k, t in own.items()}
        asked, there = frame[frame["asks"]], frame[~frame["asks"]]
        out = []
        if len(asked) and len(there):
            keys, classes = there["key"].tolist(), there["class"].tolist()
            sizes = [len(bags[k][0]) for k in keys]
            owner = np.repeat(np.arange(len(keys)), sizes)
            h, w = (np.concatenate([bags[k][i] for k in keys]) for i in (0, 1))
            order = np.argsort(h, kind="stable")
            h, w, owner = h[order], w[order], owner[order]
            total = np.array([bags[k][1].sum() for k in keys])
            for key, cls in zip(asked["key"], asked["class"], strict=True):
                hx, wx = bags[key]
                lo, hi = np.searchsorted(h, hx, "left"), np.searchsorted(h, hx, "right")
                hits = hi - lo
                at = np.repeat(lo - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())
                both = np.bincount(owner[at], np.minimum(np.repeat(wx, hits), w[at]), len(keys))
                alike = np.flatnonzero(both >= (SIMILARITY - _EVEN) * (total + wx.sum() - both))
                linked = {classes[j]: keys[j] for j in alike if classes[j] != cls}
                out += [(key, k) for k in linked.values()]
        return pd.DataFrame(out, columns=["x", "y"])

    return rows.groupBy("bucket", "x_block", "y_block").applyInPandas(compare, "x binary, y binary").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, key, class, class_id, class_size`` of every row of ``docs`` (``doc_id, text``).

    A class is a connected component of rows whose texts are equal but for case and blanks, or whose TF-IDF shingles
    have a weighted Jaccard similarity of ``SIMILARITY``; its id is the smallest ``doc_id`` in it (null if it has none).
    Texts without words (null, empty, blank) are classes of their own. Repeated rows are members like any.

    Copies collapse to their content first. Contents that share a band meet in a bucket: all pairs of a small one
    are verified; in a larger one every member meets an anchor (another one per band), then the best-linked member, and
    what is still in different classes is compared in blocks. So every pair that shares a band is linked, in one class
    already, or compared; the number of pairs that are ever rows is linear in the members.
    """
    sketches, n = _sketched(docs.select("doc_id", "text"))
    nodes = sketches.filter("key is not null").select("key", "weight", F.explode("bands").alias("bucket")).distinct()
    anchors = nodes.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("bucket", "key").alias("o"), "key", "weight")).alias("anchor")
    )
    members = materialize(nodes.join(anchors.filter("n > 1"), "bucket"), "near-buckets")

    wanted = members.select("key").distinct().join(
        sketches.groupBy("key").agg(F.min("doc_id").alias("one")), "key"
    ).withColumnRenamed("key", "k")
    found = sketches.select("doc_id", "key", "norm", "df").join(wanted, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("one")))
    texts = found.groupBy("key").agg(F.min(F.struct("norm", "df")).alias("text")).select("key", "text.*")
    texts = materialize(texts, "near-texts", "zstd")

    star = members.filter((F.col("n") > SMALL_BUCKET) & (F.col("key") != F.col("anchor.key")) & _close("weight", "anchor.weight"))
    small = members.filter(F.col("n") <= SMALL_BUCKET).groupBy("bucket").agg(F.collect_list(F.struct("key", "weight")).alias("m"))
    small = small.select("m", F.explode("m").alias("a")).select("a", F.explode("m").alias("b"))
    small = small.filter((F.col("a.key") < F.col("b.key")) & _close("a.weight", "b.weight"))
    pairs = star.select(*_pair("key", "anchor.key")).unionByName(small.select(*_pair("a.key", "b.key"))).distinct()
    links = materialize(_verify(pairs, texts, n), "near-links")

    large = members.filter(F.col("n") > SMALL_BUCKET).select("bucket", "key", "weight")
    for turn in range(HUB_ROUNDS + 1):
        if large.isEmpty():
            break
        large = materialize(_with_class(large, links), "near-open")
        if large.isEmpty():
            break
        more = _verify(_hub_pairs(large), texts, n) if turn < HUB_ROUNDS else _block_links(large, texts, n)
        links = materialize(links.unionByName(more).distinct(), "near-links")
        large = large.select("bucket", "key", "weight")

    label = components(links).select(F.col("node").alias("key"), "class")
    each = sketches.select("doc_id", "key").join(label, "key", "left").withColumn("class", F.coalesce("class", "key"))
    each = materialize(each, "near-classes")
    size = each.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    alone = F.col("class").isNull()
    return each.join(size, "class", "left").select(
        "doc_id", "key", "class",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, 1).otherwise(F.col("class_size")).cast("long").alias("class_size"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` (any columns besides ``doc_id, text``) with one row of each class: its smallest id, then content.

    Rows without words all stay. Of rows that repeat both id and content one stays.
    """
    found = classes(docs.select("doc_id", "text")).filter("class is not null")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    kept = found.groupBy("class").agg(F.min(rank).alias("kept"))
    key, kept_id, kept_key = (fresh(docs, c) for c in ("content_key", "kept_id", "kept_key"))
    keep = kept.select(F.col("kept.doc_id").alias(kept_id), F.col("kept.key").alias(kept_key))
    keyed = docs.withColumn(key, content_key(normal(F.col("text"))))
    joined = keyed.join(keep, keyed["doc_id"].eqNullSafe(keep[kept_id]) & (keyed[key] == keep[kept_key]), "left")
    out = joined.filter(F.col(key).isNull() | F.col(kept_key).isNotNull())
    repeated = found.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        # rows that are alike in id and content: any one of them, by its other columns
        lone, shared = out.filter(F.col(key).isNull()), out.filter(F.col(key).isNotNull()).dropDuplicates(["doc_id", key])
        out = lone.unionByName(shared)
    return out.select(*docs.columns)
