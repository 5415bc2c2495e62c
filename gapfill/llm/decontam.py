"""Benchmark decontamination: a broadcast hash set of item windows, scanned over every document window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfill.session import materialize

from .common import fresh, let, put, text_key

WINDOW = 10
#: Distinct item windows that are sent to every executor (about 200 bytes each); more are joined by shuffle.
MAX_BROADCAST_WINDOWS = 500_000
#: Texts with hits that are sent to every executor where the windows are not.
MAX_BROADCAST_TEXTS = 20_000
SALTS = 8
# Fixed by the contract: what is no digit, a-z or non-ASCII character separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` does just that where all characters are ASCII."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """Normalised words of a text; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _starts(n: Column, length: int) -> Column:
    """0 .. n - length, or nothing."""
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: ``h, len, gram`` (its words) and ``items`` (ids as strings, sorted)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    items = items.filter(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(window)))
    grams = items.select(
        "item",
        "len",
        F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("len")), lambda i: F.slice("w", i + 1, F.col("len")))).alias("gram"),
    )
    grams = grams.groupBy("len", "gram").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return grams.select(_hash(F.col("gram")).alias("h"), "len", "gram", "items")


def _hash(gram: Column) -> Column:
    return F.xxhash64(F.transform(gram, lambda w: F.xxhash64(w)))


def _scan(docs: DataFrame, benchmark: DataFrame, columns: list[str], window: int) -> DataFrame:
    """One row ``len = 0`` per document and one per verified window: ``columns, key, n_words, start, len, items``.

    All documents are read once. Every window hash meets the item windows in a hash join that sends the
    items, not the documents; what the hash finds is compared word by word.
    """
    grams = item_windows(benchmark, window)
    lengths = sorted(r[0] for r in grams.select("len").distinct().collect())
    small = grams.limit(MAX_BROADCAST_WINDOWS + 1).count() <= MAX_BROADCAST_WINDOWS
    mark = grams.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("h"), F.lit(0).alias("len"),
        F.array().cast("array<string>").alias("gram"), F.array().cast("array<string>").alias("items"),
    )
    grams = grams.unionByName(mark).withColumnsRenamed({"len": "glen"})

    def of_length(n: Column, wh: Column, k: int) -> Column:
        at = lambda i: F.struct(F.lit(k).alias("len"), i.alias("start"), F.xxhash64(F.slice(wh, i + 1, k)).alias("h"))
        return F.transform(_starts(n, k), at)

    def hashes(n: Column, wh: Column) -> Column:
        first = F.struct(F.lit(0).alias("len"), F.lit(0).alias("start"), F.lit(0).cast("long").alias("h"))
        return F.concat(F.array(first), *(of_length(n, wh, k) for k in lengths))

    w = docs.select(*columns, text_key(F.col("text")).alias("key"), words(F.col("text")).alias("w"))
    if not small:
        return _scan_by_shuffle(w, grams.filter("glen > 0"), columns, lengths, of_length)
    wide = w.select(
        *columns, "key", "w", F.size("w").alias("n_words"),
        F.inline(let(F.transform("w", lambda x: F.xxhash64(x)), lambda wh: hashes(F.size(wh), wh))),
    )
    same = (wide["h"] == grams["h"]) & (F.col("len") == F.col("glen")) & (F.slice("w", F.col("start") + 1, F.col("len")) == F.col("gram"))
    found = wide.join(F.broadcast(grams), same)
    return found.select(*columns, "key", "n_words", "start", "len", "items")


def _scan_by_shuffle(w: DataFrame, grams: DataFrame, columns: list[str], lengths: list[int], of_length) -> DataFrame:
    """What :func:`_scan` gives, with more item windows than may be broadcast.

    Only the hashes of windows meet, as ``key, start, len, h`` of each distinct text; words are fetched for what they hit.
    A window that many texts share is dealt to ``SALTS`` tasks.
    """
    texts = w.select("key", "w").dropDuplicates(["key"])
    windows = texts.select(
        "key", F.inline(let(F.transform("w", lambda x: F.xxhash64(x)), lambda wh: F.concat(*(of_length(F.size(wh), wh, k) for k in lengths))))
    ).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    names = grams.select("h", F.col("glen").alias("len")).distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = windows.join(names, ["h", "len", "salt"]).groupBy("key").agg(F.collect_set(F.struct("start", "len", "h")).alias("hits"))
    at = F.transform("hits", lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len"), x["h"].alias("h"), F.slice("w", x["start"] + 1, x["len"]).alias("gram")))
    spots = texts.join(hits, "key").select("key", F.inline(at))
    known = grams.withColumnRenamed("glen", "len")
    real = spots.join(known, ["h", "len", "gram"]).groupBy("key").agg(F.collect_list(F.struct("start", "len", "items")).alias("found"))
    # One row per text that is hit; the documents stay where they are as long as these may be broadcast.
    real = materialize(real, "decontam-hits")
    few = real.limit(MAX_BROADCAST_TEXTS + 1).count() <= MAX_BROADCAST_TEXTS
    none = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("len"), F.array().cast("array<string>").alias("items")))
    rows = w.select(*columns, "key", F.size("w").alias("n_words")).join(F.broadcast(real) if few else real, "key", "left")
    return rows.select(*columns, "key", "n_words", F.inline(F.concat(none, F.coalesce("found", F.slice(none, 1, 0)))))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Which words of every document lie in an item's window, and whose.

    ``docs`` has ``doc_id, text``; ``benchmark`` has ``item_id, text``. Returns per document ``doc_id, key``
    (of the text), ``n_words, hits`` (sorted indices of words), ``items`` (ids as strings, sorted).

    Null texts have no words; so have empty ones. Repeated rows and repeated or null ids are judged row by
    row. Items without words and empty tables hit nothing. An item with a null id hits but is not named.
    A group holds what one document has, so its size is bounded by the text.
    """
    found = _scan(docs, benchmark, ["doc_id"], window)
    real = F.col("len") > 0
    grouped = found.groupBy("doc_id", "key", "n_words").agg(
        F.sum(F.when(real, 0).otherwise(1)).alias("rows"),
        F.collect_set(F.when(real, F.struct("start", "len", "items"))).alias("found"),
    )
    hits = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda f: F.sequence(f["start"], f["start"] + f["len"] - 1)))))
    return grouped.select(
        "doc_id", "key", "n_words", hits.alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda f: f["items"])))).alias("items"),
        F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))).alias("one"),
    ).drop("one")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """``docs`` (any columns besides ``text``) without contaminated documents, or without the hit words.

    With ``remove="spans"`` each hit word goes together with the separators after it; the rest of the text
    stays as it is. Rows whose text is null or has no words are kept.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    key = fresh(docs, "text_key")
    keyed = docs.withColumn(key, text_key(docs["text"]))
    found = _scan(docs.select("text"), benchmark, [], window).filter(F.col("len") > 0)
    if remove == "documents":
        bad = found.select(F.col("key").alias(key)).distinct()
        return keyed.join(bad, key, "left_anti").select(*docs.columns)
    spots = found.groupBy(F.col("key").alias(key)).agg(F.collect_set(F.struct("start", "len")).alias("found"))
    name = fresh(keyed, "hit_words")
    spots = spots.select(
        key,
        F.array_distinct(F.flatten(F.transform("found", lambda f: F.sequence(f["start"], f["start"] + f["len"] - 1)))).alias(name),
    )
    joined = keyed.join(spots, key, "left")
    rest = F.when(F.col(name).isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col(name)))
    return put(joined, text=rest).select(*docs.columns)


def _without(text: Column, hits: Column) -> Column:
    """The text without the words at these indices and what separates them from the next word."""
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(f"({WORD})"), 1).alias("word"),
        F.split(text, WORD).alias("gap"),
    )

    def build(p: Column) -> Column:
        flags = F.array_except(F.sequence(F.lit(0), F.size(p["word"]) - 1), hits)
        kept = F.transform(flags, lambda i: F.concat(F.get(p["word"], i), F.get(p["gap"], i + 1)))
        return F.concat(F.get(p["gap"], F.lit(0)), F.array_join(kept, ""))

    return let(parts, build)
