"""Line deduplication: chunks of lines whose ends lie in the lines themselves, of which every repeat but the first goes.

Windows of lines add the repeats that lie across the ends of chunks.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfill.session import materialize

from .common import fresh, let, map_slices, put, text_key

#: For chunks side by side: factors of the rolling hashes, and whether long lines stand alone; each makes its own chunks
#: of a text, so a passage that one cuts badly another may find. A last family has the whole text as its one chunk, which
#: finds copies at once.
FAMILIES = ((1_000_003, True), (7_368_787, False))
WHOLE = len(FAMILIES)
#: The family of the windows, which may overlap.
WINDOW = WHOLE + 1
MODULUS = 2_147_483_647
#: One line in so many ends a chunk.
DIVISOR = 2
#: A line of so many words is a chunk of its own.
LONG_WORDS = 50
#: Chunks count from two lines and so many words on, or as one long line.
MIN_WORDS = 10


def line_hash(line: bytes) -> int:
    return int.from_bytes(hashlib.md5(line).digest()[:4], "big")


def windows(words: list[int]) -> list[tuple[int, int]]:
    """``(first line, lines)`` of the least chunks of a text with so many words in its lines, in order.

    From each line with words on, the shortest stretch of two such lines and ``MIN_WORDS``, and the shortest that ends at
    it; a line of ``MIN_WORDS`` with a blank one next to it; a line of ``LONG_WORDS`` alone. What lies around a passage
    has no say in its windows, and they cover it: a line behind the shortest stretch from the passage's first line ends
    a stretch that is no longer than the passage. So a repeated passage goes whole, but for blank lines at its ends.
    """
    worded = [i for i, n in enumerate(words) if n]
    out = set()
    for at, i in enumerate(worded):
        for step in (1, -1):
            n, to = words[i], at + step
            while 0 <= to < len(worded):
                n += words[worded[to]]
                if n >= MIN_WORDS:
                    out.add((min(i, worded[to]), abs(i - worded[to]) + 1))
                    break
                to += step
        if words[i] >= LONG_WORDS:
            out.add((i, 1))
        if words[i] >= MIN_WORDS:
            out.update((min(i, j), 2) for j in (i - 1, i + 1) if 0 <= j < len(words) and not words[j])
    return sorted(out)


def chunks(text: str, families: tuple[tuple[int, bool], ...] | None = None) -> list[tuple[int, int, int, int]]:
    """``(first line, lines, family, 64-bit hash)`` of the chunks that count: side by side, the whole text, and windows.

    Of chunks side by side one ends after a line whose rolling hash with the line before it is a multiple of ``DIVISOR``,
    and in some families around long lines. Inserted lines only change the chunks next to them, but a passage's first and
    last lines often share a chunk with lines around it, and then stay. The windows find this rest, so that a repeated
    run goes whole; with ``families`` given, those chunks and the whole text are all.
    """
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    words = [len(line.split()) for line in lines]
    hashes = [line_hash(line) for line in lines]
    out = []

    def put(start: int, stop: int, family: int) -> None:
        n = sum(words[start:stop])
        if n >= LONG_WORDS or (stop - start > 1 and n >= MIN_WORDS):
            digest = hashlib.md5(b"\n".join(lines[start:stop]), usedforsecurity=False).digest()
            out.append((start, stop - start, family, int.from_bytes(digest[:8], "big", signed=True) ^ family))

    covered = set(windows(words) if families is None else ())
    for start, n in sorted(covered):
        put(start, start + n, WINDOW)
    for f, (factor, alone) in enumerate(FAMILIES if families is None else families):
        start, before = 0, 0
        for i, h in enumerate(hashes):
            last = i + 1 == len(lines)
            ends = (before * factor + h) % MODULUS % DIVISOR == 0
            before = h
            if last or ends or alone and (words[i] >= LONG_WORDS or words[i + 1] >= LONG_WORDS):
                if (start, i + 1 - start) not in covered:  # equal lines make equal windows, one row will do
                    put(start, i + 1, f)
                start = i + 1
    put(0, len(lines), WHOLE)
    return out


def _id_kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _chunk_rows(docs: DataFrame, families: tuple[tuple[int, bool], ...] | None) -> DataFrame:
    """``doc_id, key`` (of the text), ``start, n, h``: a row per chunk that counts, and one of ``n = 0`` per document."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("doc_id", "key", "start", "n", "h")}
        for doc, key, text in zip(rows["doc_id"], rows["key"], rows["text"], strict=True):
            for start, n, _, h in (*(chunks(text, families) if text else ()), (text.count("\n") + 1 if text else 0, 0, 0, 0)):
                for c, v in zip(out, (doc, key, start, n, h), strict=True):
                    out[c].append(v)
        return out

    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    return map_slices(keyed, f"doc_id {_id_kind(docs)}, key binary, start int, n int, h long", work)


def repeats(docs: DataFrame, families: tuple[tuple[int, bool], ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """All chunk rows, and those that repeat an earlier chunk byte for byte (``doc_id, key, start, n``).

    The order is that of ``doc_id`` (null last), text and line. Hashes find the groups by sums that are formed before
    the shuffle; only documents with a chunk of such a group are then cut again, and each chunk's bytes are compared
    with the first one's. No step gathers a group: its members meet the one kept chunk in a join.
    """
    rows = materialize(_chunk_rows(docs, families), "line-chunks")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "start")
    groups = rows.filter("n > 0").groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    member = rows.filter("n > 0").join(groups.select("h", "first"), "h")
    member = member.select("doc_id", "key", "start", "n", "h", (place == F.col("first")).alias("is_first"))
    per_doc = member.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "n", "h", "is_first")).alias("found"))
    texts = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    both = texts.join(per_doc.withColumnsRenamed({"doc_id": "d", "key": "k"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
    cut = both.select("doc_id", "key", F.split("text", "\n").alias("lines"), F.inline("found"))
    cut = cut.select("doc_id", "key", "start", "n", "h", "is_first", F.array_join(F.slice("lines", F.col("start") + 1, F.col("n")), "\n").alias("chunk"))
    cut = materialize(cut, "line-repeats")
    # rows of one id and text are alike, so several can hold a group's first chunk
    first = cut.filter("is_first").groupBy("h").agg(F.min("chunk").alias("kept"))
    same = cut.filter("not is_first").join(first, "h").filter(F.col("chunk") == F.col("kept"))
    return rows, same.select("doc_id", "key", "start", "n")


def _lines_of(found: DataFrame) -> DataFrame:
    """``doc_id, key, removed``: sorted indices of the lines that go."""
    spans = found.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    lines = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))
    return spans.select("doc_id", "key", F.array_sort(F.array_distinct(lines)).alias("removed"))


def find(docs: DataFrame, families: tuple[tuple[int, bool], ...] | None = None) -> DataFrame:
    """``doc_id, n_lines, removed`` (indices of lines, sorted) of every row of ``docs`` (``doc_id, text``).

    Null and empty texts have no line (0) and lose none. Rows that repeat both id and text are alike: each keeps what one
    of them keeps. Repeated texts under other ids lose all their chunks. An empty table gives an empty result.
    ``families`` is that of :func:`chunks`; without it windows join the chunks, and every repeated run of two lines and
    ``MIN_WORDS`` goes whole.
    """
    rows, found = repeats(docs, families)
    lost = _lines_of(found).withColumnsRenamed({"doc_id": "d", "key": "k"})
    each = rows.filter("n = 0").select("doc_id", "key", F.col("start").alias("n_lines"))
    joined = each.join(lost, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    return joined.select("doc_id", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def dedup(docs: DataFrame, drop_emptied: bool = True) -> DataFrame:
    """``docs`` (any columns besides ``doc_id, text``) without the repeated lines.

    With ``drop_emptied``, documents that lose all they had go; those that were null or empty before stay as they are.
    """
    _, found = repeats(docs)
    key, lost, lost_id, lost_key = (fresh(docs, c) for c in ("text_key", "lines_lost", "lost_id", "lost_key"))
    gone = _lines_of(found).withColumnsRenamed({"doc_id": lost_id, "key": lost_key, "removed": lost})
    keyed = docs.withColumn(key, text_key(F.col("text")))
    joined = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone[lost_id]) & (keyed[key] == gone[lost_key]), "left")

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    out = put(joined, text=F.when(F.col(lost).isNull(), F.col("text")).otherwise(let(F.split(F.col("text"), "\n"), rest)))
    if drop_emptied:
        out = out.filter(F.col(lost).isNull() | F.col("text").rlike(r"\S"))  # of a text that lost nothing, anything stays
    return out.select(*docs.columns)
