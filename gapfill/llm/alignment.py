"""Alignment of two tokenizers' tokens over the same bytes, by diagonal run skipping.

Both token lists become rising arrays of byte ends. While the tokens correspond one to one, the arrays are equal along
a diagonal: ``ends_a[i] == ends_b[i + shift]``. A run is followed by exponential probing (16, 32, 64, ... entries
compared at once, then bisection in the stretch that differs) and jumped in one go. Where the diagonal breaks, the
group is resolved token by token up to the next common end, and the shift becomes the new difference of the indices.

Tokenizing and aligning are one map over the documents. What is counted over the corpus, the documents that hold an id
pair linked, is summed by Spark; a pair's count goes back to its documents by a broadcast of the frequent pairs (their
number is bounded) and a shuffle join of the rare ones.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gapfill.session import materialize

from .common import map_slices, worker_cache

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Id pairs that are broadcast with their counts (16 bytes each); beyond, the rest of them is joined by shuffle.
MAX_BROADCAST_PAIRS = 2_000_000
#: Entries of the first probe along a diagonal. Runs of words' tokens are nine long on average, so most end before it.
PROBE = 16


#: Texts of these characters alone fall into the same pieces whatever Unicode version a library knows.
STABLE = re.compile(r"[\t\n\r\x20-\x7E\u00A1-\u00AC\u00AE-\u024F]*")
#: How a byte-level vocabulary's text is cut before merging (a fixed value of that kind of tokenizer).
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabularies:
    """Both tokenizers and the bytes of their entries."""

    def __init__(self, first: str, second: str):
        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = sorted(set(range(256)) - set(shown))
        #: The byte that each letter of a byte-level vocabulary stands for.
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.bytes_a = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            known = all(c in byte_of for c in token)
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if known else token.encode()
        self.bytes_b = [_piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.table_a, self.table_b = (np.array(table, object) for table in (self.bytes_a, self.bytes_b))
        self.size_a, self.size_b = (np.array([len(x) for x in table]) for table in (self.bytes_a, self.bytes_b))
        self.names = group_names(len(self.bytes_a), len(self.bytes_b))
        self.merger = self._merger(first)

    def _merger(self, path: str):
        """A faster merger of the same vocabulary, where ids tell the order of the merges; else None. It cuts bytes, so it
        gives them all back."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        model, cut = kind["model"], kind["pre_tokenizer"] or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not kind["normalizer"]
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", ())]
        if not plain or any(model["vocab"].get(m) != 256 + i for i, m in enumerate(merges)):
            return None
        special = {t["id"] for t in kind["added_tokens"]}
        ranks = {self.bytes_a[i]: i for i in range(256 + len(merges)) if i not in special}
        return tiktoken.Encoding("aligned", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def first_ids(self, text: str):
        import numpy as np

        if self.merger and STABLE.fullmatch(text):
            return self.merger.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        return np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)

    def encode(self, text: str):
        """Ids of both; none if the text is empty or either's bytes are not those of a blank and the text."""
        import numpy as np

        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not text:
            return nothing
        a = self.first_ids(" " + text)
        b = np.array(self.b.encode(text, num_threads=1), np.int64)
        want = (" " + text).encode()
        if len(want) != self.size_a[a].sum() or len(want) != self.size_b[b].sum():
            return nothing
        for ids, table in ((a, self.table_a), (b, self.table_b)):
            if b"".join(table[ids].tolist()) != want:
                return nothing
        return a, b


def _piece_bytes(piece: str) -> bytes:
    byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()


def vocabularies(first: str, second: str) -> Vocabularies:
    """The worker's own tokenizers for two vocabulary files: paths, or names among the public tokenizers."""
    cache = worker_cache("aligned")
    if (first, second) not in cache:
        paths = (first, second)
        if not all("/" in p for p in paths):
            import public_tokenizers

            paths = tuple(p if "/" in p else public_tokenizers.path(p) for p in paths)
        cache[first, second] = Vocabularies(*paths)
    return cache[first, second]


def run_length(a: list[int], b: list[int], i: int, j: int) -> int:
    """How many entries of ``a`` from ``i`` equal those of ``b`` from ``j``.

    Exponential probing: stretches of ``PROBE`` entries, twice that, and so on are compared at once; the one that differs
    is halved down to ``PROBE`` entries, which are looked at one by one.
    """
    most = min(len(a) - i, len(b) - j)
    done, step = 0, PROBE
    while step <= most - done and a[i + done : i + done + step] == b[j + done : j + done + step]:
        done += step
        step *= 2
    step = min(step, most - done)
    while step > PROBE:
        half = step // 2
        if a[i + done : i + done + half] == b[j + done : j + done + half]:
            done += half
            step -= half
        else:
            step = half
    i, j = i + done, j + done
    for x, y in zip(a[i : i + step], b[j : j + step], strict=True):
        if x != y:
            break
        done += 1
    return done


def align(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """All overlapping entries of two rising lists of ends with the same last end, as two lists of indices, in order.

    A run on the diagonal gives one to one links; a group off it is resolved by merging its ends, which gives its links,
    and where it closes gives the new shift.
    """
    left: list[int] = []
    right: list[int] = []
    i = shift = 0
    last = len(a)
    short = min(last, len(b)) - PROBE
    while i < last:
        j = i + shift
        x, y = a[i], b[j]
        if x == y:
            # Most runs are shorter than the first probe, so that one is made here.
            if i <= short and j <= short and a[i : i + PROBE] == b[j : j + PROBE]:
                n = PROBE + run_length(a, b, i + PROBE, j + PROBE)
            else:
                n = 1
                while i + n < last and a[i + n] == b[j + n]:
                    n += 1
            left += range(i, i + n)
            right += range(j, j + n)
            i += n
            continue
        while x != y:
            left.append(i)
            right.append(j)
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        left.append(i)
        right.append(j)
        i, shift = i + 1, j - i
    return left, right


def group_names(n_a: int, n_b: int) -> tuple:
    """How ids are written: within a group of the first side, as its last; the same for the second side."""
    import numpy as np

    return tuple(np.array([f"{i}{mark}" for i in range(n)], object) for n, marks in ((n_a, ",|"), (n_b, ",;")) for mark in marks)


def groups_text(a, b, last_a, last_b, names: tuple) -> str:
    """``a1,a2|b1;a3|b2,b3`` of two arrays of ids and the last index of every group on both sides.

    Every id has its place among those of both sides, group by group.
    """
    import numpy as np

    out = np.empty(len(a) + len(b), object)
    for ids, mine, other, plain, closing, after in ((a, last_a, last_b, names[0], names[1], 0), (b, last_b, last_a, names[2], names[3], 1)):
        group = np.zeros(len(ids) + 1, np.int64)
        group[mine + 1] = 1
        group = group.cumsum()[:-1]
        before = np.concatenate([[0], other + 1])[group + after]  # ids of the other side that stand before
        shown = plain[ids]
        shown[mine] = closing[ids[mine]]
        out[np.arange(len(ids)) + before] = shown
    return "".join(out.tolist())[:-1]


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text", first: str = FIRST, second: str = SECOND, keep_groups: bool = False) -> DataFrame:
    """Per row: ``key, n_a, n_b, n_groups, n_links, groups_sha256``, its distinct linked ``pairs`` and their ``times``.

    A pair is ``a`` times ``width`` (also a column) plus ``b``. With ``keep_groups`` the groups themselves come as ``groups``.
    """
    import numpy as np

    kind = docs.schema[key].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, width long, pairs array<long>, times array<int>"
    schema += ", groups string" * keep_groups

    def work(rows):
        both = vocabularies(first, second)
        width = len(both.bytes_b)
        out: dict[str, list] = {n: [] for n in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "groups")}
        for text in rows["text"]:
            a, b = both.encode(text)
            ends_a, ends_b = both.size_a[a].cumsum(), both.size_b[b].cumsum()
            left, right = (np.array(side, np.int64) for side in align(ends_a.tolist(), ends_b.tolist()))
            closes = ends_a[left] == ends_b[right]  # a group's last link
            groups = groups_text(a, b, left[closes], right[closes], both.names)
            ids = a[left] * width + b[right]
            pairs, times = np.unique(ids, return_counts=True)
            out["n_a"].append(len(a))
            out["n_b"].append(len(b))
            out["n_groups"].append(int(closes.sum()))
            out["n_links"].append(len(left))
            out["groups_sha256"].append(hashlib.sha256(groups.encode()).hexdigest() if len(a) else "")
            out["pairs"].append(pairs)
            out["times"].append(times.astype(np.int32))
            out["groups"].append(groups)
        return out | {"id": rows["id"], "width": [width] * len(rows["id"])}

    return map_slices(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), schema, work).withColumnRenamed("id", key)


def pair_counts(found: DataFrame) -> DataFrame:
    """``pair, documents, best``: how many rows hold a pair linked, and whether no pair of its first id has more.

    Task-side partial counts make a pair that every document holds one row per task.
    """
    counts = found.select("width", F.explode("pairs").alias("pair")).groupBy("width", "pair").agg(F.count(F.lit(1)).alias("documents"))
    counts = materialize(counts.withColumn("a", F.expr("pair div width")).drop("width"), "pair-counts")
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))
    # One row per id of the first vocabulary.
    return counts.join(most, "a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def link_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", first: str = FIRST, second: str = SECOND) -> DataFrame:
    """Per row: ``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    Null and empty texts, and those a tokenizer does not give back byte by byte, have no tokens: zeros and ''. Repeated
    rows and keys are aligned and counted each, a null key stays null, other columns are not read. Ties for an id's best
    partner all count. An empty table gives no rows. A task holds ``BATCH_ROWS`` texts at a time, however long.
    """
    numbered = materialize(aligned(docs.select(key, text), key, text, first, second).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = materialize(pair_counts(numbered), "pair-best")
    held = numbered.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("_row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")
    total = F.sum(F.col("times") * F.col("documents")).alias("count_sum")

    def joined(table: DataFrame, over: DataFrame) -> DataFrame:
        return over.join(table, "pair").groupBy("_row").agg(best, total)

    size = counts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("documents"), F.lit(0)).alias("all")).first()
    if size["n"] <= MAX_BROADCAST_PAIRS:
        sums = joined(F.broadcast(counts), held)
    else:
        # At most MAX_BROADCAST_PAIRS pairs can be held by this many documents; no rarer pair can crowd one task.
        often = -(-size["all"] // MAX_BROADCAST_PAIRS)
        frequent = F.broadcast(counts.filter(F.col("documents") >= often))
        rare = counts.filter(F.col("documents") < often)
        rest = held.join(frequent.select("pair"), "pair", "left_anti")
        sums = joined(frequent, held).unionByName(joined(rare, rest)).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = numbered.drop("pairs", "times", "width").join(sums, "_row", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        key, "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
