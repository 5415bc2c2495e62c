"""Packing: documents are routed to context-size tiers; each tier's windows are filled up from shorter documents."""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict, deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import by_bytes, worker_cache

MAX_TOKENS = 2048
#: Context sizes; every one is a power of two, so a full window needs no padding.
TIERS = (256, 512, 1024, 2048)
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Tokens of one training step; every tier's windows are dealt to steps of about that many.
STEP_TOKENS = 1 << 17
#: Tokens that a task holds before it closes windows.
HELD_TOKENS = 1 << 22
CACHED_WORDS = 600_000
#: Text that is tokenized at once.
SLICE_BYTES = 4 << 20
#: Counts per task and tier that are sent to every executor (40 bytes each); more are joined by shuffle.
MAX_BROADCAST_COUNTS = 1_000_000


class WordIds:
    """Ids of what stands between blanks, learned from the tokenizer as words come up.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words. Words
    of plain Latin letters go to the vocabulary's merges directly; anything else goes to the whole tokenizer.
    """

    PLAIN = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]{1,1000})(?P<tail>[.,!|#*$%&;:?]*)$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.core: dict[str, bytes] = {"": b""}
        self.other: dict[str, bytes] = {"": b""}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        #: The letter by which a byte-level vocabulary writes each byte.
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _core(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join(self.letters[b] for b in word.encode())
        return array("I", [t.id for t in self.merge(shown)]).tobytes()

    def _other(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _look_up(self, words: list[str], cache: dict[str, bytes], make) -> list[bytes]:
        out = []
        for word in words:
            ids = cache.get(word)
            if ids is None:
                ids = make(word)
                if len(word) < 100:
                    if len(cache) >= CACHED_WORDS:
                        cache.clear()
                    cache[word] = ids
            out.append(ids)
        return out

    def ids(self, texts):
        """Ids of all texts of an Arrow column, one after the other, and how many each text has."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary
        parts = pc.extract_regex(distinct, self.PLAIN)
        plain = pc.is_valid(parts)
        core = pc.utf8_lower(pc.fill_null(parts.field(0), "")).dictionary_encode()
        # Where no part matched, the whole word takes the place of the tail.
        tail = pc.if_else(plain, pc.fill_null(parts.field(1), ""), distinct).dictionary_encode()
        cores = self._look_up(core.dictionary.to_pylist(), self.core, self._core)
        tails = self._look_up(tail.dictionary.to_pylist(), self.other, self._other)
        units = cores + tails
        pool = np.frombuffer(b"".join(units), "<u4")
        sizes = np.fromiter(map(len, units), np.int64, len(units)) // 4
        two = np.stack([core.indices.to_numpy(), tail.indices.to_numpy() + len(cores)], axis=1).ravel()
        pool, sizes = _gather(pool, sizes, two), sizes[two].reshape(-1, 2).sum(axis=1)
        at = words.indices.to_numpy()
        flat, stop = _gather(pool, sizes, at), np.cumsum(sizes[at])
        bounds = np.concatenate([[0], stop])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return flat, np.diff(bounds)


def _gather(pool, sizes, at):
    """The runs numbered ``at`` of a pool that holds runs of ``sizes`` side by side."""
    import numpy as np

    n = sizes[at]
    shift = (np.cumsum(sizes) - sizes)[at] - np.cumsum(n) + n
    return pool[np.arange(n.sum()) + np.repeat(shift, n)]


def word_ids(vocabulary: str) -> WordIds:
    """The worker's own tokenizer for a vocabulary file: a path, or a name among the public tokenizers."""
    cache = worker_cache("tokenizers")
    if vocabulary not in cache:
        path = vocabulary
        if "/" not in vocabulary:
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        cache[vocabulary] = WordIds(path)
    return cache[vocabulary]


class Packer:
    """Windows of one task. A rest is ``(document, start, length)``.

    ``ids[document]`` has the document's name, its tokens, where its kept ids begin, and these as bytes.
    """

    def __init__(self, max_tokens: int, tiers: tuple[int, ...], first_id: int, keep_ids: bool):
        self.max_tokens, self.tiers, self.keep_ids = max_tokens, tiers, keep_ids
        self.next_id = first_id
        self.ids: dict[int, tuple[object, int, int, bytes]] = {}
        self.rests: dict[int, deque] = defaultdict(deque)
        self.lengths: list[int] = []  # sorted; those with rests
        self.held = 0
        self.ranks: dict[int, int] = defaultdict(int)
        self.rows: list[tuple] = []

    def put(self, doc: int, start: int, length: int) -> None:
        if not self.rests[length]:
            insort(self.lengths, length)
        self.rests[length].append((doc, start))
        self.held += length

    def take(self, length: int) -> tuple[int, int, int]:
        doc, start = self.rests[length].popleft()
        if not self.rests[length]:
            self.lengths.pop(bisect_left(self.lengths, length))
        self.held -= length
        return doc, start, length

    def emit(self, window: list[tuple[int, int, int]]) -> None:
        size = sum(p[2] for p in window)
        tier = size if size & (size - 1) == 0 else self.max_tokens
        offset = 0
        for doc, start, length in window:
            name, tokens, base, ids = self.ids[doc]
            part = ids[4 * (start - base) : 4 * (start - base + length)]
            row = (name, start, length, zlib.crc32(part), tokens, self.next_id, offset, tier, self.ranks[tier])
            self.rows.append((*row, part) if self.keep_ids else row)
            offset += length
        self.ranks[tier] += 1
        self.next_id += 1

    def add(self, doc: int, name: object, ids: bytes) -> None:
        """Whole windows at once; the rest waits for its tier."""
        n = len(ids) // 4
        self.ids[doc] = (name, n, 0, ids)
        start = 0
        while n - start >= self.max_tokens:
            self.emit([(doc, start, self.max_tokens)])
            start += self.max_tokens
        if n > start:
            self.ids[doc] = (name, n, start, ids[4 * start :])
            self.put(doc, start, n - start)
        else:
            del self.ids[doc]

    def close(self, last: bool) -> None:
        """Make windows of the rests, longest first: each opens one of its tier, whose gap shorter rests fill.

        The longest that fits goes in; where none fits, the shortest rest is cut to the gap. So every window
        is full but the last, which is cut into powers of two if nothing follows, else waits.
        """
        while self.lengths:
            window = [self.take(self.lengths[-1])]
            tier = self.tiers[min(bisect_left(self.tiers, window[0][2]), len(self.tiers) - 1)]
            gap = tier - window[0][2]
            while gap and self.lengths:
                at = bisect_right(self.lengths, gap)
                if at:
                    window.append(self.take(self.lengths[at - 1]))
                else:
                    doc, start, length = self.take(self.lengths[0])
                    window.append((doc, start, gap))
                    self.put(doc, start + gap, length - gap)
                gap -= window[-1][2]
            if not gap:
                self.emit(window)
            elif last:
                self.split(window)
            else:
                for piece in window:
                    self.put(*piece)
                break
        waiting = {d for q in self.rests.values() for d, _ in q}
        self.ids = {d: v for d, v in self.ids.items() if d in waiting}

    def split(self, window: list[tuple[int, int, int]]) -> None:
        """A window that stays short, as windows of falling powers of two."""
        todo = deque(window)
        left = sum(p[2] for p in window)
        while left:
            room = size = 1 << (left.bit_length() - 1)
            part = []
            while room:
                doc, start, length = todo.popleft()
                used = min(length, room)
                part.append((doc, start, used))
                if length > used:
                    todo.appendleft((doc, start + used, length - used))
                room -= used
            self.emit(part)
            left -= size


def pack(
    docs: DataFrame,
    max_tokens: int = MAX_TOKENS,
    tiers: tuple[int, ...] = TIERS,
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece of every row of ``docs`` (``doc_id, text``), without a shuffle: each task packs what it reads.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, tier_rank`` and, with ``keep_ids``, ``ids``.
    ``tier`` is the padded size; no sequence needs padding, as the last ones of a task are cut to powers of two.
    ``sequence_id`` is the task's number times 2^32 plus a count; ``tier_rank`` counts the task's windows of a tier.

    A null text is empty; an empty one is its end id alone. Repeated rows and ids are packed each; a null id stays
    null. An empty table gives no rows. A task holds the ids of a few million tokens and one document at most.
    """
    if max_tokens != tiers[-1] or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two up to max_tokens")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = StructType.fromDDL(
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
        "tier int, tier_rank long" + ", ids array<int>" * keep_ids
    )

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        end = array("I", [end_id]).tobytes()
        words = word_ids(vocabulary)
        packer = Packer(max_tokens, tiers, TaskContext.get().partitionId() << 32, keep_ids)

        def rows():
            columns = list(zip(*packer.rows, strict=True)) or [()] * len(out)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, out, strict=False) if f.name != "ids"]
            if keep_ids:
                parts = columns[len(arrays)]
                offsets = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
                flat = pa.array(np.frombuffer(b"".join(parts), "<u4").astype(np.int32))
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), flat).cast(out.field("ids").type))
            packer.rows = []
            return pa.RecordBatch.from_arrays(arrays, schema=out)

        count = 0
        for batch in batches:
            for part in by_bytes(batch, 1, SLICE_BYTES):
                ids, sizes = words.ids(part.column(1))
                stops = np.cumsum(sizes)
                for name, stop, n in zip(part.column(0).to_pylist(), stops.tolist(), sizes.tolist(), strict=True):
                    packer.add(count, name, ids[stop - n : stop].tobytes() + end)
                    count += 1
                if packer.held >= HELD_TOKENS:
                    packer.close(last=False)
                if packer.rows:
                    yield rows()
        packer.close(last=True)
        if packer.rows:
            yield rows()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def step_groups(packed: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """``packed`` with ``step_group`` and ``step_position`` instead of ``tier_rank``.

    The sequences of a tier are dealt to as many steps of about ``step_tokens`` as they fill, whose sizes differ
    by one at most; positions (0 to 1) spread every tier's steps evenly over the training. Only counts per task and
    tier are gathered. ``packed`` is read twice, so it should be a stored table.
    """
    task = F.shiftright("sequence_id", 32)
    sizes = packed.filter("offset = 0").groupBy(task.alias("task"), F.col("tier").alias("of_tier")).agg(F.count(F.lit(1)).alias("n"))
    tier = Window.partitionBy("of_tier")
    sizes = sizes.select(
        "task", "of_tier",
        (F.sum("n").over(tier.orderBy("task")) - F.col("n")).alias("before"),
        F.sum("n").over(tier).alias("all"),
    )
    steps = F.ceil(F.col("all") * F.col("tier") / step_tokens)
    if sizes.limit(MAX_BROADCAST_COUNTS + 1).count() <= MAX_BROADCAST_COUNTS:
        sizes = F.broadcast(sizes)
    joined = packed.join(sizes, (task == sizes["task"]) & (packed["tier"] == sizes["of_tier"]))
    group = F.floor((F.col("before") + F.col("tier_rank")) * steps / F.col("all"))
    columns = [packed[c] for c in packed.columns if c != "tier_rank"]
    return joined.select(*columns, group.cast("long").alias("step_group"), ((group + 0.5) / steps).alias("step_position"))
