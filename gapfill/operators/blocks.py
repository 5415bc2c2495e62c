"""Adding up dense matrices that tasks produce, as a tree on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BLOCK_SCHEMA = "key binary, block binary"
FAN_IN = 32
MAX_DRIVER_BYTES = 1 << 30


def emit_blocks(totals: dict[bytes, np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"key": list(totals), "block": [m.tobytes() for m in totals.values()]})


def sum_blocks(blocks: DataFrame, shape: tuple[int, int], parts: int) -> dict[bytes, np.ndarray]:
    """Sum the matrices of equal key, which come from ``parts`` tasks at most.

    Tasks hold one matrix per key, never all of a group.
    """

    def add(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[bytes, np.ndarray] = {}
        for pdf in rows:
            for key, raw in zip(pdf["key"], pdf["block"]):
                part = np.frombuffer(raw).reshape(shape)
                key = bytes(key)
                if key in totals:
                    totals[key] += part
                else:
                    totals[key] = part.copy()
        yield emit_blocks(totals)

    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        blocks = blocks.repartition(parts).mapInPandas(add, BLOCK_SCHEMA)
    out: dict[bytes, np.ndarray] = {}
    for row in blocks.collect():
        part = np.frombuffer(bytes(row["block"])).reshape(shape)
        key = bytes(row["key"])
        out[key] = out[key] + part if key in out else part.copy()
        if len(out) * part.nbytes > MAX_DRIVER_BYTES:
            raise ValueError("too many distinct missing patterns for this number of columns")
    return out
