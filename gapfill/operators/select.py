"""Exact k-smallest selection without a global sort.

A histogram of the order key narrows the k-th row down to a range that fits on the driver; the
selection itself is then a plain filter ``(order, key) <= cut`` without any shuffle. All cuts
(rates, strata) share the passes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfill.functions.text import _col

SMALL = 10_000  # rows of one range that may be looked at on the driver
BUCKETS = 4_096
MAX_STRATA = 1_000


@dataclass(frozen=True)
class Cut:
    """The last selected row; ``order is None`` selects nothing."""

    order: float | None
    key: Any = None


@dataclass
class _Search:
    stratum: Any
    k: int
    rank: int
    lo: float
    hi: float
    n: int


def smallest_k_cuts(
    df: DataFrame,
    order: Column,
    key: str,
    sizes: Callable[[Mapping[Any, int]], Mapping[Any, Sequence[int]]],
    stratum: Column | None = None,
) -> tuple[dict[tuple[Any, int], Cut], dict[Any, int]]:
    """Cuts of the ``k`` smallest rows by ``(order, key)``, per stratum and k.

    ``sizes`` maps the row count of every stratum to the wanted k values. Rows with a null key are never selected.
    Strata are class labels here; :func:`gapfill.operators.split.stratified_split` takes any number of them.
    """
    base = df.select(
        (stratum if stratum is not None else F.lit(0)).alias("_s"),
        order.cast("double").alias("_o"),
        _col(key).alias("_k"),
    ).filter(F.col("_k").isNotNull())
    stats = base.groupBy("_s").agg(F.count("*").alias("n"), F.min("_o").alias("lo"), F.max("_o").alias("hi"))
    rows = stats.limit(MAX_STRATA + 1).collect()
    if len(rows) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata; strata must be class labels")
    counts = {r["_s"]: r["n"] for r in rows}
    bounds = {r["_s"]: (r["lo"], r["hi"]) for r in rows}

    cuts: dict[tuple[Any, int], Cut] = {}
    open_: list[_Search] = []
    for s, ks in sizes(counts).items():
        for k in dict.fromkeys(ks):
            if k <= 0 or s not in counts:
                cuts[(s, k)] = Cut(None)
            else:
                k_in = min(k, counts[s])
                open_.append(_Search(s, k, k_in, *bounds[s], counts[s]))

    while open_:
        ranges: dict[tuple[Any, float, float], list[_Search]] = {}
        for x in open_:
            ranges.setdefault((x.stratum, x.lo, x.hi), []).append(x)
        big = {}
        small = []
        for bounds_, group in ranges.items():
            if group[0].n <= SMALL:
                small.append((bounds_, group))
            elif bounds_[1] == bounds_[2]:
                for x in group:
                    cuts[(x.stratum, x.k)] = _tie_cut(base, x)
            else:
                big[len(big)] = (bounds_, group)
        if small:
            _finish(base, small, cuts)
        open_ = _narrow(base, big) if big else []
    return cuts, counts


def _inside(bounds: tuple[Any, float, float]) -> Column:
    s, lo, hi = bounds
    return F.col("_s").eqNullSafe(F.lit(s)) & (F.col("_o") >= F.lit(lo)) & (F.col("_o") <= F.lit(hi))


def _finish(base: DataFrame, small, cuts) -> None:
    """Read ranges of at most SMALL rows each and pick the rows of the wanted ranks."""
    cond = F.lit(False)
    for bounds, _ in small:
        cond = cond | _inside(bounds)
    found = base.filter(cond).collect()
    for (s, lo, hi), group in small:
        rows = sorted((r["_o"], r["_k"]) for r in found if r["_s"] == s and lo <= r["_o"] <= hi)
        for x in group:
            cut = rows[x.rank - 1]
            if x.rank < len(rows) and rows[x.rank] == cut:
                raise ValueError(f"row key is not unique: {cut[1]!r}")
            cuts[(x.stratum, x.k)] = Cut(*cut)


def _tie_cut(base: DataFrame, x: _Search) -> Cut:
    """More than SMALL rows share one order value: the key decides."""
    first = base.filter(_inside((x.stratum, x.lo, x.hi))).orderBy("_k").limit(x.rank)
    return Cut(x.lo, first.agg(F.max("_k")).first()[0])


def _narrow(base: DataFrame, big) -> list[_Search]:
    """One histogram pass over all open ranges."""
    rid = F.lit(None).cast("int")
    bucket = F.lit(None).cast("long")
    cond = F.lit(False)
    for i, ((s, lo, hi), _) in big.items():
        inside = _inside((s, lo, hi))
        slot = F.floor((F.col("_o") - F.lit(lo)) / F.lit(hi - lo) * BUCKETS)
        rid = F.when(inside, F.lit(i)).otherwise(rid)
        bucket = F.when(inside, F.least(slot, F.lit(BUCKETS - 1))).otherwise(bucket)
        cond = cond | inside
    hist = (
        base.filter(cond)
        .select(rid.alias("_r"), bucket.alias("_b"), "_o")
        .groupBy("_r", "_b")
        .agg(F.count("*").alias("n"), F.min("_o").alias("lo"), F.max("_o").alias("hi"))
        .collect()
    )
    by_range: dict[int, list] = {}
    for r in hist:
        by_range.setdefault(r["_r"], []).append(r)
    narrowed = []
    for i, (_, group) in big.items():
        buckets = sorted(by_range[i], key=lambda r: r["_b"])
        for x in group:
            rank = x.rank
            for r in buckets:
                if rank <= r["n"]:
                    narrowed.append(_Search(x.stratum, x.k, rank, r["lo"], r["hi"], r["n"]))
                    break
                rank -= r["n"]
    return narrowed


def require_unique(df: DataFrame, key: str) -> None:
    """Raise ValueError where a row key repeats: masks and fills are joined by it."""
    twice = df.groupBy(_col(key).alias("_k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_k").limit(1).collect()
    if twice:
        raise ValueError(f"row key is not unique: {twice[0]['_k']!r}")


def within_cut(order: Column, key: Column | str, cut: Cut) -> Column:
    """The selection as a filter."""
    if cut.order is None:
        return F.lit(False)
    o = order.cast("double")
    return (o < F.lit(cut.order)) | ((o == F.lit(cut.order)) & (_col(key) <= F.lit(cut.key)))
