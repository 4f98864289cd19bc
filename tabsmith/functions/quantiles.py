"""Exact order statistics with bounded memory and no sort of the data.

`percentile` keeps a value -> count map of the whole column in one task, and a global
sort moves every row. Here each round counts the rows per equal-width bucket of the
current bracket (one Expand and a map-side combined count inside codegen), keeps the
bucket that holds the wanted rank together with its smallest and largest value, and
repeats until the few values left can be sorted in one small list. Every decision
rests on exact counts, so the answer is exact. What reaches the driver is bounded by
columns x buckets, never by rows. Distributions so uneven that equal widths hardly
split them take a sketch of the bracket for the next round instead.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.expr import chunks

BUCKETS = 1024
SKETCH_ACCURACY = 1_000
SORT_LIMIT = 100_000
SORT_LIMIT_PER_JOB = 1_000_000


@dataclass
class _Bracket:
    """Values low..high (both present in the data) of one expression."""

    key: int
    low: float
    high: float
    below: int
    inside: int
    uneven: bool = False

    def holds(self, x: Column) -> Column:
        return (x >= F.lit(self.low)) & (x <= F.lit(self.high))


@dataclass
class _Bucket:
    """A bucket that holds wanted ranks: the rows whose ``step`` equals ``code``."""

    key: int
    step: Column
    code: int
    below: int
    inside: int
    uneven: bool


def select_ranks(
    df: DataFrame,
    exprs: list[Column],
    counts: list[int],
    ranks: list[list[int]],
    bounds: list[tuple[float, float]] | None = None,
    sort_limit: int = SORT_LIMIT,
) -> list[dict[int, float]]:
    """Values at 0-based ranks of each double-typed expression, NULLs ignored.

    ``counts[i]`` is the number of non-NULL values and ``bounds[i]`` their (min, max);
    bounds are looked up when not given.
    """
    if bounds is None:
        row = df.agg(*[F.array(F.min(e), F.max(e)).alias(f"b{i}") for i, e in enumerate(exprs)]).first()
        bounds = [tuple(b) for b in row]
    found: list[dict[int, float]] = [{} for _ in exprs]
    wanted = {i: set(r) for i, r in enumerate(ranks) if counts[i] and r}
    brackets = [_Bracket(i, *bounds[i], below=0, inside=counts[i]) for i in wanted]
    while brackets:
        rest = []
        for b in brackets:
            if b.low == b.high:
                found[b.key].update({r: b.low for r in _ranks_in(b, wanted)})
            else:
                rest.append(b)
        buckets: list[_Bucket] = []
        by_key: dict[int, list[_Bracket]] = {}
        for b in rest:
            by_key.setdefault(b.key, []).append(b)
        for part in chunks(list(by_key.values()), 48):
            buckets += _count_buckets(df, exprs, part, wanted)
        brackets = []
        for part in _by_volume(buckets, sort_limit):
            brackets += _look_inside(df, exprs, part, wanted, found, sort_limit)
    return found


def _ranks_in(b: _Bracket | _Bucket, wanted: dict[int, set[int]]) -> list[int]:
    return sorted(r for r in wanted[b.key] if b.below <= r < b.below + b.inside)


def _by_volume(buckets: list[_Bucket], sort_limit: int) -> list[list[_Bucket]]:
    parts: list[list[_Bucket]] = []
    total = 0
    for b in buckets:
        size = b.inside if b.inside <= sort_limit else 0
        if not parts or total + size > SORT_LIMIT_PER_JOB or len(parts[-1]) >= 48:
            parts.append([])
            total = 0
        parts[-1].append(b)
        total += size
    return parts


def _steps(df: DataFrame, exprs: list[Column], brackets: list[_Bracket]) -> list[tuple[_Bracket, Column, int]]:
    """Bucket number inside each bracket (not masked) and how many buckets it has."""
    out = []
    sketched = [b for b in brackets if b.uneven or not math.isfinite(b.high - b.low)]
    pivots: dict[int, list[float]] = {}
    if sketched:
        probs = [i / 64 for i in range(1, 64)]
        row = df.agg(
            *[
                F.percentile_approx(F.when(b.holds(exprs[b.key]), exprs[b.key]), probs, SKETCH_ACCURACY).alias(f"s{i}")
                for i, b in enumerate(sketched)
            ]
        ).first()
        pivots = {id(b): sorted(set(v)) for b, v in zip(sketched, row)}
    for b in brackets:
        x = exprs[b.key]
        if id(b) in pivots:
            # Two buckets per pivot: the values before it, and the pivot itself.
            position = F.lit(0)
            for v in pivots[id(b)]:
                position = position + (x >= F.lit(v)).cast("int") + (x > F.lit(v)).cast("int")
            out.append((b, position, 2 * len(pivots[id(b)]) + 1))
        else:
            share = (x - F.lit(b.low)) / F.lit(b.high - b.low) * F.lit(float(BUCKETS))
            out.append((b, F.least(F.floor(share), F.lit(BUCKETS - 1)).cast("int"), BUCKETS))
    return out


def _count_buckets(
    df: DataFrame, exprs: list[Column], part: list[list[_Bracket]], wanted: dict[int, set[int]]
) -> list[_Bucket]:
    """One count per bucket for all expressions; keep the buckets with wanted ranks."""
    offset = 0
    codes: list[Column] = []
    spans: list[tuple[_Bracket, Column, int, int]] = []
    for brackets in part:
        # Brackets of one expression are disjoint: one code column serves them all.
        code = None
        for b, step, size in _steps(df, exprs, brackets):
            inside = b.holds(exprs[b.key])
            branch = step + F.lit(offset)
            code = F.when(inside, branch) if code is None else code.when(inside, branch)
            spans.append((b, len(codes), offset, size))
            offset += size
        codes.append(code)
    wide = df.select(*[c.alias(f"c{i}") for i, c in enumerate(codes)])
    rows = (
        wide.unpivot([], wide.columns, "column_id", "code")
        .filter(F.col("code").isNotNull())
        .groupBy("code")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    counted = {r["code"]: r["n"] for r in rows}
    out = []
    for b, which, start, size in spans:
        below = b.below
        for c in range(start, start + size):
            n = counted.get(c, 0)
            bucket = _Bucket(b.key, codes[which], c, below, n, n > b.inside // 4)
            below += n
            if n and _ranks_in(bucket, wanted):
                out.append(bucket)
    return out


def _look_inside(
    df: DataFrame,
    exprs: list[Column],
    part: list[_Bucket],
    wanted: dict[int, set[int]],
    found: list[dict[int, float]],
    sort_limit: int,
) -> list[_Bracket]:
    """Sort the small buckets and bound the large ones."""
    keys = sorted({b.key for b in part})
    steps = {b.key: b.step for b in part}
    wide = df.select(*[F.struct(steps[k].alias("code"), exprs[k].alias("value")).alias(f"c{k}") for k in keys])
    long = wide.unpivot([], wide.columns, "column_id", "pair").select("pair.code", "pair.value")
    small = {b.code: b for b in part if b.inside <= sort_limit}
    large = {b.code: b for b in part if b.inside > sort_limit}
    out = []
    if small:
        lists = (
            long.filter(F.col("code").isin(list(small)))
            .groupBy("code")
            .agg(F.array_sort(F.collect_list("value")).alias("values"))
        )
        picks = F.lit(None).cast("array<double>")
        for c, b in small.items():
            at = F.array(*[F.element_at("values", r - b.below + 1) for r in _ranks_in(b, wanted)])
            picks = F.when(F.col("code") == c, at).otherwise(picks)
        for row in lists.select("code", picks.alias("picks")).collect():
            b = small[row["code"]]
            found[b.key].update(zip(_ranks_in(b, wanted), row["picks"]))
    if large:
        ends = (
            long.filter(F.col("code").isin(list(large)))
            .groupBy("code")
            .agg(F.min("value").alias("low"), F.max("value").alias("high"))
        )
        for row in ends.collect():
            b = large[row["code"]]
            out.append(_Bracket(b.key, row["low"], row["high"], b.below, b.inside, b.uneven))
    return out


def linear_quantiles(
    df: DataFrame,
    exprs: list[Column],
    counts: list[int],
    probs: list[float],
    bounds: list[tuple[float, float]] | None = None,
    sort_limit: int = SORT_LIMIT,
) -> list[list[float | None]]:
    """Linearly interpolated quantiles of several expressions."""
    ranks = []
    for n in counts:
        positions = [(n - 1) * p for p in probs] if n else []
        ranks.append(sorted({f(x) for x in positions for f in (math.floor, math.ceil)}))
    found = select_ranks(df, exprs, counts, ranks, bounds, sort_limit)
    out: list[list[float | None]] = []
    for n, values in zip(counts, found):
        if not n:
            out.append([None] * len(probs))
            continue
        row = []
        for p in probs:
            pos = (n - 1) * p
            low, high = values[math.floor(pos)], values[math.ceil(pos)]
            row.append(low if low == high else low + (high - low) * (pos - math.floor(pos)))
        out.append(row)
    return out
