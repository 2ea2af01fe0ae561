"""Implausible readings: robust decomposition per source, generalised ESD limits, range and constant-run checks.

Plan for any number of tables at once (nothing here holds a whole source in one task):

1. Copies of a reading are folded by key. Within (source, order shard) windows each reading is compared with its
   neighbours, which numbers the runs of equal values; the readings are then written once to the shared folder.
2. Cells (source, time block, season phase) are reduced to robust quantiles; one small row per source then yields
   trend and season by median polish. Blocks are fixed slices of the whole history, so a source has at most
   ``blocks x phases`` cells however many rows it holds.
3. Residuals are counted in magnitude bins per source (at most a few hundred bins), and the generalised ESD test
   removes bins from the outside in. The readings that remain give the source's usual level and spread.
4. Runs of equal values that touch a shard's edge are joined through a table of edge runs, so a hot source is split
   over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import esd_limit
from ..storage import materialize

KEY = ["tab", "source"]
PARAMS = "tab string, source string, base double, trend array<double>, season array<double>, scale double"
LIMITS = PARAMS + ", lo double, hi double, level double, spread double"
_FLAGS = ("impossible", "outlying", "far", "in_run")


def polish(n: np.ndarray, block: np.ndarray, phase: np.ndarray, med: np.ndarray, iqr: np.ndarray, blocks: int, phases: int, least: int) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Weighted median polish of one source's cells: base level, trend by block, season by phase, residual scale.

    Neighbouring blocks are pooled until they hold ``least`` readings, so a trend never follows single readings. A phase
    with fewer than ``least`` readings has no season of its own, and where most cells hold single readings the scale is
    the middle size of the residuals: a faulty reading neither explains itself nor hides smaller ones. Block ``blocks``
    (no order) has no trend and phase ``phases`` (unknown) no season.
    """

    def middle(v: np.ndarray, w: np.ndarray) -> float:
        order = np.argsort(v, kind="stable")
        c = np.cumsum(w[order])
        return float(v[order][np.searchsorted(c, c[-1] / 2.0)])

    per_block = np.bincount(block, weights=n, minlength=blocks + 1)[:blocks]
    pool, g, held = np.zeros(blocks + 1, dtype=int), 0, 0.0
    for b in range(blocks):
        pool[b] = g
        held += per_block[b]
        if held >= least and per_block[b + 1 :].sum() >= least:
            g, held = g + 1, 0.0
    pool[blocks] = g + 1
    group = pool[block]
    base = middle(med, n)
    rest, trend, season = med - base, np.zeros(g + 2), np.zeros(phases + 1)
    per_phase = np.bincount(phase, weights=n, minlength=phases + 1)[:phases]
    for _ in range(4):
        for effect, key, ks in ((trend, group, np.unique(group[block < blocks])), (season, phase, np.flatnonzero(per_phase >= least))):
            if len(effect) == 2:
                continue
            for k in ks:
                at = key == k
                shift = middle(rest[at], n[at])
                effect[k] += shift
                rest[at] -= shift
    scale = middle(iqr, n) / 1.349
    if not scale > 0:
        scale = middle(np.abs(rest), n) / 0.6745
    if not scale > 0:
        scale = float(np.average(np.abs(rest), weights=n))
    if not scale > 0:
        scale = max(abs(base), 1.0) * 1e-9
    return base, trend[pool], season, scale


def esd(count: np.ndarray, s1: np.ndarray, s2: np.ndarray, far: np.ndarray, alpha: float, most: float = 0.5) -> np.ndarray:
    """Generalised ESD over magnitude bins of one source's residuals; returns which bins are outlying.

    ``far`` is each bin's mean residual. Bins are removed from the outside in. The deviate of the last reading of a
    bin is studentised by the readings inside it plus that reading, as the one-by-one procedure has it at that
    step; the outlying bins are all up to the last that exceeds its limit. At most the share ``most`` of the readings can
    be outlying: where the usual readings are the fewer, no test on the readings alone can tell which they are.
    """
    out = np.zeros(len(count), dtype=bool)
    total = count.sum()
    if total < 3 or len(count) < 2:
        return out
    inner = np.abs(far).argmin()
    order = np.argsort(-np.abs(far), kind="stable")
    n, a, b, last = float(total), float(s1.sum()), float(s2.sum()), 0
    for k, i in enumerate(order, 1):
        n, a, b = n - count[i], a - s1[i], b - s2[i]
        if i == inner or n < total * (1.0 - most) or n < 2:
            break
        m = n + 1.0
        mean = (a + far[i]) / m
        var = max((b + far[i] ** 2) / m - mean * mean, 0.0) * m / (m - 1.0)
        if var > 0 and abs(far[i] - mean) / np.sqrt(var) > esd_limit(int(m), alpha):
            last = k
    out[order[:last]] = True
    return out


def _bin(u: Column) -> Column:
    """Signed magnitude bin of a scaled residual: the core below 2 is bin 0, then eight bins to each doubling."""
    size = F.least(F.abs(u), F.lit(1e30))
    return F.when(size < 2, F.lit(0)).otherwise((F.signum(u) * (1 + F.floor((F.log2(size) - 1) * 8))).cast("int"))


def decompose(readings: DataFrame, blocks: int, phases: int, least: int) -> DataFrame:
    """One row per source: base, trend by block, season by phase, residual scale."""
    cells = readings.where("possible").groupBy(*KEY, "block", "phase").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile_approx(x, array(0.25D, 0.5D, 0.75D), 2000)").alias("q"))
    packed = cells.groupBy(*KEY).agg(*(F.collect_list(c).alias(c) for c in ("n", "block", "phase")), *(F.collect_list(F.col("q")[i]).alias(f"q{i}") for i in range(3)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                n, block, phase = np.asarray(r.n, dtype=float), np.asarray(r.block, dtype=int), np.asarray(r.phase, dtype=int)
                rows.append((r.tab, r.source, *polish(n, block, phase, np.asarray(r.q1), np.asarray(r.q2) - np.asarray(r.q0), blocks, phases, least)))
            yield pd.DataFrame(rows, columns=[*KEY, "base", "trend", "season", "scale"])

    return packed.mapInPandas(run, PARAMS)


def limits(readings: DataFrame, params: DataFrame, alpha: float, most: float) -> DataFrame:
    """``params`` with each source's ESD limits (in scales of the residual) and the level and spread of its other readings."""
    scored = with_residual(readings.where("possible"), params)
    bins = scored.groupBy(*KEY, _bin(F.col("u")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("u").alias("s1"),
        F.sum(F.col("u") * F.col("u")).alias("s2"),
        F.sum("y").alias("y1"),
        F.sum(F.col("y") * F.col("y")).alias("y2"),
    )
    packed = bins.groupBy(*KEY).agg(*(F.collect_list(c).alias(c) for c in ("bin", "n", "s1", "s2", "y1", "y2"))).join(params, KEY)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                n = np.asarray(r.n, dtype=float)
                s1, s2, y1, y2 = (np.asarray(v) for v in (r.s1, r.s2, r.y1, r.y2))
                keep = ~esd(n, s1, s2, s1 / n, alpha, most)
                m = n[keep].sum()
                mean = y1[keep].sum() / m
                var = max(y2[keep].sum() / m - mean * mean, 0.0) * m / (m - 1) if m > 1 else float("nan")
                # bins are removed outside in, so what remains is one interval of bins
                kept = np.asarray(r.bin)[keep]
                lo = -(2.0 ** (1 + (-kept.min()) / 8.0)) if kept.min() < 0 else -2.0
                hi = 2.0 ** (1 + kept.max() / 8.0) if kept.max() > 0 else 2.0
                rows.append((r.tab, r.source, r.base, r.trend, r.season, r.scale, lo, hi, r.base + mean, None if np.isnan(var) else float(np.sqrt(var))))
            yield pd.DataFrame(rows, columns=[*KEY, "base", "trend", "season", "scale", "lo", "hi", "level", "spread"])

    return packed.mapInPandas(run, LIMITS)


def with_residual(readings: DataFrame, params: DataFrame) -> DataFrame:
    y = F.col("x") - F.col("base")
    u = (y - F.col("trend")[F.col("block")] - F.col("season")[F.col("phase")]) / F.col("scale")
    return readings.join(params, KEY).withColumn("y", y).withColumn("u", u)


def number_runs(readings: DataFrame, keys: list[str]) -> DataFrame:
    """``readings`` (keys, shard, ord, row_id, x) with ``run``, the number of its run of equal values within its shard, and
    ``first``/``last``, whether it stands at the shard's edge. A reading unlike both neighbours is in no run (null),
    unless it stands at an edge; so is one without order."""
    # a column, not an expression: both windows then share one exchange
    here = Window.partitionBy(*keys, "shard", "loose").orderBy("ord", "row_id")
    before, after = F.lag("x").over(here), F.lead("x").over(here)
    seen = readings.withColumn("loose", F.col("ord").isNull()).withColumn("before", before).withColumn("after", after)
    fresh = F.coalesce(F.col("x") != F.col("before"), F.lit(True)).cast("long")
    run = F.sum(fresh).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = F.expr("ord IS NOT NULL AND (before IS NULL OR after IS NULL OR x = before OR x = after)")
    return seen.withColumn("run", run).select(*readings.columns, F.when(near, F.col("run")).alias("run"), F.col("before").isNull().alias("first"), F.col("after").isNull().alias("last"))


def long_runs(numbered: DataFrame, length: int, keys: list[str]) -> DataFrame:
    """Readings of ``number_runs`` in ``length`` or more successive equal values, over any number of shards."""
    marked = numbered.where("run IS NOT NULL")
    place = [*keys, "shard", "run"]
    runs = marked.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("value"), F.max("first").alias("first"), F.max("last").alias("last"))
    order = Window.partitionBy(*keys).orderBy("shard", "run")
    chained = (
        runs.where("first OR last")
        .withColumn("px", F.lag("value").over(order))
        .withColumn("pshard", F.lag("shard").over(order))
        .withColumn("break", F.coalesce((F.col("px") != F.col("value")) | (F.col("pshard") == F.col("shard")), F.lit(True)))
        .withColumn("chain", F.sum(F.col("break").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    whole = F.sum("n").over(Window.partitionBy(*keys, "chain"))
    cases = runs.where(F.col("n") >= length).select(*place).union(chained.withColumn("whole", whole).where(F.col("whole") >= length).select(*place)).distinct()
    return marked.join(cases, place)


def constant_runs(readings: DataFrame, shard: Column, length: int) -> DataFrame:
    """row_ids of readings in ``length`` or more successive equal values of their source.

    ``readings``: source, ord, row_id, x without nulls. ``shard`` must not fall as ``ord`` rises.
    """
    return long_runs(number_runs(readings.select("source", "ord", "row_id", "x", shard.alias("shard")), ["source"]), length, ["source"]).select("row_id")


def readings_of(df: DataFrame, *, tab: str, source: str, order: Column, row_id: str, value: str, phase: Column | None = None) -> DataFrame:
    """tab, source, row_id, ord, phase, x of the readings of one table; nulls and NaN are none."""
    x = F.col(value).cast("double")
    return df.select(
        F.lit(tab).alias("tab"),
        F.col(source).cast("string").alias("source"),
        F.col(row_id).cast("long").alias("row_id"),
        order.cast("long").alias("ord"),
        (phase.cast("int") if phase is not None else F.lit(None).cast("int")).alias("phase"),
        F.when(~F.isnan(x), x).alias("x"),
    ).where("source IS NOT NULL AND row_id IS NOT NULL AND x IS NOT NULL")


def flag_readings(
    raw: DataFrame,
    rules: dict[str, tuple[float | None, int]],
    *,
    phases: int = 7,
    blocks: int = 32,
    least_in_block: int = 64,
    alpha: float = 0.05,
    most_outlying: float = 0.5,
    spreads: float = 8.0,
    run_length: int = 5,
) -> DataFrame:
    """tab, row_id, impossible, outlying, far, in_run: one row per reading of ``readings_of`` that cannot be right.

    ``rules`` names for each tab the floor (or None) and the width of its shards in units of the order column. All
    tables go through one chain of stages. See ``flag_spikes`` for what the flags mean.
    """

    def by_tab(values: dict, kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for tab, v in values.items():
            out = F.when(F.col("tab") == tab, F.lit(v).cast(kind)).otherwise(out)
        return out

    width = by_tab({t: w for t, (_, w) in rules.items()}, "long")
    # readings without order stand in no run; they are spread by hash, a source of theirs may be large
    shard = F.coalesce(F.floor(F.col("ord") / width), F.pmod(F.xxhash64("row_id"), F.lit(1024)))
    folded = raw.groupBy(*KEY, "row_id").agg(*(F.min(c).alias(c) for c in ("ord", "phase", "x"))).withColumn("shard", shard)
    readings = materialize(number_runs(folded, KEY), "readings")
    spans = {r["tab"]: (r["low"], r["high"]) for r in readings.groupBy("tab").agg(F.min("ord").alias("low"), F.max("ord").alias("high")).where("low IS NOT NULL").collect()}
    low, high = by_tab({t: s[0] for t, s in spans.items()}, "long"), by_tab({t: s[1] for t, s in spans.items()}, "long")
    block = F.least(F.floor((F.col("ord") - low) * blocks / (high - low + 1)).cast("int"), F.lit(blocks - 1))
    block = F.when(F.col("ord").isNull(), F.lit(blocks)).otherwise(block)
    floors = by_tab({t: f for t, (f, _) in rules.items()}, "double")
    parts = readings.select(*KEY, "row_id", "x", block.alias("block"), F.coalesce("phase", F.lit(phases)).alias("phase"), F.coalesce(F.col("x") > floors, F.lit(True)).alias("possible"))
    # one small row per source; written, so that the optimiser knows their size before it chooses how to join
    params = materialize(decompose(parts, blocks, phases, least_in_block), "params")
    found = materialize(limits(parts, params, alpha, most_outlying), "limits")
    # a source without any possible reading has no limits; its readings are impossible all the same
    y = F.col("x") - F.col("base")
    u = (y - F.col("trend")[F.col("block")] - F.col("season")[F.col("phase")]) / F.col("scale")
    far = F.abs(F.col("x") - F.col("level")) > spreads * F.col("spread") + 1e-12 * F.abs(F.col("level"))
    single = (
        parts.join(found, KEY, "left")
        .select("tab", "row_id", (~F.col("possible")).alias("impossible"), F.coalesce(~u.between(F.col("lo"), F.col("hi")), F.lit(False)).alias("outlying"), F.coalesce(far, F.lit(False)).alias("far"), F.lit(False).alias("in_run"))
        .where("impossible OR outlying OR far")
    )
    no = F.lit(False)
    runs = long_runs(readings.select(*KEY, "shard", "row_id", "x", "run", "first", "last"), run_length, KEY).select("tab", "row_id", no.alias("impossible"), no.alias("outlying"), no.alias("far"), F.lit(True).alias("in_run"))
    return single.union(runs).groupBy("tab", "row_id").agg(*(F.max(c).alias(c) for c in _FLAGS))


def flag_spikes(
    df: DataFrame,
    *,
    source: str,
    order: Column,
    row_id: str,
    value: str,
    floor: float | None = None,
    phase: Column | None = None,
    phases: int = 1,
    shard_width: int = 1 << 19,
    **options: float,
) -> DataFrame:
    """One row per reading of one table that cannot be right: row_id, impossible, outlying, far, in_run.

    A reading is ``impossible`` at or below ``floor``; ``outlying`` beyond its source's generalised ESD limit on the
    residual from trend and season; ``far`` more than ``spreads`` clean spreads from the clean level of the source's
    whole history (clean: without impossible and outlying readings); ``in_run`` in ``run_length`` or more successive
    equal readings. ``order`` is a whole number (or a date's day number) that rises with time; ties go by row_id.
    ``options`` are those of ``flag_readings``.

    Nulls and NaN are no readings and break no run; rows without source or row_id are left out; copies of a row_id
    count once. A reading without order is in no run and has no trend, one without phase no season; all other checks
    hold for it. An empty table gives no rows. A source with one reading can only be impossible. Other columns are
    ignored, so clashing names do no harm.
    """
    raw = readings_of(df, tab="", source=source, order=order, row_id=row_id, value=value, phase=phase)
    return flag_readings(raw, {"": (floor, shard_width)}, phases=phases, **options).drop("tab")
