"""Percentiles of very large columns by deterministic buffer collapsing, with a stated rank error.

A sketch holds sorted buffers of ``k`` values whose weights are powers of two, and fewer than ``k`` loose values. Two
buffers of one weight collapse into one of double weight by taking every other value of their merged order, starting
in turn at the first and the second. Each collapse of weight w moves any rank by at most w; the sum is kept as the
sketch's rank error (about ``log2(n / k) / 2k`` of n). Sketches of pieces combine to the sketch of the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKETCH = "n long, err double, level array<int>, size array<int>, vals array<double>, origin long"


class Buffers:
    """The sketch of one group."""

    def __init__(self, k: int) -> None:
        self.k, self.n, self.err = k, 0, 0.0
        self.levels: dict[int, np.ndarray] = {}
        self.turn: dict[int, int] = {}
        self.loose: list[np.ndarray] = []
        self.loose_n = 0

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self._loosen(values)

    def _loosen(self, values: np.ndarray) -> None:
        self.loose.append(values)
        self.loose_n += len(values)
        if self.loose_n >= self.k:
            every = np.concatenate(self.loose)
            full = len(every) // self.k * self.k
            for i in range(0, full, self.k):
                self.push(0, np.sort(every[i : i + self.k]))
            self.loose, self.loose_n = [every[full:]], len(every) - full

    def push(self, level: int, buffer: np.ndarray) -> None:
        while (other := self.levels.pop(level, None)) is not None:
            start = self.turn.get(level, 0)
            self.turn[level] = 1 - start
            buffer = np.sort(np.concatenate([other, buffer]), kind="stable")[start::2]
            self.err += float(1 << level)
            level += 1
        self.levels[level] = buffer

    def merge(self, n: int, err: float, level: np.ndarray, size: np.ndarray, vals: np.ndarray) -> None:
        self.n += int(n)
        self.err += float(err)
        at = 0
        for lv, sz in zip(level, size, strict=True):
            part = vals[at : at + sz]
            at += sz
            if lv < 0:
                self._loosen(part)
            else:
                self.push(int(lv), part)

    def row(self) -> tuple:
        loose = np.concatenate(self.loose) if self.loose else np.zeros(0)
        parts = [(-1, loose)] if len(loose) else []
        parts += sorted(self.levels.items())
        vals = np.concatenate([p for _, p in parts]) if parts else np.zeros(0)
        return self.n, self.err, [lv for lv, _ in parts], [len(p) for _, p in parts], vals


def weighted(level: np.ndarray, size: np.ndarray, vals: np.ndarray, n: int, shares: list[float]) -> list[float]:
    """The values at rank ceil(share n), at least 1, of a sketch."""
    weight = np.repeat(np.where(np.asarray(level) < 0, 1, 2.0 ** np.maximum(np.asarray(level), 0)), size)
    order = np.argsort(vals, kind="stable")
    upto = np.cumsum(weight[order])
    ranks = np.maximum(np.ceil(np.array(shares) * n - 1e-9), 1)
    return [float(v) for v in np.asarray(vals)[order][np.minimum(np.searchsorted(upto, ranks), len(order) - 1)]]


def sketch(df: DataFrame, keys: list[str], value: str, *, order: list[str] | None = None, k: int = 4096, most_groups: int = 20_000) -> DataFrame:
    """One or more sketches per group and input partition: keys and ``SKETCH``; no shuffle. Nulls and NaN are skipped.

    ``order`` names columns that put the rows of a partition in one order, so that a task run again after a lost
    executor builds the same sketch from rows that arrive differently. ``origin`` numbers the sketches by partition. A task
    that meets more than ``most_groups`` groups hands out what it has and goes on, so its memory is bounded."""
    x = F.col(value).cast("double")
    rows = df.select(*keys, *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order or [])), x.alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x"))
    if order:
        rows = rows.sortWithinPartitions(*(f"__o{i}" for i in range(len(order))), *keys, "__x")
    rows = rows.select(*keys, "__x")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", " + SKETCH

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Buffers] = {}
        origin, times = TaskContext.get().partitionId(), 0
        for pdf in batches:
            groups = pdf.groupby(keys, dropna=False, sort=False).indices
            values = pdf["__x"].to_numpy()
            for key, at in groups.items():
                key = key if isinstance(key, tuple) else (key,)
                held.setdefault(key, Buffers(k)).add(values[at])
            if len(held) > most_groups:
                yield frame(held, (origin << 20) + times)
                held, times = {}, times + 1
        if held:
            yield frame(held, (origin << 20) + times)

    def frame(held: dict[tuple, Buffers], origin: int) -> pd.DataFrame:
        return pd.DataFrame([(*(None if v != v else v for v in key), *b.row(), origin) for key, b in held.items()], columns=[*keys, "n", "err", "level", "size", "vals", "origin"])

    return rows.mapInPandas(build, schema)


def combine(sketches: DataFrame, keys: list[str], *, k: int = 4096, fan_in: int = 64, pieces: int | None = None) -> DataFrame:
    """One sketch per group out of any number: a tree whose tasks each merge about ``fan_in`` sketches of a group.

    ``pieces``: about how many sketches a group has at most (by default the session's shuffle partitions). Which sketches
    meet, and in which order, follows from their ``origin`` alone."""
    n = pieces or int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("origin", kind="stable")
        b = Buffers(k)
        for r in pdf[["n", "err", "level", "size", "vals"]].itertuples(index=False):
            b.merge(*r)
        out = pdf[keys].head(1).reset_index(drop=True)
        for c, v in zip(("n", "err", "level", "size", "vals"), b.row(), strict=True):
            out[c] = [v]
        out["origin"] = pdf["origin"].min()
        return out

    out, schema = sketches, sketches.schema
    while n > fan_in:
        n = -(-n // fan_in)
        out = out.withColumn("__part", F.pmod(F.xxhash64("origin"), F.lit(n))).groupBy(*keys, "__part").applyInPandas(merge, schema)
    return out.groupBy(*keys).applyInPandas(merge, schema)


def percentiles(sketches: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """keys, n, share, value, rank_error: one row per group and share; the value's rank is within rank_error of ceil(share n)."""
    schema = ", ".join(f"`{sketches.schema[c].name}` {sketches.schema[c].dataType.simpleString()}" for c in keys) + ", n long, share array<double>, value array<double>, rank_error double"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[keys].copy()
            out["n"] = pdf["n"]
            out["share"] = [shares] * len(pdf)
            out["value"] = [weighted(lv, sz, v, n, shares) for lv, sz, v, n in zip(pdf["level"], pdf["size"], pdf["vals"], pdf["n"], strict=True)]
            out["rank_error"] = pdf["err"]
            yield out

    wide = sketches.mapInPandas(read, schema)
    both = F.explode(F.arrays_zip("share", "value")).alias("q")
    return wide.select(*keys, "n", both, "rank_error").select(*keys, "n", F.col("q.share").alias("share"), F.col("q.value").alias("value"), "rank_error")
