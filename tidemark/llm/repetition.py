"""Repetition inside a document: rule statistics, an isolation forest over them, and an exact share.

The statistics of every document are computed once, over its whole text. The forest is grown over all of them on one
half of a bounded sample of labelled rows (a document is labelled repetitive if its exact repeated share exceeds the
limit); there the score is calibrated that tells the labels best, and the other half says how well it does. For
finding, the cutoff is lowered: a document over the limit is over it in the shares of shorter grams and of words seen
before as well, so the least score that the trees can give to any such document is known, and none below it can be
over the limit. The exact share, an own column, decides among these suspects.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from . import streams

SHORTER = (4, 3)
# shares that are never below ``repeated``: each word of a repeated gram also lies in a repeated shorter gram and stood before
AT_LEAST = ("repeated", *(f"repeated_{g}" for g in SHORTER), "same_words")
FEATURES = (*AT_LEAST, "same_lines", "top_gram", "long_words")


def statistics(texts: list[str], gram: int = 6, most_chars: int = 1_000_000) -> pd.DataFrame:
    """Per text: words, and the shares ``repeated`` (words in ``gram`` successive words that stood earlier), the same for
    shorter grams (``repeated_4``, ``repeated_3``), ``same_lines``
    (lines equal to an earlier line, blank ones aside), ``same_words`` (words seen before), ``top_gram`` (words held by
    the most frequent gram) and ``long_words`` (words of more than 20 characters). A text without words has zeros."""
    parts = []
    for a, b in streams.chunks(texts, most_chars):
        cp, bounds = streams.points(texts[a:b])
        n = b - a
        s, e, doc = streams.words(cp, bounds, drop_removed_lines=True)
        h = streams.word_hashes(cp, s, e)
        count = np.bincount(doc, minlength=n).astype(np.float64)
        own = h ^ (doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        repeated, top = _repeated(own, doc, n, gram)
        shorter = {f"repeated_{k}": _repeated(own, doc, n, k)[0] for k in SHORTER}
        distinct = np.unique(own, return_index=True)[1] if len(own) else np.zeros(0, dtype=np.int64)
        kinds = np.bincount(doc[distinct], minlength=n)
        wide = np.bincount(doc[(e - s) > 20], minlength=n)
        # a line's hash is the ordered mix of its words
        lines = np.zeros(n)
        if len(s):
            line_no = np.searchsorted(np.flatnonzero((cp == 10) | (cp == 13)), s)
            head = np.flatnonzero(np.append(True, (line_no[1:] != line_no[:-1]) | (doc[1:] != doc[:-1])))
            place = (np.arange(len(s)) - np.repeat(head, np.diff(np.append(head, len(s))))).astype(np.uint64)
            with np.errstate(over="ignore"):
                line = np.add.reduceat(streams.mix(own + (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), head)
            one = np.unique(line, return_index=True)[1]
            all_lines = np.bincount(doc[head], minlength=n)
            lines = (all_lines - np.bincount(doc[head[one]], minlength=n)) / np.maximum(all_lines, 1)
        whole = np.maximum(count, 1)
        parts.append(
            pd.DataFrame(
                {
                    "words": count.astype(np.int64),
                    "repeated_words": repeated.astype(np.int64),
                    "repeated": repeated / whole,
                    **{k: v / whole for k, v in shorter.items()},
                    "same_lines": lines,
                    "same_words": 1.0 - np.where(count > 0, kinds / whole, 1.0),
                    "top_gram": np.minimum(top / whole, 1.0),
                    "long_words": wide / whole,
                }
            )
        )
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in ("words", "repeated_words", *FEATURES)})


def _repeated(own: np.ndarray, doc: np.ndarray, n: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: words that lie in a gram that stood earlier, and words held by the later places of its most frequent gram."""
    g = streams.grams(own, gram)
    at = np.flatnonzero(doc[: len(g)] == doc[gram - 1 :]) if len(g) else np.zeros(0, dtype=np.int64)
    order = at[np.argsort(g[at], kind="stable")]
    again = np.zeros(len(order), dtype=bool)
    again[1:] = g[order][1:] == g[order][:-1]
    cover = np.zeros(len(doc) + 1, dtype=np.int64)
    np.add.at(cover, order[again], 1)
    np.add.at(cover, order[again] + gram, -1)
    repeated = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    top = np.zeros(n)
    if len(order):
        first = np.flatnonzero(~again)
        np.maximum.at(top, doc[order[first]], (np.diff(np.append(first, len(order))) - 1) * gram)
    return repeated, top


class Forest:
    """Isolation forest (Liu, Ting and Zhou 2008) as flat arrays, one column per tree."""

    def __init__(self, x: np.ndarray, trees: int, sample: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.depth = max(1, int(np.ceil(np.log2(max(2, min(sample, len(x)))))))
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.full((trees, nodes), -1, dtype=np.int64)
        self.cut = np.zeros((trees, nodes))
        self.length = np.zeros((trees, nodes))
        self.norm = self.average(min(sample, len(x)))
        for t in range(trees):
            rows = x[rng.choice(len(x), size=min(sample, len(x)), replace=False)]
            stack = [(0, rows, 0)]
            while stack:
                node, held, depth = stack.pop()
                spread = np.ptp(held, axis=0) if len(held) else np.zeros(x.shape[1])
                wide = np.flatnonzero(spread > 0)
                if depth == self.depth or len(held) <= 1 or not len(wide):
                    self.length[t, node] = depth + self.average(len(held))
                    continue
                f = rng.choice(wide)
                c = rng.uniform(held[:, f].min(), held[:, f].max())
                self.feature[t, node], self.cut[t, node] = f, c
                left = held[:, f] < c
                stack += [(2 * node + 1, held[left], depth + 1), (2 * node + 2, held[~left], depth + 1)]

    @staticmethod
    def average(n: int) -> float:
        """Mean path length of an unsuccessful search among ``n``."""
        return 0.0 if n <= 1 else 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0

    def least_score(self, low: np.ndarray) -> float:
        """No row with every feature at or above ``low`` scores below this: from the longest path open to such rows."""
        total = 0.0
        for feature, cut, length in zip(self.feature, self.cut, self.length, strict=True):
            stack, longest = [0], 0.0
            while stack:
                node = stack.pop()
                f = feature[node]
                if f < 0:
                    longest = max(longest, length[node])
                else:
                    stack += [2 * node + 2] + ([2 * node + 1] if low[f] < cut[node] else [])
            total += longest
        return float(2.0 ** (-total / len(self.feature) / max(self.norm, 1e-9))) - 1e-9

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the higher, the shorter the paths."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, length in zip(self.feature, self.cut, self.length, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                go = f >= 0
                right = x[rows, np.maximum(f, 0)] >= cut[node]
                node = np.where(go, 2 * node + 1 + right, node)
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / max(self.norm, 1e-9))


def measure(docs: DataFrame, doc_id: str, text: str, gram: int) -> DataFrame:
    """doc_id, words, repeated_words and the statistics of every row; written once."""
    wide = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc_id IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = statistics(list(pdf["text"]), gram)
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out[["doc_id", "words", "repeated_words", *FEATURES]]

    return materialize(wide.mapInPandas(run, "doc_id long, words long, repeated_words long, " + ", ".join(f"{c} double" for c in FEATURES)), "repetition")


def best_cut(score: np.ndarray, label: np.ndarray) -> float:
    """The score at or above which calling rows positive has the greatest F1; infinite without positives."""
    if not label.any():
        return float("inf")
    values = np.unique(-score)
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(label[order])
    last = np.searchsorted(-score[order], values, side="right") - 1  # equal scores stand or fall together
    f1 = 2.0 * hits[last] / (last + 1 + label.sum())
    return float(-values[f1.argmax()])


class Judge:
    """A forest with its calibrated score, its guaranteed cutoff and its figures on held-out labels."""

    def __init__(self, stats: DataFrame, limit: float, labelled_rows: int, trees: int, sample: int, seed: int) -> None:
        rows = stats.count()
        share = labelled_rows / max(rows, labelled_rows)
        h = F.xxhash64("doc_id")
        # each task sends only its own share of the sample
        own = stats.where(h < F.lit(min(int(share * 2.0**64) - (1 << 63), (1 << 63) - 1))).withColumn("held_out", F.xxhash64(h) > 0)
        labelled = own.toPandas().sort_values("doc_id", kind="stable")
        x = labelled[list(FEATURES)].to_numpy(dtype=float)
        label = (labelled["repeated_words"] > limit * labelled["words"]).to_numpy(dtype=bool)
        out = labelled["held_out"].to_numpy(dtype=bool)
        self.forest, self.cut, self.least = None, -1.0, -1.0
        self.figures = {"labelled": int(len(x)), "held_out": int(out.sum()), "positives": int((label & out).sum()), "precision": None, "recall": None}
        if (~out).sum() < 2:
            return
        self.forest = Forest(x[~out], trees, sample, seed)
        self.cut = best_cut(self.forest.score(x[~out]), label[~out])
        self.least = min(self.forest.least_score(np.array([limit if c in AT_LEAST else -1.0 for c in FEATURES])), self.cut)
        called = self.forest.score(x[out]) >= self.cut
        right = int((called & label[out]).sum())
        self.figures["precision"] = right / int(called.sum()) if called.any() else None
        self.figures["recall"] = right / int(label[out].sum()) if label[out].any() else None

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.forest.score(x) if self.forest else np.ones(len(x))


def repeated_content(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    limit: float = 0.3,
    gram: int = 6,
    labelled_rows: int = 20_000,
    trees: int = 200,
    sample: int = 128,
    seed: int = 7,
) -> DataFrame:
    """doc_id, words, repeated_words, repeated (share), the other statistics, anomaly, predicted, suspect, over_limit, repetitive.

    ``anomaly`` is the forest's score, ``predicted`` what it says by itself at its calibrated score, ``suspect`` whether
    the score leaves it open that the document is over the limit; ``over_limit`` is the exact rule, repeated share above
    ``limit``, and ``repetitive`` both of the last two. The forest is grown and calibrated on half of about
    ``labelled_rows`` documents (those whose hash of doc_id lies below the share of the corpus that they make up);
    ``forest_figures`` gives its precision and recall on the other half. With fewer than two rows to grow on every
    document is a suspect. ``gram`` must exceed the shorter grams.

    A null text counts as empty and has share 0; very long texts are handled whole; rows with null doc_id are left
    out; of several rows with one doc_id the one with the highest share stands; an empty table gives no rows.
    """
    stats = measure(docs, doc_id, text, gram)
    judge = Judge(stats, limit, labelled_rows, trees, sample, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["anomaly"] = judge.score(pdf[list(FEATURES)].to_numpy(dtype=float))
            pdf["predicted"] = pdf["anomaly"] >= judge.cut
            pdf["suspect"] = pdf["anomaly"] >= judge.least
            pdf["over_limit"] = pdf["repeated_words"] > limit * pdf["words"]
            pdf["repetitive"] = pdf["suspect"] & pdf["over_limit"]
            yield pdf

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema)
    scored = stats.mapInPandas(run, f"{kinds}, anomaly double, predicted boolean, suspect boolean, over_limit boolean, repetitive boolean")
    rest = [c for c in scored.columns if c != "doc_id"]
    best = F.max(F.struct("repeated", *[c for c in rest if c != "repeated"])).alias("best")
    return scored.groupBy("doc_id").agg(best).select("doc_id", *(F.col(f"best.{c}").alias(c) for c in rest))


def forest_figures(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", limit: float = 0.3, gram: int = 6, labelled_rows: int = 20_000, trees: int = 200, sample: int = 128, seed: int = 7) -> DataFrame:
    """One row: labelled, held_out and positives (numbers of rows), and the forest's own precision and recall on the held-out
    rows (null where there is nothing to divide by)."""
    figures = Judge(measure(docs, doc_id, text, gram), limit, labelled_rows, trees, sample, seed).figures
    return docs.sparkSession.createDataFrame([tuple(figures.values())], "labelled long, held_out long, positives long, precision double, recall double")
