"""Mixing sources to target weights without sorting: hash thresholds found by histograms of tokens.

Every document has a fixed hash. Per source the tokens are summed by leading hash bits; the bucket in which the budget
ends is refined by the next bits, and so on. Documents below the threshold are drawn once more than the source's whole
repeats. A larger budget draws a superset of a smaller one's documents.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialize

# Where vocabularies are, unless the session's ``tidemark.tokenizers`` or the caller says otherwise.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the splitting pattern that belongs to the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str):
    """The byte-level BPE whose ranks stand in ``path``."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary(spark: SparkSession) -> str:
    return f"{spark.conf.get('tidemark.tokenizers', TOKENIZERS)}/byte_bpe_50k.tiktoken"


def count_tokens(docs: DataFrame, doc_id: str, text: str, source: str, vocabulary: str) -> DataFrame:
    """(doc_id, source, h, tokens): tokens of the whole text, h a fixed 63-bit hash of the id. Of several rows with one id
    the one with the most tokens counts, of equals the one of the greatest source."""
    wide = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc_id IS NOT NULL AND source IS NOT NULL")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary)
        for pdf in batches:
            tokens = [len(enc.encode_ordinary(t)) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": tokens})

    counted = wide.mapInPandas(measure, "doc_id long, source string, tokens long")
    one = counted.groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("top"))
    return one.select("doc_id", "top.source", F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("h"), "top.tokens")


def _budgets(targets: list[tuple[str, float, int]], held: dict[str, int], total: float | None) -> dict[str, float]:
    """Tokens to draw from each source. Without ``total`` the mix is as large as it can be with every source that the
    corpus holds meeting its share."""
    live = [(s, w, r) for s, w, r in targets if w > 0 and held.get(s, 0) > 0 and r > 0]
    weight = sum(w for _, w, _ in live)
    if not live:
        return {}
    if total is None:
        total = min(held[s] * r * weight / w for s, w, r in live)
    return {s: min(total * w / weight, float(held[s] * r)) for s, w, r in live}


def mix(
    docs: DataFrame,
    targets: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    total_tokens: float | None = None,
    vocabulary: str | None = None,
    bits: int = 12,
    most_sources: int = 100_000,
) -> tuple[DataFrame, DataFrame]:
    """(drawn, shares). ``drawn``: doc_id, source, tokens, copies (at most the source's max_repeats). ``shares``: source,
    target_share, max_repeats, held_tokens, drawn_tokens, actual_share, one row per target.

    ``targets``: source, target_share, max_repeats; at most ``most_sources`` rows, which with one row of sums for each are the
    only ones brought to the driver and back to the executors. ``vocabulary``: file of the tokenizer's ranks. Without ``total_tokens`` the mix is the largest in which every source that the corpus holds meets its share
    (shares of absent sources go to the others in proportion); with it, a source that is too small is drawn
    max_repeats times and falls short. Each source misses its budget by at most half a document's tokens at the
    threshold. Documents without id or source, and of sources without target, are not drawn; null texts have no
    tokens; rows of equal id count once (see ``count_tokens``); an empty corpus draws nothing and has null shares.
    """
    chosen = targets.where("source IS NOT NULL AND target_share IS NOT NULL AND max_repeats IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("w"), F.max("max_repeats").alias("r")).limit(most_sources + 1).collect()
    if len(chosen) > most_sources:
        raise ValueError(f"more than {most_sources} target sources")
    goals = sorted((r["source"], float(r["w"]), int(r["r"])) for r in chosen)
    spark = docs.sparkSession

    def per_source(rows: list[tuple], fields: str) -> DataFrame:
        """A row for each of at most ``most_sources`` sources, for a broadcast join."""
        return F.broadcast(spark.createDataFrame(rows, f"source string, {fields}"))

    known = F.broadcast(spark.createDataFrame([(s,) for s, _, _ in goals], "__source string"))
    wanted = docs.join(known, F.col(source).cast("string") == F.col("__source"), "left_semi")
    sizes = materialize(count_tokens(wanted, doc_id, text, source, vocabulary or default_vocabulary(spark)), "tokens")
    held = {r["source"]: int(r["t"]) for r in sizes.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    budgets = _budgets(goals, held, total_tokens)
    whole = {s: int(b // held[s]) for s, b in budgets.items()}
    part = {s: b - whole[s] * held[s] for s, b in budgets.items()}
    threshold = {s: 0 for s in budgets}
    # refine: leading bits fixed so far, and tokens still to find, for each source whose budget ends inside a bucket
    open_ = {s: (0, left) for s, left in part.items() if left > 0}
    used = 0
    while open_ and used < 63:
        step = min(bits, 63 - used)
        ends = per_source([(s, p, float(left)) for s, (p, left) in open_.items()], "prefix long, rest double")
        inside = sizes.join(ends, "source")
        if used:
            inside = inside.where(F.shiftright("h", 63 - used) == F.col("prefix"))
        histogram = inside.groupBy("source", "rest", F.shiftright("h", 63 - used - step).alias("bucket")).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
        flow = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        edge = (
            histogram.withColumn("upto", F.sum("t").over(flow))
            .where(F.col("upto") > F.col("rest"))
            .groupBy("source")
            .agg(F.min(F.struct("bucket", "upto", "t", "n")).alias("e"))
            .select("source", "e.*")
            .collect()
        )
        used += step
        later = {}
        for r in edge:
            left = open_[r["source"]][1] - (r["upto"] - r["t"])
            if r["n"] == 1 or used >= 63:
                take = r["upto"] - r["t"] + left >= r["upto"] - r["t"] / 2
                threshold[r["source"]] = (r["bucket"] + int(take)) << (63 - used)
            else:
                threshold[r["source"]] = r["bucket"] << (63 - used)
                later[r["source"]] = (r["bucket"], left)
        # a source without an edge has its budget at its very end
        for s in open_.keys() - {r["source"] for r in edge}:
            threshold[s] = (1 << 63) - 1
        open_ = later
    if budgets:
        plan = per_source([(s, whole[s], min(threshold[s], (1 << 63) - 1)) for s in budgets], "whole int, below long")
        drawn = sizes.join(plan, "source").withColumn("copies", F.col("whole") + (F.col("h") < F.col("below")).cast("int"))
    else:
        drawn = sizes.withColumn("copies", F.lit(0))
    drawn = drawn.where("copies > 0").select("doc_id", "source", "tokens", "copies")
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"))
    frame = spark.createDataFrame([(s, w, r, held.get(s, 0)) for s, w, r in goals], "source string, target_share double, max_repeats int, held_tokens long")
    summed = frame.join(got, "source", "left").withColumn("drawn_tokens", F.coalesce("drawn_tokens", F.lit(0).cast("long")))
    shares = summed.withColumn("actual_share", F.try_divide(F.col("drawn_tokens").cast("double"), F.sum("drawn_tokens").over(Window.partitionBy(F.lit(1))).cast("double")))
    return drawn, shares
