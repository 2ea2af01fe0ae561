"""Queries p4, p7, p8 and p9 over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .leakage import leaked_passages
from .mixture import mix
from .percentiles import combine, percentiles, sketch
from .repetition import forest_figures, repeated_content

SHARES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
KEYS = ["tab", "source_key"]


def _values(spark: SparkSession, sf: str) -> DataFrame:
    """Every reading once: transaction values by symbol, returns by strategy."""
    trades = table(spark, sf, "transactions_csv").where("symbol IS NOT NULL").groupBy(F.col("txn_id").alias("id"), "symbol").agg(F.min("value").alias("value"))
    returns = table(spark, sf, "returns_csv").where("sid IS NOT NULL").groupBy(F.col("return_id").alias("id"), "sid").agg(F.min("c1").alias("value"))
    return trades.select(F.lit("transactions_csv").alias("tab"), F.col("symbol").alias("source_key"), "id", "value").unionByName(
        returns.select(F.lit("returns_csv").alias("tab"), F.col("sid").alias("source_key"), "id", "value")
    )


def p4_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles per symbol and strategy from the combined sketches of all pieces."""
    return percentiles(combine(sketch(_values(spark, sf), KEYS, "value", order=["id"]), KEYS), KEYS, SHARES)


def p4_within_bound(spark: SparkSession, sf: str) -> DataFrame:
    """Every percentile's exact rank held against its stated error."""
    found = p4_percentiles(spark, sf).groupBy(*KEYS, "n").agg(F.collect_list(F.struct("share", "value", "rank_error")).alias("q"))
    counts = [F.sum((F.col("value") < F.col("q")[i]["value"]).cast("long")).alias(f"lt{i}") for i in range(len(SHARES))]
    counts += [F.sum((F.col("value") <= F.col("q")[i]["value"]).cast("long")).alias(f"le{i}") for i in range(len(SHARES))]
    rank = [F.greatest(F.ceil(F.col("q")[i]["share"] * F.col("n") - 1e-9), F.lit(1)) for i in range(len(SHARES))]
    good = F.lit(True)
    for i in range(len(SHARES)):
        err = F.col("q")[i]["rank_error"]
        good = good & (F.col(f"lt{i}") < rank[i] + err) & (F.col(f"le{i}") >= rank[i] - err)
    joined = _values(spark, sf).where("value IS NOT NULL").join(found, KEYS).groupBy(*KEYS, "n").agg(F.first("q").alias("q"), *counts)
    return joined.select(*KEYS, "n", good.alias("within"))


def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_passages(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Per item the documents that hold a passage of it word for word."""
    return p7_leaks(spark, sf).where("exact").groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_leaks(spark, sf).where("exact").select("doc_id", "item_id")


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[1]


def p8_within_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Per target: documents held, and whether what was drawn is within one document of the budget that follows from the
    tokens held, and no document drawn more often than allowed."""
    drawn, shares = _mixed(spark, sf)
    docs = table(spark, sf, "documents").where("doc_id IS NOT NULL").groupBy("source").agg(F.count_distinct("doc_id").alias("documents"))
    most = drawn.groupBy("source").agg(F.max("tokens").alias("longest"), F.max("copies").alias("copies"))
    live = (F.col("held_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    everything = Window.partitionBy(F.lit(1))  # one row per target
    weight = F.sum(F.when(live, F.col("target_share"))).over(everything)
    plan = shares.withColumn("weight", weight).withColumn("total", F.min(F.when(live, F.col("held_tokens") * F.col("max_repeats") * F.col("weight") / F.col("target_share"))).over(everything))
    budget = F.when(live, F.col("total") * F.col("target_share") / F.col("weight")).otherwise(0.0)
    j = plan.join(most, "source", "left").join(docs, "source", "left")
    return j.select(
        "source",
        F.coalesce("documents", F.lit(0).cast("long")).alias("documents"),
        (F.abs(F.col("drawn_tokens") - budget) <= F.coalesce("longest", F.lit(0)) + 1e-6).alias("within_budget"),
        (F.coalesce("copies", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"),
    )


def p9_repetition(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's statistics and what the forest makes of them."""
    return repeated_content(table(spark, sf, "documents"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Share of repeated content of every document."""
    return p9_repetition(spark, sf).select("doc_id", "words", "repeated_words", F.round(F.col("repeated") + 3.7e-11, 7).alias("repeated"), "over_limit")


def p9_forest_figures(spark: SparkSession, sf: str) -> DataFrame:
    """The forest's own precision and recall on held-out labels."""
    return forest_figures(table(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Suspects of the forest whose exact share is over the limit."""
    return p9_repetition(spark, sf).where("repetitive").select("doc_id")


QUERIES = {
    "p4_percentiles": p4_percentiles,
    "p4_within_bound": p4_within_bound,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_within_budget": p8_within_budget,
    "p9_found": p9_found,
    "p9_forest_figures": p9_forest_figures,
    "p9_repetition": p9_repetition,
    "p9_shares": p9_shares,
    "p7_exact": p7_exact,
}

_SHARED_SQL = r"""WITH d AS (SELECT doc_id AS id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents) x),
        e AS (SELECT item_id AS id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_items) x),
        dg AS (SELECT id, string_agg(w, ' ') OVER p AS g, count(*) OVER p AS n FROM d WINDOW p AS (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
        eg AS (SELECT id, string_agg(w, ' ') OVER p AS g, count(*) OVER p AS n FROM e WINDOW p AS (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
        shared AS (SELECT DISTINCT dg.id AS doc_id, eg.id AS item_id FROM dg JOIN eg ON dg.g = eg.g AND dg.n = 12 AND eg.n = 12)"""
_REPEATED_SQL = r"""WITH t AS (SELECT doc_id AS id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)^-.*$', '', 'g') AS t FROM documents),
        d AS (SELECT id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM t) x),
        g AS (SELECT id, i, string_agg(w, ' ') OVER p AS g, count(*) OVER p AS n FROM d WINDOW p AS (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
        f AS (SELECT id, i, CASE WHEN n = 6 AND i > min(i) OVER (PARTITION BY id, g, n) THEN 1 ELSE 0 END AS again FROM g),
        c AS (SELECT id, max(again) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS hit FROM f)"""

SQL = {
    "p4_within_bound": """
        WITH v AS (
          SELECT 'transactions_csv' AS tab, symbol AS source_key, min(value) AS value FROM transactions_csv WHERE symbol IS NOT NULL GROUP BY txn_id, symbol
          UNION ALL
          SELECT 'returns_csv', sid, min(c1) FROM returns_csv WHERE sid IS NOT NULL GROUP BY return_id, sid)
        SELECT tab, source_key, count(value) AS n, TRUE AS within FROM v WHERE value IS NOT NULL GROUP BY tab, source_key""",
    "p7_found": f"{_SHARED_SQL} SELECT doc_id, item_id FROM shared",
    "p7_exact": f"{_SHARED_SQL} SELECT item_id, count(*) AS documents FROM shared GROUP BY item_id",
    "p8_within_budget": """
        SELECT t.source, count(DISTINCT d.doc_id) AS documents, TRUE AS within_budget, TRUE AS within_repeats
        FROM (SELECT DISTINCT source FROM mix_targets) t LEFT JOIN documents d ON d.source = t.source GROUP BY t.source""",
    "p9_found": f"{_REPEATED_SQL} SELECT id AS doc_id FROM c GROUP BY id HAVING sum(hit) > 0.3 * count(*)",
    "p9_shares": f"""{_REPEATED_SQL}, n AS (SELECT id, count(*) AS words, CAST(sum(hit) AS BIGINT) AS hits FROM c GROUP BY id)
        SELECT a.doc_id, coalesce(words, 0) AS words, coalesce(hits, 0) AS repeated_words, round(coalesce(hits / words, 0) + 3.7e-11, 7) AS repeated, coalesce(hits > 0.3 * words, FALSE) AS over_limit
        FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) a LEFT JOIN n ON n.id = a.doc_id""",
}
