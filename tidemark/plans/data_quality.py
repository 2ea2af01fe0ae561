"""Queries p1, p2, p3, p5 and p6 over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import attach_as_known
from ..operators.grid import regular_series
from ..operators.spikes import flag_readings, readings_of
from ..operators.timestamps import normalise_times
from ..operators.trailing import trailing_totals
from ..sources.tables import table


def _flags(spark: SparkSession, sf: str) -> DataFrame:
    prices = readings_of(table(spark, sf, "transactions_csv"), tab="transactions_csv", source="symbol", order=F.col("txn_id"), row_id="txn_id", value="price")
    quotes = readings_of(table(spark, sf, "global_index_data"), tab="global_index_data", source="代码", order=F.col("quote_id"), row_id="quote_id", value="涨跌幅")
    returns = readings_of(table(spark, sf, "returns_csv"), tab="returns_csv", source="sid", order=F.unix_date("c0"), row_id="return_id", value="c1", phase=F.weekday("c0"))
    rules = {"transactions_csv": (0.0, 1 << 19), "global_index_data": (-100.0, 1 << 19), "returns_csv": (-1.0, 64)}
    return flag_readings(prices.unionByName(quotes).unionByName(returns), rules)


def p1_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Every case with what speaks against it."""
    return _flags(spark, sf).where("impossible OR far OR in_run").drop("outlying")


def p1_outlying(spark: SparkSession, sf: str) -> DataFrame:
    """Readings beyond their source's generalised ESD limit on the residual from trend and season."""
    return _flags(spark, sf).where("outlying").select("tab", "row_id")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Cases: impossible, far beyond the spread that the ESD test left, or in a constant run."""
    return _flags(spark, sf).where("impossible OR far OR in_run").select("tab", "row_id")


def _timed(spark: SparkSession, sf: str, tab: str, key: str, text: str, *also: str) -> DataFrame:
    rows = table(spark, sf, tab).select(F.col(key).alias("row_id"), F.col(text).alias("text"), "feed", *also)
    return normalise_times(rows, "text", "feed", table(spark, sf, "feeds"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """UTC instants of both tables; copies write one instant in several ways and count once."""
    parts = [
        _timed(spark, sf, tab, key, text).where("row_id IS NOT NULL AND utc_us IS NOT NULL").select(F.lit(tab).alias("tab"), "row_id", "utc_us")
        for tab, key, text in (("transactions_csv", "txn_id", "date"), ("global_index_data", "quote_id", "最新行情时间"))
    ]
    return parts[0].union(parts[1]).groupBy("tab", "row_id").agg(F.min("utc_us").alias("utc_us"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return attach_as_known(
        table(spark, sf, "raw_positions"),
        table(spark, sf, "factor_loadings"),
        event_id="pos_id",
        event_entity="sid",
        event_time="ts",
        change_id="loading_id",
        change_entity="ticker",
        in_force="dt",
        known_at="known_at",
        value="financials",
    ).select(F.col("event_id").alias("pos_id"), F.col("change_id").alias("loading_id"))


def p5_series(spark: SparkSession, sf: str) -> DataFrame:
    returns = table(spark, sf, "returns_csv").select(F.lit("returns_csv").alias("tab"), F.col("sid").alias("source_key"), F.col("c0").alias("date"), F.col("c1").alias("value"), F.col("loaded_at").alias("seen_at"))
    factors = table(spark, sf, "factor_returns").select(F.lit("factor_returns").alias("tab"), F.col("model").alias("source_key"), F.col("dt").alias("date"), F.col("materials").alias("value"), F.col("loaded_at").alias("seen_at"))
    return regular_series(returns.unionByName(factors), table(spark, sf, "series_info"))


def p5_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every slot with its value, what fills it and from where."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return p5_series(spark, sf).select("tab", "source_key", day("slot"), "value", "filled", day("filled_from"), "missing")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_series(spark, sf).where("missing").select("tab", "source_key", F.date_format("slot", "yyyy-MM-dd").alias("slot"))


def p6_totals(spark: SparkSession, sf: str) -> DataFrame:
    trades = (
        _timed(spark, sf, "transactions_csv", "txn_id", "date", "symbol", "value")
        .where("symbol IS NOT NULL")
        .groupBy("row_id", "symbol")
        .agg(F.min("utc_us").alias("utc_us"), F.min("value").alias("value"))
        .where("utc_us IS NOT NULL")
        .select(F.lit("transactions_csv").alias("tab"), F.col("symbol").alias("source_key"), F.date_from_unix_date(F.floor(F.col("utc_us") / 86_400_000_000).cast("int")).alias("day"), F.round(F.col("value") * 100).cast("long").alias("units"))
    )
    returns = (
        table(spark, sf, "returns_csv")
        .where("sid IS NOT NULL")
        .groupBy("return_id", "sid")
        .agg(F.min("c0").alias("day"), F.min("c1").alias("c1"))
        .select(F.lit("returns_csv").alias("tab"), F.col("sid").alias("source_key"), "day", F.round(F.col("c1") * 1_000_000).cast("long").alias("units"))
    )
    return trailing_totals(trades.unionByName(returns))


def p6_averages(spark: SparkSession, sf: str) -> DataFrame:
    """Daily means over the last 7 and 30 days, in cents and millionths."""
    return p6_totals(spark, sf).select("tab", "source_key", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(F.col("average_7") + 3.7e-8, 4).alias("average_7"), F.round(F.col("average_30") + 3.7e-8, 4).alias("average_30"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_totals(spark, sf).select("tab", "source_key", F.date_format("day", "yyyy-MM-dd").alias("day"), "total_7", "total_30")


# Wall-clock texts to instants: candidates an hour apart are tried, which covers the zones of `feeds`.
_UTC_SQL = r"""
        src AS (
          SELECT 'transactions_csv' AS tab, txn_id AS row_id, date AS t, feed, symbol, value FROM transactions_csv
          UNION ALL SELECT 'global_index_data', quote_id, "最新行情时间", feed, NULL, NULL FROM global_index_data),
        t0 AS (SELECT s.*, f.tz, f.day_first, trim(translate(t, '：，．－／＋　' || chr(9), ':,.-/+  ')) AS x FROM src s LEFT JOIN feeds f ON f.feed = s.feed),
        t1 AS (SELECT *,
          regexp_extract(x, '^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2})(:\d{2})?[.,]?(\d*) ?(.*)$', ['d', 'hm', 's', 'f', 'z']) AS a,
          regexp_extract(x, '^(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})([-+]\d{4})?$', ['y', 'm', 'd', 'h', 'n', 's', 'z']) AS b,
          regexp_extract(x, '^(\d{4})[年.](\d{1,2})[月.](\d{1,2})日? (\d{2}:\d{2})(:\d{2})?$', ['y', 'm', 'd', 'hm', 's']) AS c,
          regexp_extract(x, '^(\d{2})[/.](\d{2})[/.](\d{4}) (\d{2}):(\d{2})(:\d{2})? ?([AP]M)?$', ['p', 'q', 'y', 'h', 'n', 's', 'half']) AS e,
          regexp_extract(x, '^(\d{1,2}) ([A-Z][a-z]{2}) (\d{4}) (\d{2}:\d{2}:\d{2}) ([-+]\d{4})$', ['d', 'mon', 'y', 'hms', 'z']) AS g
          FROM t0),
        t2 AS (SELECT *, CASE
            WHEN a.d <> '' THEN a.d || ' ' || a.hm || coalesce(nullif(a.s, ''), ':00') || '.' || rpad(left(a.f, 6), 6, '0')
            WHEN b.y <> '' THEN b.y || '-' || b.m || '-' || b.d || ' ' || b.h || ':' || b.n || ':' || b.s || '.000000'
            WHEN c.y <> '' THEN c.y || '-' || lpad(c.m, 2, '0') || '-' || lpad(c.d, 2, '0') || ' ' || c.hm || coalesce(nullif(c.s, ''), ':00') || '.000000'
            WHEN e.y <> '' THEN e.y || '-' || CASE WHEN day_first THEN e.q || '-' || e.p ELSE e.p || '-' || e.q END || ' '
              || CASE e.half WHEN '' THEN e.h WHEN 'AM' THEN lpad(CAST(TRY_CAST(e.h AS INTEGER) % 12 AS VARCHAR), 2, '0') ELSE CAST(TRY_CAST(e.h AS INTEGER) % 12 + 12 AS VARCHAR) END || ':' || e.n || coalesce(nullif(e.s, ''), ':00') || '.000000'
            WHEN g.y <> '' THEN g.y || '-' || lpad(CAST((position(g.mon IN 'JanFebMarAprMayJunJulAugSepOctNovDec') + 2) // 3 AS VARCHAR), 2, '0') || '-' || lpad(g.d, 2, '0') || ' ' || g.hms || '.000000'
          END AS wall_text,
          coalesce(nullif(a.z, ''), nullif(b.z, ''), nullif(g.z, ''), '') AS z FROM t1),
        t3 AS (SELECT *, try_strptime(wall_text, '%Y-%m-%d %H:%M:%S.%f') AS w FROM t2),
        t4 AS (SELECT *, CASE WHEN tz IS NOT NULL THEN timezone(tz, w) END AS u FROM t3),
        t5 AS (SELECT *, timezone(tz, u) = w AS exists_, CASE WHEN timezone(tz, u - INTERVAL 1 HOUR) = w THEN u - INTERVAL 1 HOUR ELSE u END AS early, CASE WHEN timezone(tz, u + INTERVAL 1 HOUR) = w THEN u + INTERVAL 1 HOUR ELSE u END AS late FROM t4),
        utc AS (SELECT tab, row_id, symbol, value, CASE
            WHEN regexp_matches(x, '^\d{10}$') THEN TRY_CAST(x AS BIGINT) * 1000000
            WHEN regexp_matches(x, '^\d{13}$') THEN TRY_CAST(x AS BIGINT) * 1000
            WHEN regexp_matches(x, '^\d{16}$') THEN TRY_CAST(x AS BIGINT)
            WHEN w IS NULL OR (e.half <> '' AND TRY_CAST(e.h AS INTEGER) NOT BETWEEN 1 AND 12) THEN NULL
            WHEN upper(z) = 'Z' THEN epoch_us(w)
            WHEN regexp_matches(z, '^[-+]\d{2}:?\d{2}$') THEN epoch_us(w) - CASE left(z, 1) WHEN '-' THEN -1 ELSE 1 END * (TRY_CAST(substr(z, 2, 2) AS BIGINT) * 3600 + TRY_CAST(right(z, 2) AS BIGINT) * 60) * 1000000
            WHEN NOT exists_ THEN NULL
            WHEN z IN ('EST', 'CST', 'GMT', 'CET', 'AEST', 'NST') THEN epoch_us(late)
            WHEN z = '' OR regexp_matches(z, '^[A-Za-z_/]+$') THEN epoch_us(early) END AS utc_us FROM t5)"""


# Level and spread by median and median deviation, then mean and deviation of what lies within: another road to the same cases.
_CASES_SQL = """WITH r AS (
          SELECT 'transactions_csv' AS tab, symbol AS src, txn_id AS ord, txn_id AS row_id, min(price) AS x, 0.0 AS least FROM transactions_csv WHERE symbol IS NOT NULL AND price IS NOT NULL GROUP BY symbol, txn_id
          UNION ALL SELECT 'global_index_data', "代码", quote_id, quote_id, min("涨跌幅"), -100.0 FROM global_index_data WHERE "代码" IS NOT NULL AND "涨跌幅" IS NOT NULL GROUP BY "代码", quote_id
          UNION ALL SELECT 'returns_csv', sid, CAST(min(c0) - DATE '1970-01-01' AS BIGINT), return_id, min(c1), -1.0 FROM returns_csv WHERE sid IS NOT NULL AND c1 IS NOT NULL GROUP BY sid, return_id),
        m AS (SELECT tab, src, median(x) AS med FROM r WHERE x > least GROUP BY 1, 2),
        a AS (SELECT r.tab, r.src, m.med, median(abs(x - med)) AS mad FROM r JOIN m ON m.tab = r.tab AND m.src = r.src WHERE x > least GROUP BY 1, 2, 3),
        k AS (SELECT r.tab, r.src, avg(x) AS lvl, stddev_samp(x) AS sd FROM r JOIN a ON a.tab = r.tab AND a.src = r.src WHERE x > least AND abs(x - med) <= 8 * 1.4826 * mad GROUP BY 1, 2),
        low AS (SELECT tab, row_id FROM r WHERE x <= least),
        far AS (SELECT r.tab, row_id FROM r JOIN k ON k.tab = r.tab AND k.src = r.src WHERE abs(x - lvl) > 8 * sd),
        b AS (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY tab, src ORDER BY ord, row_id) THEN 0 ELSE 1 END AS fresh FROM r),
        c AS (SELECT *, sum(fresh) OVER (PARTITION BY tab, src ORDER BY ord, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM b),
        stuck AS (SELECT tab, row_id FROM (SELECT tab, row_id, count(*) OVER (PARTITION BY tab, src, run) AS n FROM c) x WHERE n >= 5)"""


_SUMS_SQL = f"""WITH {_UTC_SQL},
        trades AS (SELECT 'transactions_csv' AS tab, symbol AS source_key, CAST(make_timestamp(min(utc_us)) AS DATE) AS d, CAST(round(min(value) * 100) AS BIGINT) AS v FROM utc WHERE tab = 'transactions_csv' AND symbol IS NOT NULL GROUP BY row_id, symbol HAVING min(utc_us) IS NOT NULL),
        rets AS (SELECT 'returns_csv' AS tab, sid AS source_key, min(c0) AS d, CAST(round(min(c1) * 1000000) AS BIGINT) AS v FROM returns_csv WHERE sid IS NOT NULL GROUP BY return_id, sid),
        daily AS (SELECT tab, source_key, d, coalesce(sum(v), 0) AS v FROM (SELECT * FROM trades UNION ALL SELECT * FROM rets) x GROUP BY 1, 2, 3),
        cal AS (SELECT tab, source_key, CAST(unnest(generate_series(CAST(min(d) AS TIMESTAMP), CAST(max(d) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM daily GROUP BY 1, 2),
        full_ AS (SELECT cal.tab, cal.source_key, cal.d, coalesce(v, 0) AS v FROM cal LEFT JOIN daily ON daily.tab = cal.tab AND daily.source_key = cal.source_key AND daily.d = cal.d),
        sums AS (SELECT tab, source_key, strftime(d, '%Y-%m-%d') AS day, sum(v) OVER (PARTITION BY tab, source_key ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS t7,
          sum(v) OVER (PARTITION BY tab, source_key ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS t30 FROM full_)"""


QUERIES = {"p1_found": p1_found, "p1_flags": p1_flags, "p1_outlying": p1_outlying, "p2_found": p2_found, "p3_found": p3_found, "p5_found": p5_found, "p5_grid": p5_grid, "p6_found": p6_found, "p6_averages": p6_averages}

SQL = {
    "p1_found": f"{_CASES_SQL} SELECT tab, row_id FROM far UNION SELECT tab, row_id FROM low UNION SELECT tab, row_id FROM stuck",
    "p1_flags": f"""{_CASES_SQL}, every AS (SELECT tab, row_id, TRUE AS a, FALSE AS b, FALSE AS c FROM low UNION ALL SELECT tab, row_id, FALSE, TRUE, FALSE FROM far UNION ALL SELECT tab, row_id, FALSE, FALSE, TRUE FROM stuck)
        SELECT tab, row_id, bool_or(a) AS impossible, bool_or(b) AS far, bool_or(c) AS in_run FROM every GROUP BY tab, row_id""",
    "p2_found": f"WITH {_UTC_SQL} SELECT tab, row_id, min(utc_us) AS utc_us FROM utc WHERE utc_us IS NOT NULL GROUP BY tab, row_id",
    "p6_found": f"{_SUMS_SQL} SELECT tab, source_key, day, CAST(t7 AS BIGINT) AS total_7, CAST(t30 AS BIGINT) AS total_30 FROM sums",
    "p6_averages": f"{_SUMS_SQL} SELECT tab, source_key, day, round(t7 / 7.0 + 3.7e-8, 4) AS average_7, round(t30 / 30.0 + 3.7e-8, 4) AS average_30 FROM sums",
    "p3_found": """
        WITH joined AS (
          SELECT p.pos_id, l.loading_id, row_number() OVER (PARTITION BY p.pos_id ORDER BY l.dt DESC, l.known_at DESC, l.loading_id DESC) AS k
          FROM (SELECT DISTINCT pos_id, ts, sid FROM raw_positions) p
          JOIN factor_loadings l ON l.ticker = CAST(p.sid AS VARCHAR) AND l.financials IS NOT NULL AND l.known_at <= p.ts
            AND l.dt <= CAST(timezone('UTC', p.ts) AS DATE))
        SELECT pos_id, loading_id FROM joined WHERE k = 1""",
    "p5_found": """
        WITH info AS (SELECT tab, source_key, cadence, start_dt, end_dt FROM series_info),
        slots AS (
          SELECT tab, source_key, cadence, CAST(d AS DATE) AS slot
          FROM (SELECT *, unnest(generate_series(CAST(start_dt AS TIMESTAMP), CAST(end_dt AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM info) x
          WHERE (cadence = 'weekly' AND isodow(CAST(d AS DATE)) = 5) OR (cadence = 'daily' AND isodow(CAST(d AS DATE)) <= 5)),
        readings AS (
          SELECT DISTINCT 'returns_csv' AS tab, sid AS source_key, c0 AS d FROM returns_csv WHERE c1 IS NOT NULL
          UNION SELECT DISTINCT 'factor_returns', model, dt FROM factor_returns WHERE materials IS NOT NULL),
        held AS (
          SELECT i.tab, i.source_key, CASE WHEN i.cadence = 'weekly' THEN CAST(r.d - CAST(isodow(r.d) - 5 AS INTEGER) AS DATE) ELSE r.d END AS slot
          FROM readings r JOIN info i ON i.tab = r.tab AND i.source_key = r.source_key)
        SELECT s.tab, s.source_key, strftime(s.slot, '%Y-%m-%d') AS slot
        FROM slots s WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.tab = s.tab AND h.source_key = s.source_key AND h.slot = s.slot)""",
    "p5_grid": """
        WITH readings AS (
          SELECT 'returns_csv' AS tab, sid AS source_key, c0 AS d, c1 AS v, loaded_at AS seen FROM returns_csv WHERE c1 IS NOT NULL AND NOT isnan(c1)
          UNION ALL SELECT 'factor_returns', model, dt, materials, loaded_at FROM factor_returns WHERE materials IS NOT NULL AND NOT isnan(materials)),
        slots AS (SELECT tab, source_key, cadence, CAST(d AS DATE) AS slot FROM (SELECT *, unnest(generate_series(CAST(start_dt AS TIMESTAMP), CAST(end_dt AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM series_info) x
          WHERE (cadence = 'weekly' AND isodow(CAST(d AS DATE)) = 5) OR (cadence = 'daily' AND isodow(CAST(d AS DATE)) <= 5)),
        placed AS (SELECT r.*, CASE WHEN i.cadence = 'weekly' THEN CAST(r.d - CAST(isodow(r.d) - 5 AS INTEGER) AS DATE) WHEN isodow(r.d) <= 5 THEN r.d END AS slot FROM readings r JOIN series_info i ON i.tab = r.tab AND i.source_key = r.source_key),
        best AS (SELECT tab, source_key, slot, v FROM (SELECT *, row_number() OVER (PARTITION BY tab, source_key, slot ORDER BY d DESC, seen DESC NULLS LAST, v DESC) AS k FROM placed WHERE slot IS NOT NULL) x WHERE k = 1),
        j AS (SELECT s.tab, s.source_key, s.slot, b.v, CASE WHEN b.v IS NOT NULL THEN s.slot END AS own FROM slots s LEFT JOIN best b ON b.tab = s.tab AND b.source_key = s.source_key AND b.slot = s.slot)
        SELECT tab, source_key, strftime(slot, '%Y-%m-%d') AS slot, v AS value, last_value(v IGNORE NULLS) OVER w AS filled, strftime(last_value(own IGNORE NULLS) OVER w, '%Y-%m-%d') AS filled_from, v IS NULL AS missing
        FROM j WINDOW w AS (PARTITION BY tab, source_key ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
}
