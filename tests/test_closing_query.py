from collections import Counter

from pyspark.sql import functions as F

from tidemark.plans.book_queries import QUERIES
from tidemark.plans.views import trades

SF = "/root/testdata/sf0.001"


def test_closing_transactions_has_every_fill(spark):
    """Every fill once, and closing fills a second later that bring their symbols to nothing."""
    rows = QUERIES["closing_transactions"](spark, SF).collect()
    fills = [r for r in rows if not r["ts"].endswith(":01")]
    closing = [r for r in rows if r["ts"].endswith(":01")]
    expected = Counter((str(r["m"]), round(r["amount"], 4)) for r in trades(spark, SF).select(F.trunc("ts", "month").alias("m"), "amount").collect())
    assert Counter((r["ts"][:10], round(r["amount"], 4)) for r in fills) == expected
    net = Counter()
    for r in rows:
        net[r["symbol"]] += r["amount"]
    assert closing and all(abs(net[r["symbol"]]) < 1e-6 for r in closing)
    assert len({r["symbol"] for r in closing}) == len(closing)
