import json
from datetime import date, timedelta

from tidemark.operators.report import strategy_report

DAYS = [date(2001, 1, 1) + timedelta(i) for i in range(40)]


def _returns(spark):
    rows = [(0, d, 0.001 * (i % 7 - 3)) for i, d in enumerate(DAYS)]
    return spark.createDataFrame(rows[::-1], "sid int, dt date, ret double").repartition(4)


def test_json_has_every_row(spark, tmp_path):
    found = json.loads(open(strategy_report(_returns(spark), 0, str(tmp_path / "r.json"), most_rows=10, rolling_window=5)).read())
    assert [r["dt"] for r in found["sections"]["Growth"]] == [str(d) for d in DAYS]
    assert len(found["sections"]["Performance"]) == 13


def test_page_names_file_with_every_row(spark, tmp_path):
    page = open(strategy_report(_returns(spark), 0, str(tmp_path / "r.html"), most_rows=10, rolling_window=5)).read()
    assert "Growth (first 10 of 40 rows; all in r.growth.jsonl)" in page
    assert [json.loads(x)["dt"] for x in open(tmp_path / "r.growth.jsonl")] == [str(d) for d in DAYS]
    assert str(DAYS[9]) in page


def test_cells_and_plain_values():
    from datetime import date

    from tidemark.operators import report

    assert [report.sign_class(v) for v in (-1.0, 2, 0, None, float("nan"), True)] == [" class='neg'", " class='pos'", "", "", "", ""]
    assert report.plain_values([0.123456789, float("inf"), date(2024, 1, 2), "a"], 3, percent=True) == [12.346, None, "2024-01-02", "a"]
