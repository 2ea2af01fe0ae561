"""Price sources: files read by Spark, a Python data source with one partition per symbol, and gated network clients."""

from __future__ import annotations

import csv
import importlib
import warnings
from abc import ABC, abstractmethod
from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.series import simple_returns

PRICES = "symbol string, dt date, open double, high double, low double, close double, adj_close double, volume double"


class BatchFetchError(RuntimeError):
    """Some symbols failed; ``errors`` has why, ``partial_results`` what came."""

    def __init__(self, provider: str, errors: dict[str, str], partial_results: DataFrame | None = None) -> None:
        super().__init__(f"{provider}: {len(errors)} symbols failed: {', '.join(sorted(errors))}")
        self.provider, self.errors, self.partial_results = provider, errors, partial_results


class DataProvider(ABC):
    """Daily bars by symbol as a long frame of ``PRICES``. ``failed`` has the symbols of the last call for which nothing came,
    with the reason; a call that is not strict warns of them."""

    failed: dict[str, str]

    def report(self, errors: dict[str, str], held: DataFrame, strict: bool) -> DataFrame:
        self.failed = dict(errors)
        if errors and strict:
            raise BatchFetchError(type(self).__name__, errors, held)
        if errors:
            warnings.warn(f"{type(self).__name__}: nothing for {', '.join(sorted(errors))}", stacklevel=3)
        return held

    @abstractmethod
    def fetch_multiple(self, symbols: list[str], start: str, end: str, strict: bool = False) -> DataFrame: ...

    def fetch(self, symbol: str, start: str, end: str) -> DataFrame:
        return self.fetch_multiple([symbol], start, end, strict=True)

    def get_info(self, symbol: str) -> dict[str, object]:
        return {"symbol": symbol}

    @staticmethod
    def validate_dates(start: str, end: str) -> tuple[date, date]:
        a, b = date.fromisoformat(start), date.fromisoformat(end)
        if a > b:
            raise ValueError("start lies after end")
        return a, b

    @staticmethod
    def to_returns(prices: DataFrame) -> DataFrame:
        """sid, dt, ret from the adjusted close, or the close where there is none."""
        p = prices.select(F.col("symbol").alias("sid"), "dt", F.coalesce("adj_close", "close").alias("price")).where("price IS NOT NULL")
        return simple_returns(p)


class FileProvider(DataProvider):
    """Parquet or CSV files with the columns of ``PRICES``; symbol and date filters are pushed to the scan."""

    def __init__(self, spark: SparkSession, path: str, format: str = "parquet") -> None:
        self.spark, self.path, self.format = spark, path, format

    def _read(self) -> DataFrame:
        reader = self.spark.read.schema(PRICES)
        return reader.option("header", True).csv(self.path) if self.format == "csv" else reader.parquet(self.path)

    def fetch_multiple(self, symbols: list[str], start: str, end: str, strict: bool = False) -> DataFrame:
        a, b = self.validate_dates(start, end)
        df = self._read().where(F.col("symbol").isin(symbols) & F.col("dt").between(F.lit(a), F.lit(b)))
        held = {r[0] for r in df.select("symbol").distinct().collect()}  # at most the symbols asked for
        return self.report({s: "no rows" for s in symbols if s not in held}, df, strict)

    def get_info(self, symbol: str) -> dict[str, object]:
        """What the files say about a symbol: first and last day, number of days."""
        r = self._read().where(F.col("symbol") == symbol).agg(F.min("dt").alias("first"), F.max("dt").alias("last"), F.count("dt").alias("days")).first()
        return {"symbol": symbol, "first": r["first"], "last": r["last"], "days": r["days"]}


class _Gated(DataProvider):
    """A client library that may be absent; prices come to the driver symbol by symbol, as the services allow."""

    module = ""

    def __init__(self, spark: SparkSession, **options: object) -> None:
        try:
            self.client = importlib.import_module(self.module)
        except ImportError as e:
            raise ImportError(f"{type(self).__name__} needs the package {self.module}") from e
        self.spark, self.options = spark, options

    def rows(self, symbol: str, start: str, end: str) -> list[tuple]:
        raise NotImplementedError

    def fetch_multiple(self, symbols: list[str], start: str, end: str, strict: bool = False) -> DataFrame:
        self.validate_dates(start, end)
        found, errors = [], {}
        for s in symbols:
            try:
                bars = self.rows(s, start, end)
                found += bars
                if not bars:
                    errors[s] = "no rows"
            except Exception as e:  # a service's own errors
                errors[s] = str(e)
        return self.report(errors, self.spark.createDataFrame(found, PRICES), strict or not found)


class YahooFinanceProvider(_Gated):
    module = "yfinance"

    def rows(self, symbol: str, start: str, end: str) -> list[tuple]:
        h = self.client.Ticker(symbol).history(start=start, end=end, auto_adjust=False)
        return [(symbol, i.date(), float(r["Open"]), float(r["High"]), float(r["Low"]), float(r["Close"]), float(r.get("Adj Close", r["Close"])), float(r["Volume"])) for i, r in h.iterrows()]


    def get_info(self, symbol: str) -> dict[str, object]:
        return {"symbol": symbol} | dict(self.client.Ticker(symbol).info)


class AlphaVantageProvider(_Gated):
    module = "requests"

    def rows(self, symbol: str, start: str, end: str) -> list[tuple]:
        got = self.client.get("https://www.alphavantage.co/query", params={"function": "TIME_SERIES_DAILY_ADJUSTED", "symbol": symbol, "outputsize": "full", "apikey": self.options.get("api_key")}, timeout=30).json()
        bars = got.get("Time Series (Daily)", {})
        number = lambda bar, k: float(next(v for n, v in bar.items() if n.startswith(k)))
        return [(symbol, date.fromisoformat(d), *(number(b, k) for k in ("1.", "2.", "3.", "4.", "5.", "6."))) for d, b in bars.items() if start <= d <= end]


    def get_info(self, symbol: str) -> dict[str, object]:
        found = self.client.get("https://www.alphavantage.co/query", params={"function": "OVERVIEW", "symbol": symbol, "apikey": self.options.get("api_key")}, timeout=30).json()
        return {"symbol": symbol} | {k.lower(): v for k, v in found.items() if k != "Symbol"}


class TushareProvider(_Gated):
    module = "tushare"

    def rows(self, symbol: str, start: str, end: str) -> list[tuple]:
        bars = self.client.pro_api(self.options.get("token")).daily(ts_code=symbol, start_date=start.replace("-", ""), end_date=end.replace("-", ""))
        day = lambda t: date(int(t[:4]), int(t[4:6]), int(t[6:]))
        return [(symbol, day(r.trade_date), r.open, r.high, r.low, r.close, r.close, r.vol) for r in bars.itertuples()]


    def get_info(self, symbol: str) -> dict[str, object]:
        rows = self.client.pro_api(self.options.get("token")).stock_basic(ts_code=symbol).to_dict("records")
        return {"symbol": symbol} | (rows[0] if rows else {})


class AkShareProvider(_Gated):
    module = "akshare"

    def rows(self, symbol: str, start: str, end: str) -> list[tuple]:
        bars = self.client.stock_zh_a_hist(symbol=symbol, period="daily", start_date=start.replace("-", ""), end_date=end.replace("-", ""), adjust=self.options.get("adjust", "qfq"))
        return [(symbol, date.fromisoformat(str(r["日期"])[:10]), r["开盘"], r["最高"], r["最低"], r["收盘"], r["收盘"], r["成交量"]) for r in bars.to_dict("records")]


    def get_info(self, symbol: str) -> dict[str, object]:
        items = self.client.stock_individual_info_em(symbol=symbol)
        return {"symbol": symbol} | dict(zip(items["item"], items["value"], strict=True))


PROVIDERS = {"file": FileProvider, "parquet": FileProvider, "yahoo": YahooFinanceProvider, "yfinance": YahooFinanceProvider, "alphavantage": AlphaVantageProvider, "av": AlphaVantageProvider, "tushare": TushareProvider, "akshare": AkShareProvider}


def get_provider(name: str, *args: object, **kwargs: object) -> DataProvider:
    if name.lower() not in PROVIDERS:
        raise ValueError(f"provider must be one of {sorted(PROVIDERS)}")
    return PROVIDERS[name.lower()](*args, **kwargs)


def fetch_multiple_prices(symbols: list[str], provider: str = "yahoo", start: str | None = None, end: str | None = None, years: int = 5, strict: bool = False, **options: object) -> DataFrame:
    """Bars of several symbols from a named provider; by default the ``years`` years up to today."""
    last = date.fromisoformat(end) if end else datetime.now(UTC).date()
    first = start or (last - timedelta(days=round(365.25 * years))).isoformat()
    return get_provider(provider, **options).fetch_multiple(symbols, first, last.isoformat(), strict)


def fetch_price_data(symbol: str, provider: str = "yahoo", **options: object) -> DataFrame:
    """Bars of one symbol; that nothing came is an error."""
    return fetch_multiple_prices([symbol], provider, strict=True, **options)


def read_symbol_files(spark: SparkSession, folder: str) -> DataFrame:
    """One CSV of bars per symbol, named after it, as ``PRICES``: read by Spark itself, from any store that it knows. Column
    names may differ in case and blanks; the date column is ``dt`` or ``date``; absent columns are null."""
    raw = spark.read.option("header", True).csv(f"{folder.rstrip('/')}/*.csv")
    named = {c.strip().lower().replace(" ", "_"): c for c in raw.columns}
    day = next((named[k] for k in ("dt", "date") if k in named), None)
    if day is None:
        raise ValueError("the files have no column dt or date")
    number = lambda k: (F.col(f"`{named[k]}`").try_cast("double") if k in named else F.lit(None).cast("double")).alias(k)
    symbol = F.regexp_extract(F.url_decode(F.input_file_name()), r"([^/]+)\.csv$", 1)
    return raw.select(symbol.alias("symbol"), F.substring(F.col(f"`{day}`"), 1, 10).cast("date").alias("dt"), *(number(k) for k in ("open", "high", "low", "close", "adj_close", "volume")))


class _Symbol(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _FolderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]

    def partitions(self) -> list[_Symbol]:
        return [_Symbol(str(p)) for p in sorted(Path(self.folder).glob("*.csv"))]

    def read(self, partition: _Symbol) -> Iterator[tuple]:
        symbol = Path(partition.path).stem
        with open(partition.path, newline="") as f:
            for r in csv.DictReader(f):
                x = {k.strip().lower().replace(" ", "_"): v for k, v in r.items()}
                num = lambda k, x=x: float(x[k]) if x.get(k) not in (None, "") else None
                yield symbol, date.fromisoformat((x.get("dt") or x["date"])[:10]), num("open"), num("high"), num("low"), num("close"), num("adj_close"), num("volume")


class SymbolFolder(DataSource):
    """``spark.read.format("symbol_folder").load(folder)``: one CSV of bars per symbol, one partition each. The folder must be
    mounted on driver and executors alike; ``read_symbol_files`` reads from any store."""

    @classmethod
    def name(cls) -> str:
        return "symbol_folder"

    def schema(self) -> str:
        return PRICES

    def reader(self, schema: object) -> _FolderReader:
        return _FolderReader(dict(self.options))


_ff_provider = None
_ff_cache: dict[tuple[str, str, str], DataFrame] = {}


def set_ff_provider(provider: object) -> None:
    """A function (start, end, library) -> DataFrame of factor returns."""
    global _ff_provider
    _ff_provider = provider
    _ff_cache.clear()


def clear_ff_factor_cache() -> None:
    _ff_cache.clear()


def fetch_ff_factors(start: str, end: str, library: str = "french", provider: object = None) -> DataFrame:
    if provider is not None:
        return provider(start, end, library)
    if _ff_provider is None:
        raise ValueError("no factor provider is set")
    key = (start, end, library)
    if key not in _ff_cache:
        _ff_cache[key] = _ff_provider(start, end, library)
    return _ff_cache[key]
