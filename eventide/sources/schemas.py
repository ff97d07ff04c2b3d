"""Declared schemas of raw documents and tables; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, _S) for n in names]


COMPANY_ITEM = T.StructType(_strings("cik_str", "cik", "ticker", "title", "name", "exchange"))
COMPANY_MAP = T.MapType(_S, COMPANY_ITEM)
COMPANY_LIST = T.ArrayType(COMPANY_ITEM)

# The eight parallel arrays of an event list.
EVENT_ARRAYS = ["accessionNumber", "form", "filingDate", "reportDate", "acceptanceDateTime",
                "primaryDocument", "isXBRL", "isInlineXBRL"]
EVENT_DOCUMENT = T.StructType(
    _strings("cik", "sic", "sicCode", "sicDescription", "sic_description") + [
        T.StructField("filings", T.StructType([
            T.StructField("recent", T.StructType([
                T.StructField(n, T.ArrayType(_S)) for n in EVENT_ARRAYS]))]))])

OBSERVATION = T.StructType(_strings("start", "end", "val", "accn", "fy", "fp", "form", "filed",
                                    "frame"))
FACT_DOCUMENT = T.StructType(_strings("cik", "entityName") + [
    T.StructField("facts", T.MapType(_S, T.MapType(_S, T.StructType([
        T.StructField("units", T.MapType(_S, T.ArrayType(OBSERVATION)))]))))])

REQUIRED_PRICE_COLUMNS = ["date", "open", "high", "low", "close", "adjusted_close", "volume"]
PRICE_CSV = T.StructType([T.StructField("date", T.DateType())] + [
    T.StructField(n, T.DoubleType()) for n in REQUIRED_PRICE_COLUMNS[1:]])
