"""Code tables of market-by-order records (fixed values)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

UNDEFINED_PRICE = (1 << 63) - 1

ACTION = [("A", "Add"), ("M", "Modify"), ("C", "Cancel"), ("R", "Clear"), ("T", "Trade"), ("F", "Fill"), ("N", "None")]
SIDE = [(1, "Buy"), (-1, "Sell"), (0, "None")]
RTYPE = [
    (0x00, "Mbp0"),
    (0x01, "Mbp1"),
    (0x0A, "Mbp10"),
    (0x12, "Status"),
    (0x13, "Definition"),
    (0x14, "Imbalance"),
    (0x15, "Error"),
    (0x16, "SymbolMapping"),
    (0x17, "System"),
    (0x18, "Statistics"),
    (0x20, "Ohlcv1s"),
    (0x21, "Ohlcv1m"),
    (0x22, "Ohlcv1h"),
    (0x23, "Ohlcv1d"),
    (0xA0, "Mbo"),
    (0xB1, "Cmbp1"),
    (0xC0, "Cbbo1s"),
    (0xC1, "Cbbo1m"),
    (0xC2, "Tcbbo"),
    (0xC3, "Bbo1s"),
    (0xC4, "Bbo1m"),
]
FLAGS = [(128, "Last"), (64, "Tob"), (32, "Snapshot"), (16, "Mbp"), (8, "BadTsRecv"), (4, "MaybeBadBook"), (2, "PublisherSpec")]
ORDER_TYPE = [(0, "None"), (1, "Limit"), (2, "Market")]
TIME_IN_FORCE = [(0, "None"), (1, "GoodTillCancel"), (2, "FillAndKill"), (3, "FillOrKill")]
SECURITY_TYPE = [(0, "None"), (1, "FX"), (2, "Stock"), (3, "Bond"), (4, "Future"), (5, "Option")]

TABLES = {"rtype": RTYPE, "flags": FLAGS, "side": SIDE, "order_type": ORDER_TYPE, "time_in_force": TIME_IN_FORCE, "security_type": SECURITY_TYPE}


def table(spark: SparkSession, name: str) -> DataFrame:
    """A code table as (code int, name string)."""
    return spark.createDataFrame(TABLES[name], "code int, name string")
