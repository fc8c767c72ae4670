"""Market-by-order events derived from other tables: from the events table, from row numbers, and feeds for the merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mbo_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as market-by-order events; ord is its event_id."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    kind, k = F.col("event_type"), F.col("k")
    action = (
        F.when(kind == "signup", "A").when(kind == "click", "M").when(kind == "purchase", "C").when(kind == "view", F.when(k % 2 == 0, "T").otherwise("F"))
        .when(kind == "error", F.when(k == 0, "R").otherwise("N"))
    )
    side = F.when(k % 3 == 0, 1).when(k % 3 == 1, -1).otherwise(F.when(k % 12 == 2, 0).otherwise(1))
    whole = F.floor("value").cast("long")
    size = F.when(kind == "purchase", F.when(F.col("value") < 30, 0).otherwise(whole % 20)).otherwise(whole % 50)
    return e.select(
        F.col("event_id").alias("ord"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_recv"), (F.col("user_id") * 4 + k % 4 + 1).alias("order_id"),
        (F.col("user_id") % 8 + 1).alias("instrument_id"), action.alias("action"), side.cast("tinyint").alias("side"),
        F.when(k != 1, F.lit(100_000_000_000) + F.floor(k / 5).cast("long") * 250_000_000).alias("price"), size.cast("long").alias("size"), "user_id", "k",
    )


def canonical(events: DataFrame) -> DataFrame:
    """mbo_events with all canonical columns, the missing ones derived from those present."""
    return events.select(
        "ts_recv", (F.col("ts_recv") - 1_000).alias("ts_event"), F.col("order_id").cast("decimal(20,0)").alias("order_id"), F.col("order_id").alias("order_key"), "price", "instrument_id",
        (F.col("user_id") % 3 + 1).alias("publisher_id"), F.col("ord").alias("sequence"), "size", F.lit(1_000).alias("ts_in_delta"), (F.col("k") % 7).cast("int").alias("channel_id"), "side",
        F.lit(160).cast("smallint").alias("rtype"), ((F.col("k") * 4) % 256).cast("smallint").alias("flags"), "action",
        F.lit(0).alias("file_idx"), F.lit(0).cast("long").alias("row_block"), F.col("ord").alias("row_idx"),
    )


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_idx, row_block, row_idx, ts_recv) of six feeds: events in four that rise in time, orders, and lineitem's last shipment of each, in two that don't.

    Row numbers are keys of the tables: unique and rising in a feed, not dense.
    """
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long") * 86_400_000_000_000
    zero = F.lit(0).cast("long").alias("row_block")
    e = mbo_events(spark, sf_dir).select((F.col("user_id") % 4).cast("int").alias("file_idx"), zero, F.col("ord").alias("row_idx"), "ts_recv")
    o = table(spark, sf_dir, "orders").select(F.lit(4).alias("file_idx"), zero, F.col("o_orderkey").alias("row_idx"), day("o_orderdate").alias("ts_recv"))
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("d"))
    i = last.select(F.lit(5).alias("file_idx"), zero, F.col("l_orderkey").alias("row_idx"), day("d").alias("ts_recv"))
    return e.unionByName(o).unionByName(i)


_BASE, _TICK = 5_000_000_000_000, 1_000_000_000


def workload(spark: SparkSession, n: int, instruments: int = 1) -> DataFrame:
    """n events by formula of the row number: of each four, a bid and an ask are added, the bid is cancelled, and it comes back by a modify.

    Bids and asks lie on ten prices each; an order keeps its instrument, of instruments many.
    """
    i = F.col("id")
    phase, level = i % 4, F.floor(i / 2) % 10
    first = F.when(phase == 2, i - 2).when(phase == 3, i - 3).otherwise(i)
    bid = (i % 2 == 0) | (phase == 3)
    price = F.when(phase == 2, None).when(phase == 3, _BASE).when(bid, _BASE - level * _TICK).otherwise(_BASE + (level + 1) * _TICK)
    return spark.range(n).select(
        i.alias("ord"), (i + 1).alias("ts_recv"), (first + 1).alias("order_id"), (first % instruments + 1).alias("instrument_id"),
        F.when(phase < 2, "A").when(phase == 2, "C").otherwise("M").alias("action"), F.when(phase == 2, 0).when(bid, 1).otherwise(-1).cast("tinyint").alias("side"),
        price.cast("long").alias("price"), F.when(phase < 2, 10 + level).when(phase == 2, 0).otherwise(5).cast("long").alias("size"),
    )
