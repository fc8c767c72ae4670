"""From events to the books that they belong to.

An event's instrument is the last one that was seen, in merge order, with its order_id; it outlives a cancel. An event
without order_id belongs to book 0 even if it names an instrument ('observed'); 'by_instrument' sends it to the instrument that it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SPREAD = 64


def resolve_instrument(events: DataFrame, routing: str = "observed", on_unresolved: str = "fail", shards: int | None = None, key: str = "order_key", order: str = "ord") -> DataFrame:
    """events with book (long), and with shards also shard.

    on_unresolved: 'fail' raises when such an event is read, 'keep' leaves its book null, 'drop' leaves it out. With shards an event
    goes to the shard of the instrument that it names, or of its book if it names none; in observed routing book 0 is one book a shard.
    """
    if routing not in ("observed", "by_instrument") or on_unresolved not in ("fail", "keep", "drop"):
        raise ValueError("unknown routing or policy")
    named = F.nullif(F.col("instrument_id"), F.lit(0))
    anonymous = F.col(key) == 0
    # Events without order_id need no history: they are spread, or else they would meet in one task.
    spread = F.when(anonymous, F.pmod(F.hash(order), F.lit(_SPREAD))).otherwise(0)
    w = Window.partitionBy(key, spread).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    alone = F.coalesce(named, F.lit(0)) if routing == "by_instrument" else F.lit(0)
    book = F.when(anonymous, alone).otherwise(F.last(named, ignorenulls=True).over(w)).cast("long")
    out = events.withColumn("book", book)
    if on_unresolved == "drop":
        out = out.where("book is not null")
    elif on_unresolved == "fail":
        message = F.concat(F.lit("cannot resolve instrument_id for order_id "), F.col(key).cast("string"))
        out = out.withColumn("book", F.when(F.col("book").isNull(), F.raise_error(message).cast("long")).otherwise(F.col("book")))
    if shards:
        out = out.withColumn("shard", F.pmod(F.coalesce(named, F.col("book")), F.lit(shards)).cast("int"))
    return out


def unresolved(events: DataFrame, key: str = "order_key", order: str = "ord") -> DataFrame:
    """The events whose instrument no earlier event of their order names."""
    return resolve_instrument(events, on_unresolved="keep", key=key, order=order).where("book is null").drop("book")


def shard(events: DataFrame, shards: int) -> DataFrame:
    """Physically deal routed events so that a book lies in one partition."""
    return events.repartition(shards, "book")
