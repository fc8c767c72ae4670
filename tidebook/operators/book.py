"""Limit-order books as window expressions over their events.

A book's state is what its events since its last Clear make of it. Windows over (book, order) tell each event what its order stood at before; events become
additions to and removals from price levels; windows over (book, side, price) add these up. A hot instrument spreads over its
orders and then over its price levels. Columns: book keys, order (a column that sorts), order_id, action, side, price, size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def since_clear(events: DataFrame, book: list[str], order: str = "ord") -> DataFrame:
    """The adds, cancels and modifies after each book's last Clear. One row a book is what the join moves."""
    cleared = events.where("action = 'R'").groupBy(*book).agg(F.max(order).alias("clear_"))
    live = events.where("action in ('A', 'C', 'M')").join(cleared, book, "left")
    return live.where(F.col("clear_").isNull() | (F.col(order) > F.col("clear_"))).drop("clear_")


def order_states(events: DataFrame, book: list[str], order: str = "ord", order_id: str = "order_id") -> DataFrame:
    """Add what each event finds of its order: tracked, and side, price, size before (ps, pp, pz); and what it sets (ws, wp, wz, wt).

    A valid add or modify sets all three, so nothing needs resetting after a full cancel.
    """
    before = Window.partitionBy(*book, order_id).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(c, ignorenulls=True).over(before)
    cancel, modify = F.col("action") == "C", F.col("action") == "M"
    valid = (F.col("action") != "C") & (F.col("side") != 0) & F.col("price").isNotNull()
    e = events.withColumn("valid", F.coalesce(valid, F.lit(False)))
    e = e.withColumn("wt", F.when(F.col("valid"), 1).when(cancel & (F.col("size") == 0), 0))
    e = e.withColumn("tracked", F.coalesce(last("wt"), F.lit(0)) == 1)
    changes = F.col("valid") | (modify & F.col("tracked"))
    e = e.withColumn("ws", F.when(changes & (F.col("side") != 0), F.col("side"))).withColumn("wp", F.when(changes, F.col("price")))
    e = e.withColumn("wz", F.when(F.col("valid") | ((cancel | modify) & F.col("tracked")), F.col("size")))
    return e.withColumns({"ps": last("ws"), "pp": last("wp"), "pz": last("wz")})


def level_ops(events: DataFrame, book: list[str], order: str = "ord", order_id: str = "order_id") -> DataFrame:
    """(book keys, order, sub, side, price, delta, adds): changes of price levels, a modify's removal (sub 0) before its addition (sub 1).

    A cancel's size is what remains: the difference leaves the level if positive. An add of a live order leaves its old volume in place; a fill or trade
    changes nothing.
    """
    e = order_states(events, book, order, order_id)
    cancel, modify = F.col("action") == "C", F.col("action") == "M"
    moved = modify & F.col("tracked")
    op = lambda sub, side, price, delta: F.struct(F.lit(sub).alias("sub"), side.cast("tinyint").alias("side"), price.alias("price"), delta.alias("delta"))
    takes = (cancel & F.col("tracked") & (F.col("pz") > F.col("size"))) | moved
    removal = F.when(takes, op(0, F.col("ps"), F.col("pp"), F.when(cancel, F.col("size") - F.col("pz")).otherwise(-F.col("pz"))))
    to_side = F.when(moved, F.coalesce("ws", "ps")).otherwise(F.col("side"))
    to_price = F.when(moved, F.coalesce("wp", "pp")).otherwise(F.col("price"))
    addition = F.when(F.col("valid") | moved, op(1, to_side, to_price, F.col("size")))
    ops = F.explode(F.filter(F.array(removal, addition), lambda x: x.isNotNull())).alias("op")
    return e.select(*book, order, ops).select(*book, order, "op.sub", "op.side", "op.price", "op.delta")


def level_states(ops: DataFrame, book: list[str], order: str = "ord") -> DataFrame:
    """ops with qty and exists, the level after each change. Removals never take a level below zero, which is a running sum reflected at zero; a
    level exists while it has volume or its last change was an addition."""
    upto = Window.partitionBy(*book, "side", "price").orderBy(order, "sub").rowsBetween(Window.unboundedPreceding, 0)
    s = ops.withColumn("sum_", F.sum("delta").over(upto))
    s = s.withColumn("qty", F.col("sum_") - F.least(F.lit(0), F.min("sum_").over(upto))).drop("sum_")
    return s.withColumn("exists", (F.col("qty") > 0) | (F.col("sub") == 1))


def levels(events: DataFrame, book: list[str] | None = None, order: str = "ord", order_id: str = "order_id", at=None) -> DataFrame:
    """(book keys, side, price, qty): the price levels of every book after all events, or after those up to at, a value of order (for a merged order a struct: see merge.place)."""
    book = book or ["instrument_id"]
    events = events if at is None else events.where(F.col(order) <= at)
    s = level_states(level_ops(since_clear(events, book, order), book, order, order_id), book, order)
    final = s.groupBy(*book, "side", "price").agg(F.max_by(F.struct("qty", "exists"), F.struct(order, "sub")).alias("f"))
    return final.where("f.exists").select(*book, "side", "price", F.col("f.qty").alias("qty"))


def live_orders(events: DataFrame, book: list[str] | None = None, order: str = "ord", order_id: str = "order_id", at=None) -> DataFrame:
    """(book keys, order_id, side, price, size) of every order that is still in its book after all events, or after those up to at."""
    book = book or ["instrument_id"]
    events = events if at is None else events.where(F.col(order) <= at)
    e = order_states(since_clear(events, book, order), book, order, order_id)
    for w, p in (("ws", "ps"), ("wp", "pp"), ("wz", "pz")):
        e = e.withColumn(w, F.coalesce(w, p))
    e = e.withColumn("wt", F.coalesce(F.col("wt"), F.col("tracked").cast("int")))
    last = F.max_by(F.struct("wt", F.col("ws").alias("side"), F.col("wp").alias("price"), F.col("wz").alias("size")), F.col(order)).alias("s")
    return e.groupBy(*book, order_id).agg(last).where("s.wt = 1").select(*book, order_id, "s.side", "s.price", "s.size")
