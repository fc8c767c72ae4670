"""Periodic snapshots: all books after every n-th counted event."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import book as fold
from .merge import global_rank
from .views import grouped_depth


def snapshots(events: DataFrame, every_n: int, groups: int = 5, book: list[str] | None = None, coarse=None, order: str = "ord", order_id: str = "order_id") -> DataFrame:
    """(cut, book keys, side, bucket, first_price, last_price, qty): grouped depth after each every_n-th event with ts_recv > 0.

    Events between cuts share a segment. Clears are counted over segments and then inside them, which numbers a book's epochs without gathering it. A
    level's state holds from its segment to the one before the level's next change or the book's next Clear, and is
    repeated only for the cuts in between, as often as it is printed.
    """
    book = book or ["instrument_id"]
    start = coarse if coarse is not None else F.col(order)
    counted = F.coalesce(F.col("ts_recv") > 0, F.lit(False))
    ranked = global_rank(events, start, [order], counted)
    cuts = (ranked.agg(F.max("rank")).first()[0] or 0) // every_n
    # An uncounted event after the cut's own event is applied after the cut.
    seg = F.floor((F.col("rank") - counted.cast("int")) / every_n)
    e = ranked.withColumn("seg", seg.cast("long")).where("action in ('A', 'C', 'M', 'R')")
    e = e.select(*book, order, order_id, "action", "side", "price", "size", "seg")

    clear = (F.col("action") == "R").cast("int")
    inside = Window.partitionBy(*book, "seg").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("in_", F.sum(clear).over(inside))
    per = e.where("action = 'R'").groupBy(*book, "seg").agg(F.count("*").alias("m_"))
    known = e.select(*book, "seg").distinct().join(per, [*book, "seg"], "left")
    known = known.withColumn("base_", F.coalesce(F.sum("m_").over(Window.partitionBy(*book).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m_")
    e = e.join(known, [*book, "seg"]).withColumn("ep", (F.col("base_") + F.col("in_")).cast("long")).drop("base_", "in_")
    ends = e.where("action = 'R'").select(*book, (F.col("ep") - 1).alias("ep"), F.col("seg").alias("end_"))

    keys = [*book, "ep"]
    at = F.struct("seg", order).alias("at")
    ops = fold.level_ops(e.where("action <> 'R'").withColumn("at", at), keys, "at", order_id)
    states = fold.level_states(ops, keys, "at").withColumn("seg", F.col("at.seg"))
    last = states.groupBy(*keys, "side", "price", "seg").agg(F.max_by(F.struct("qty", "exists"), F.struct("at", "sub")).alias("f"))
    upto = F.lead("seg").over(Window.partitionBy(*keys, "side", "price").orderBy("seg"))
    spans = last.withColumn("next_", upto).where("f.exists").join(ends, keys, "left")
    # Segment s ends at cut s: the state is printed at cuts seg to end - 1, of the cuts 0 to cuts - 1.
    end = F.least(F.coalesce("next_", F.lit(cuts)), F.coalesce("end_", F.lit(cuts)), F.lit(cuts))
    spans = spans.withColumn("end", end).where("seg < end")
    shown = spans.select(F.explode(F.sequence(F.col("seg"), F.col("end") - 1)).alias("k"), *book, "side", "price", F.col("f.qty").alias("qty"))
    shown = shown.withColumn("cut", (F.col("k") + 1) * every_n).drop("k")
    return grouped_depth(shown, groups, ["cut", *book])
