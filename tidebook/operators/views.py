"""Views of price levels (book keys, side, price, qty)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BOOK = ["instrument_id"]


def best_price(levels: DataFrame, side: int, book: list[str] = BOOK) -> DataFrame:
    """(book keys, price): the highest bid or the lowest ask of every book that has that side; no rows for side 0."""
    own = levels.where(F.col("side") == side) if side else levels.limit(0)
    return own.groupBy(*book).agg((F.max("price") if side > 0 else F.min("price")).alias("price"))


def volume_at(levels: DataFrame, points: DataFrame, book: list[str] = BOOK) -> DataFrame:
    """points (book keys, side, price) with qty, 0 where there is no such level."""
    return points.join(levels, [*book, "side", "price"], "left").withColumn("qty", F.coalesce("qty", F.lit(0)))


def side_levels(levels: DataFrame, side: int) -> DataFrame:
    """The levels of a side; anything but the bid side means asks."""
    return levels.where(F.col("side") == (1 if side == 1 else -1))


def is_empty(levels: DataFrame, books: DataFrame, book: list[str] = BOOK) -> DataFrame:
    """books (book keys) with bid_empty, ask_empty, and both_empty, which is what side None asks for."""
    has = levels.groupBy(*book).agg(F.max((F.col("side") == 1).cast("int")).alias("b"), F.max((F.col("side") == -1).cast("int")).alias("a"))
    out = books.join(has, book, "left").select(*book, (F.coalesce("b", F.lit(0)) == 0).alias("bid_empty"), (F.coalesce("a", F.lit(0)) == 0).alias("ask_empty"))
    return out.withColumn("both_empty", F.col("bid_empty") & F.col("ask_empty"))


def _rank(book: list[str]):
    # Best first: bids fall, asks rise.
    return F.row_number().over(Window.partitionBy(*book, "side").orderBy(-F.col("side") * F.col("price")))


def depth(levels: DataFrame, book: list[str] = BOOK) -> DataFrame:
    """levels with level_rank, 1 for the best of its side."""
    return levels.withColumn("level_rank", _rank(book))


def grouped_depth(levels: DataFrame, n: int, book: list[str] = BOOK) -> DataFrame:
    """(book keys, side, bucket, first_price, last_price, qty): each side's levels, best first, in at most n buckets of equal numbers of levels.

    A bucket has ceil(levels / n) levels and the last what is left, so there can be fewer than n. first_price is the better one.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    # One window, cheaper than a join with counts: the number of levels of a side is bounded by its distinct prices.
    total = F.count("*").over(Window.partitionBy(*book, "side"))
    r = levels.withColumn("rank_", _rank(book)).withColumn("width_", F.ceil(total / n))
    r = r.withColumn("bucket", F.floor((F.col("rank_") - 1) / F.col("width_")).cast("int"))
    by = r.groupBy(*book, "side", "bucket").agg(F.min_by("price", "rank_").alias("first_price"), F.max_by("price", "rank_").alias("last_price"), F.sum("qty").alias("qty"))
    return by.select(*book, "side", "bucket", "first_price", "last_price", "qty")


def bbo(levels: DataFrame, book: list[str] = BOOK) -> DataFrame:
    """(book keys, bid_price, bid_qty, ask_price, ask_qty) of every book that isn't empty; null for an empty side."""
    level = F.struct("price", "qty")
    best = levels.groupBy(*book).agg(F.max(F.when(F.col("side") == 1, level)).alias("b"), F.min(F.when(F.col("side") == -1, level)).alias("a"))
    return best.select(*book, F.col("b.price").alias("bid_price"), F.col("b.qty").alias("bid_qty"), F.col("a.price").alias("ask_price"), F.col("a.qty").alias("ask_qty"))
