"""The order in which several feeds merge into one.

A merge is not a sort: a late record of a feed follows its predecessor at once. The place of a record is (running maximum of ts_recv in its file,
file, position in the file); ties between files go to the lower file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.events import ORDINAL
from .staging import cut


def place(max_ts: Column) -> Column:
    return F.struct(max_ts.alias("t"), *[F.col(c) for c in ORDINAL])


def merge_order(events: DataFrame, sorted_files: bool = False, chunk_rows: int | None = None) -> DataFrame:
    """events with ord, a struct that sorts in merge order.

    sorted_files: every file rises in ts_recv, so no window is needed. chunk_rows: take the running maximum in chunks of a file's rows and
    carry it over them, so that a file of any length spreads over tasks; row_idx must then count rows (Parquet, Arrow).
    """
    if sorted_files:
        return events.withColumn("ord", place(F.col("ts_recv")))
    by_row = [F.col("row_block"), F.col("row_idx")]
    if chunk_rows is None:
        w = Window.partitionBy("file_idx").orderBy(*by_row).rowsBetween(Window.unboundedPreceding, 0)
        return events.withColumn("ord", place(F.max("ts_recv").over(w)))
    chunked = events.withColumn("chunk_", F.floor(F.col("row_idx") / chunk_rows))
    tops = chunked.groupBy("file_idx", "row_block", "chunk_").agg(F.max("ts_recv").alias("top_"))
    ahead = Window.partitionBy("file_idx").orderBy("row_block", "chunk_").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("top_", F.max("top_").over(ahead))
    inside = Window.partitionBy("file_idx", "row_block", "chunk_").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    joined = chunked.join(tops, ["file_idx", "row_block", "chunk_"])
    top = F.greatest(F.max("ts_recv").over(inside), F.col("top_"))
    return joined.withColumn("ord", place(top)).drop("chunk_", "top_")


def global_rank(df: DataFrame, coarse: Column, order: list, counted: Column | None = None) -> DataFrame:
    """df with rank, 1 for the first, in the order of (coarse, *order); with counted (a condition), the number of counted rows up to each.

    One range partitioning by the whole order deals rows evenly, however their values lie; a row's place in its partition and the partitions' counts give the rank. The
    ranked rows are written once; partitions, not rows, meet in one task.
    """
    keys = ["coarse_", *order]
    flag = F.lit(1) if counted is None else F.coalesce(counted.cast("int"), F.lit(0))
    dealt = df.withColumn("coarse_", coarse).withColumn("flag_", flag).repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The low bits of the id count a partition's rows in their order.
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = cut(dealt.withColumn("bucket_", F.spark_partition_id()).withColumn("place_", place).drop("coarse_"), "rank")
    counts = placed.groupBy("bucket_").agg(F.sum("flag_").alias("n_"))
    ahead = F.sum("n_").over(Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_")
    counts = counts.select("bucket_", ahead.alias("base_"))
    joined = placed.join(F.broadcast(counts), "bucket_")
    inside = F.col("place_") + 1
    if counted is not None and placed.where("flag_ = 0").limit(1).count():
        upto = Window.partitionBy("bucket_").orderBy("place_").rowsBetween(Window.unboundedPreceding, 0)
        inside = F.sum("flag_").over(upto)
    return joined.withColumn("rank", (F.col("base_") + inside).cast("long")).drop("bucket_", "place_", "base_", "flag_")
