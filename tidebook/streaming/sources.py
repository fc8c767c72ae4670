"""Event files as a stream: files that appear in a folder are decoded as they come, merged in event time, and routed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..sources import events as ev


def stream_json(spark: SparkSession, folder: str, max_files: int | None = None, **decode) -> DataFrame:
    """Good events of the *.mbo.json files of a folder, with file and row_block, as a streaming DataFrame."""
    reader = spark.readStream.format("text").option("pathGlobFilter", "*" + ev.SUFFIXES["json"])
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(folder).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("row_block"))
    return ev.decode_lines(lines, **decode).where("reason is null").select(*ev.EVENT_COLUMNS, "file", "row_block")


def order_text(t, file, row_block, row_idx):
    """The place of a record in merge order as text that sorts like it: its file's running maximum of ts_recv, file, place in the file."""
    wide = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat(wide(t, 19), F.lit("\u0001"), file, F.lit("\u0001"), wide(row_block, 19), wide(row_idx, 19))


class StreamMerge:
    """Merges the events of a stream's files in event time, micro-batch by micro-batch.

    A record's time is the running maximum of ts_recv in its file, as in the batch merge. Records wait in a table until the watermark, the latest time seen less delay (in ns), has passed
    them; then sink(batch, batch_id) gets them, with ord, a text that sorts in merge order, and late. So all records whose files come no later than delay are given in merge order.
    A record that comes after the watermark has passed it is given at once, with late true, as a merge passes late records on; nothing is dropped. finish() gives what still waits.

    The waiting table and the watermark are kept in folder, a version a micro-batch: one that runs again starts from the version before it.
    """

    KEPT = 3

    def __init__(self, spark: SparkSession, folder: str, delay: int, sink):
        self.spark, self.folder, self.delay, self.sink = spark, folder.rstrip("/"), delay, sink
        self.fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _version(self, before: int | None = None) -> int | None:
        """The last finished version, or the last before a micro-batch."""
        if not self.fs.exists(self._path(self.folder)):
            return None
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.folder))]
        done = [int(n[5:]) for n in names if n.startswith("mark-") and self.fs.exists(self._path(f"{self.folder}/{n}/_SUCCESS"))]
        return max((v for v in done if before is None or v < before), default=None)

    def _state(self, version: int | None) -> tuple[DataFrame | None, int]:
        if version is None:
            return None, -1
        return self.spark.read.parquet(f"{self.folder}/waiting-{version}"), self.spark.read.parquet(f"{self.folder}/mark-{version}").first()["mark"]

    def _give(self, rows: DataFrame, version: int, mark: int, waiting, batch_id: int) -> None:
        # rows is read from tables only, so that both halves see the same.
        waiting.write.mode("overwrite").parquet(f"{self.folder}/waiting-{version}")
        self.sink(rows, batch_id)
        self.spark.createDataFrame([(mark,)], "mark long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/mark-{version}")
        for old in range(max(0, version - self.KEPT - 5), version - self.KEPT + 1):
            for name in ("waiting", "mark", "batch"):
                self.fs.delete(self._path(f"{self.folder}/{name}-{old}"), True)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        held, mark = self._state(self._version(batch_id))
        row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        upto = Window.partitionBy("file").orderBy("row_block", "row_idx").rowsBetween(Window.unboundedPreceding, 0)
        rows = batch.withColumn("row_idx", row).withColumn("t", F.max("ts_recv").over(upto))
        rows = rows.withColumn("ord", order_text(F.col("t"), F.col("file"), F.col("row_block"), F.col("row_idx"))).drop("row_idx")
        path = f"{self.folder}/batch-{batch_id}"
        rows.write.mode("overwrite").parquet(path)
        rows = self.spark.read.parquet(path).withColumn("late", F.col("t") <= mark)
        top = rows.agg(F.max("t")).first()[0]
        new = max(mark, top - self.delay) if top is not None else mark
        both = rows if held is None else rows.unionByName(held)
        out = (F.col("t") <= new) | F.col("late")
        self._give(both.where(out), batch_id, new, both.where(~out), batch_id)

    def finish(self) -> None:
        """Give all that waits, once the stream has ended."""
        version = self._version()
        held, mark = self._state(version)
        if held is not None:
            self._give(held, version + 1, mark, held.limit(0), version + 1)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run over a stream of events with file and row_block (stream_json)."""
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**trigger).start()


class RouteProcessor(StatefulProcessor):
    """Keeps the last instrument that an order's events named; rows of a batch are taken in ord."""

    def __init__(self, expire_ms: int | None):
        self.expire_ms = expire_ms

    def init(self, handle):
        self.known = handle.getValueState("known", "instrument_id long", self.expire_ms)

    def handleInputRows(self, key, rows, timers):
        batch = pd.concat(list(rows)).sort_values("ord", kind="stable")
        last = self.known.get()[0] if self.known.exists() else None
        books = []
        for named in batch["instrument_id"]:
            if named:
                last = int(named)
            # Events without order belong to book 0.
            books.append(0 if key[0] == 0 else last)
        if key[0] != 0 and last is not None:
            self.known.update((last,))
        batch["instrument_id"] = pd.array(books, dtype="Int64")
        yield batch

    def close(self):
        pass


def stream_route(events: DataFrame, expire_ms: int | None = None) -> DataFrame:
    """Streaming events (order_key, ord, instrument_id, action, side, price, size) as (order_id, ord, instrument_id, ...) with instrument_id the book's; null where it can't be told.

    expire_ms: forget an order of which nothing came for so long, by the clock; without it every order is remembered, as the batch routing does.
    """
    routed = f"order_id long, ord {dict(events.dtypes)['ord']}, instrument_id long, action string, side int, price long, size long"
    late = [c for c in ("late",) if c in events.columns]
    cols = events.select(F.col("order_key").alias("order_id"), "ord", "instrument_id", "action", F.col("side").cast("int").alias("side"), "price", "size", *late)
    return cols.groupBy("order_id").transformWithStateInPandas(
        statefulProcessor=RouteProcessor(expire_ms), outputStructType=routed + ", late boolean" * len(late), outputMode="Append", timeMode="ProcessingTime" if expire_ms else "None"
    )
