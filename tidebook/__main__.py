"""python -m tidebook PATH: books of one event file, or of all event files in a folder.

Prints the grouped depth of all books after every 5,000,000th event, a summary, and the final best bid and ask.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

from .operators import book, merge, routing, snapshots, views
from .operators.staging import cut
from .plans import render
from .sources import events as ev

SNAPSHOT_EVERY = 5_000_000
GROUPS = 5
#: Rows of a file that one task takes the running maximum of.
CHUNK_ROWS = 1 << 20


def format_of(spark: SparkSession, path: str) -> str:
    """The format of a file by its suffix; of a folder, the first of Arrow, JSON and Parquet that it holds files of."""
    for fmt in ("feather", "json", "parquet"):
        if path.endswith(ev.SUFFIXES[fmt]):
            return fmt
    for fmt in ("feather", "json", "parquet"):
        try:
            if ev.discover(spark, path, fmt):
                return fmt
        except ValueError:
            continue
    raise ValueError(f"unsupported format or no event files: {path}")


def report(spark: SparkSession, path: str, every: int = SNAPSHOT_EVERY, groups: int = GROUPS):
    """Yield the texts of a run in turn."""
    began = time.time()
    events = ev.read_events(spark, path, format_of(spark, path))
    events = cut(routing.resolve_instrument(merge.merge_order(events, chunk_rows=CHUNK_ROWS)).drop("instrument_id").withColumnRenamed("book", "instrument_id"))
    count = events.where("ts_recv > 0").count()
    if count >= every:
        shown = snapshots.snapshots(events, every, groups, coarse=events["ord"]["t"], order_id="order_key")
        yield from render.render_snapshots(shown)
    best = render.render_bbo(views.bbo(book.levels(events, order_id="order_key")))
    yield render.render_summary(count, time.time() - began)
    yield best


def main(args: list[str]) -> int:
    if len(args) != 1:
        print("usage: python -m tidebook PATH", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("tidebook").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for text in report(spark, args[0]):
        print(text, end="")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
