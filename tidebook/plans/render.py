"""Text forms of views. Rows are read from the driver's iterator, a book at a time; formatting is all that happens there.

Fixed values: all frames, headings and line layouts below are the output format.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codecs

_SIDES = ((1, "BUY"), (-1, "SELL"))


def event_line() -> Column:
    """One event as a line of text; an undefined price as its sentinel, the action as its character code."""
    price = codecs.price_or_sentinel(F.col("price"))
    return F.format_string(
        "ts_recv=%s ts_event=%s order_id=%s side=%s price=%s size=%s action=%s",
        *[F.col(c).cast("string") for c in ("ts_recv", "ts_event", "order_id", "side")], price.cast("string"), F.col("size").cast("string"), F.ascii("action").cast("string"),
    )


def render_depth(depth: DataFrame, instrument_id: int) -> str:
    """All levels of one book, best first."""
    rows = depth.where(F.col("instrument_id") == instrument_id).orderBy("side", "level_rank").collect()
    rule = "// ----------------\n"
    out = ""
    for side, name in _SIDES:
        out += f"{rule}// {name}\n{rule}" + "".join(f"  {r['price']} : {r['qty']}\n" for r in rows if r["side"] == side)
    return out


def _book(rows: list) -> str:
    out = ""
    for side, name in _SIDES:
        own = [r for r in rows if r["side"] == side]
        out += f"// {name}\n" + ("".join(f"  [{r['first_price']}, {r['last_price']}] : {r['qty']}\n" for r in own) or "  (empty)\n")
    return out


def _by_book(rows):
    """Yield the text of each book of rows, which come by instrument."""
    for i, own in groupby(rows, key=lambda r: r["instrument_id"]):
        yield f"// {i}\n" + _book(list(own))


def grouped_texts(grouped: DataFrame):
    """Yield the text of every book that isn't empty, by instrument."""
    yield from _by_book(grouped.orderBy("instrument_id", "side", "bucket").toLocalIterator())


def render_grouped(grouped: DataFrame, shards: int | None = None) -> str:
    """Grouped depth of every book that isn't empty, by instrument; with shards, one shard after another."""
    if not shards:
        return "".join(grouped_texts(grouped))
    key = F.col("shard") if "shard" in grouped.columns else F.pmod("instrument_id", F.lit(shards))
    rows = grouped.withColumn("shard", key).orderBy("shard", "instrument_id", "side", "bucket").toLocalIterator()
    return "".join(text for _, own in groupby(rows, key=lambda r: r["shard"]) for text in _by_book(own))


def render_snapshots(snapshots: DataFrame):
    """Yield the framed text of each cut in turn."""
    for cut, rows in groupby(snapshots.orderBy("cut", "instrument_id", "side", "bucket").toLocalIterator(), key=lambda r: r["cut"]):
        yield f"\n=== Snapshot at {cut} events ===\n{''.join(_by_book(rows))}===============================\n\n"


def _bbo_text(r) -> str:
    side = lambda p, q: "(empty)" if r[p] is None else f"{r[p]} x {r[q]}"
    return f"Instrument {r['instrument_id']}:\n  Best Bid: {side('bid_price', 'bid_qty')}\n  Best Ask: {side('ask_price', 'ask_qty')}\n"


def bbo_texts(bbo: DataFrame, shards: int | None = None):
    """Yield, in pieces, the best bid and ask of every book that isn't empty. With shards, a report for each shard in turn inside an outer frame."""
    head, foot = "\n// ====== Final Best Bid/Ask ======\n", "// ====== End Best Bid/Ask ======\n"
    yield head
    if not shards:
        yield from map(_bbo_text, bbo.orderBy("instrument_id").toLocalIterator())
    else:
        key = F.col("shard") if "shard" in bbo.columns else F.pmod("instrument_id", F.lit(shards))
        rows = bbo.withColumn("shard", key).orderBy("shard", "instrument_id").toLocalIterator()
        held = next(rows, None)
        for i in range(shards):
            yield head
            while held is not None and held["shard"] == i:
                yield _bbo_text(held)
                held = next(rows, None)
            yield foot
    yield foot


def render_bbo(bbo: DataFrame, shards: int | None = None) -> str:
    """bbo_texts as one text."""
    return "".join(bbo_texts(bbo, shards))


def render_summary(count: int, seconds: float) -> str:
    rate = count / seconds if seconds > 0 else 0.0
    return f"Total messages processed : {count}\nWall-clock time          : {seconds:.3f} s\nThroughput               : {rate:.0f} msg/s\n"


def code_report(spark) -> DataFrame:
    """(component, version, hash, date, branch, message) of the running build: this library and what it runs on; hash to message only of a checkout that has them."""
    import platform
    import subprocess
    from pathlib import Path

    def git(*args: str) -> str | None:
        try:
            got = subprocess.run(["git", *args], cwd=Path(__file__).parent, capture_output=True, text=True, timeout=10)
        except (OSError, subprocess.SubprocessError):
            return None
        return got.stdout.strip() or None if got.returncode == 0 else None

    from .. import __version__

    own = (git("log", "-1", "--format=%H"), git("log", "-1", "--format=%cI"), git("rev-parse", "--abbrev-ref", "HEAD"), git("log", "-1", "--format=%s"))
    rows = [("tidebook", __version__, *own)] + [(n, v, None, None, None, None) for n, v in (("python", platform.python_version()), ("spark", spark.version), ("system", platform.platform()))]
    return spark.createDataFrame(rows, "component string, version string, hash string, date string, branch string, message string")
