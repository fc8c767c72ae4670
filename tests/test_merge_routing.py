import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidebook.operators import book, merge, routing

FEED = "file_idx int, row_block long, row_idx long, ts_recv long"


def feeds(spark, *lists):
    return spark.createDataFrame([(f, 0, i, t) for f, ts in enumerate(lists) for i, t in enumerate(ts)], FEED)


def merged(df, **kw):
    return [r["ts_recv"] for r in merge.merge_order(df, **kw).orderBy("ord").collect()]


@pytest.mark.parametrize("lists,want", [
    (([100, 300], [50, 200]), [50, 100, 200, 300]),
    (([100, 400], [200, 500], [50, 300]), [50, 100, 200, 300, 400, 500]),
    (([100, 150, 200],), [100, 150, 200]),
    (([100], []), [100]),
    (([], []), []),
    (([0, 3, 6, 9], [1, 4, 7], [2, 5, 8]), list(range(10))),
])
def test_cases(spark, lists, want):
    assert merged(feeds(spark, *lists)) == want
    assert merged(feeds(spark, *lists), sorted_files=True) == want


def test_ties_and_late_records(spark):
    df = merge.merge_order(feeds(spark, [10], [10])).orderBy("ord").collect()
    assert [r["file_idx"] for r in df] == [0, 1]
    assert merged(feeds(spark, [10, 5, 12], [7, 11])) == [7, 10, 5, 11, 12]


def by_heads(lists):
    """Merge by comparing heads; the lower file wins ties."""
    at, out = [0] * len(lists), []
    while any(a < len(x) for a, x in zip(at, lists)):
        f = min((f for f in range(len(lists)) if at[f] < len(lists[f])), key=lambda f: (lists[f][at[f]], f))
        out.append(lists[f][at[f]])
        at[f] += 1
    return out


def test_unsorted_files_merge_as_heads_do(spark):
    rng = random.Random(3)
    for _ in range(5):
        lists = [[rng.randrange(50) for _ in range(rng.randrange(40))] for _ in range(4)]
        assert merged(feeds(spark, *lists)) == by_heads(lists) == merged(feeds(spark, *lists), chunk_rows=7)


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"), F.col("id").alias("y"))
    got = merge.global_rank(df, F.floor(F.col("x") / 10), ["x"]).collect()
    assert all(r["rank"] == r["x"] + 1 for r in got)
    got = merge.global_rank(df, F.floor(F.col("x") / 10), ["x"], F.col("x") % 3 == 0).collect()
    assert all(r["rank"] == r["x"] // 3 + 1 for r in got)
    assert merge.global_rank(df.limit(0), F.col("x"), ["y"]).count() == 0
    assert merge.global_rank(df, F.col("x"), ["y"]).columns == ["x", "y", "rank"]


@pytest.mark.parametrize("value", ["case when id = 77 then 0 else 1775001621480470598 + id end", "cast(7 as long)", "cast(null as long)"])
def test_ranks_spread_whatever_the_values(spark, value):
    """One early event, or one time for all, leaves the rows dealt evenly among partitions."""
    df = spark.range(200_000, numPartitions=4).select(F.expr(value).alias("t"), F.col("id").alias("row"))
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = merge.global_rank(df, F.col("t"), ["row"])
        want = df.toPandas().sort_values(["t", "row"], na_position="first")["row"].tolist()
        assert [r["row"] for r in got.orderBy("rank").collect()] == want
        assert [r["rank"] for r in got.select("rank").orderBy("rank").collect()] == list(range(1, 200_001))
        sizes = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in got.inputFiles()}).groupBy(F.col("_metadata.file_path")).count().collect()
        assert len(sizes) == 4 and max(r["count"] for r in sizes) < 80_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)


EVENT = "ord long, order_key long, instrument_id long, action string, side int, price long, size long"


def events(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], EVENT)


def routed(df, **kw):
    return [r["book"] for r in routing.resolve_instrument(df, **kw).orderBy("ord").collect()]


def test_resolution(spark):
    df = events(spark, [(42, 10, "A", 1, 5, 1), (42, 0, "C", 0, None, 0), (7, 20, "A", 1, 5, 1), (7, 0, "M", 1, 6, 1), (42, 0, "M", 1, 7, 1)])
    assert routed(df) == [10, 10, 20, 20, 10]
    lv = book.levels(routing.resolve_instrument(df), ["book"], order_id="order_key")
    assert sorted(map(tuple, lv.collect())) == [(10, 1, 7, 1), (20, 1, 6, 1)]


def test_unresolved(spark):
    df = events(spark, [(999, 0, "C", 0, None, 0), (1, 3, "A", 1, 5, 1)])
    with pytest.raises(PySparkException, match="cannot resolve"):
        routed(df)
    assert routed(df, on_unresolved="drop") == [3]
    assert [r["order_key"] for r in routing.unresolved(df).collect()] == [999]
    with pytest.raises(ValueError):
        routed(df, on_unresolved="else")


def test_events_without_order(spark):
    df = events(spark, [(1, 10, "A", 1, 5, 1), (0, 10, "R", 0, None, 0)])
    assert routed(df) == [10, 0]
    assert routed(df, routing="by_instrument") == [10, 10]
    keep = book.levels(routing.resolve_instrument(df), ["book"], order_id="order_key")
    assert keep.count() == 1
    assert book.levels(routing.resolve_instrument(df, routing="by_instrument"), ["book"], order_id="order_key").count() == 0


def test_shards(spark):
    df = events(spark, [(1, 10, "A", 1, 5, 1), (0, 3, "A", 1, 5, 1), (0, 2, "A", 1, 5, 1)])
    rows = routing.resolve_instrument(df, shards=2).orderBy("ord").collect()
    assert [(r["shard"], r["book"]) for r in rows] == [(0, 10), (1, 0), (0, 0)]
    plain = sorted(map(tuple, book.levels(routing.resolve_instrument(df.where("order_key > 0")), ["book"], order_id="order_key").collect()))
    sharded = book.levels(routing.shard(routing.resolve_instrument(df.where("order_key > 0"), shards=2), 2), ["book"], order_id="order_key")
    assert sorted(map(tuple, sharded.collect())) == plain
