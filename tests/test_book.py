import random

import pytest
from fold import Book
from pyspark.sql import functions as F

from tidebook.operators import book, merge, snapshots, views

SCHEMA = "ord long, instrument_id long, order_id long, action string, side int, price long, size long, ts_recv long"
P = 5_000_000_000_000


def frame(spark, events, instrument=1):
    rows = [(i + 1, e[0] if isinstance(e[0], int) else instrument, *(e[1:] if isinstance(e[0], int) else e), i + 1) for i, e in enumerate(events)]
    rows = [(o, b, k, a, s, p, z, t) for o, b, a, k, s, p, z, t in rows]
    return spark.createDataFrame(rows, SCHEMA)


def levels(spark, events):
    return {(r["side"], r["price"]): r["qty"] for r in book.levels(frame(spark, events)).collect()}


A = lambda i, s, p, z: ("A", i, s, p, z)
M = lambda i, s, p, z: ("M", i, s, p, z)
C = lambda i, z: ("C", i, 0, None, z)

CASES = [
    ([], {}),
    ([A(1, 1, P, 10)], {(1, P): 10}),
    ([A(1, 1, P, 10), A(2, 1, P, 5)], {(1, P): 15}),
    ([A(1, 1, P, 10), C(1, 0)], {}),
    ([A(1, 1, P, 10), C(1, 4)], {(1, P): 4}),
    ([A(1, 1, P, 10), M(1, 1, P - 10, 10)], {(1, P - 10): 10}),
    ([A(1, 1, P, 10), M(1, 1, P, 3)], {(1, P): 3}),
    ([A(1, -1, P, 5), ("T", 1, 0, None, 5), ("F", 1, 0, None, 0), ("X", 1, 0, None, 0), ("N", 1, 0, None, 0)], {(-1, P): 5}),
    ([A(1, 1, P, 10), A(2, -1, P + 1, 5), ("R", 0, 0, None, 0)], {}),
    ([A(1, 1, P, 10), ("R", 0, 0, None, 0), C(1, 0), A(2, 1, P, 1)], {(1, P): 1}),
    # More remains than there was: the level stays, the order grows, and its removal takes the neighbour's volume too.
    ([A(1, 1, P, 10), A(2, 1, P, 5), C(1, 20), C(1, 0)], {}),
    ([A(1, 1, P, 0)], {(1, P): 0}),
    ([A(1, 1, P, 10), A(1, 1, P + 1, 5), C(1, 0)], {(1, P): 10}),
    ([M(7, 1, P, 2)], {(1, P): 2}),
    ([M(7, 0, P, 2), M(8, 1, None, 2)], {}),
    ([A(1, 1, P, 10), M(1, 0, None, 3)], {(1, P): 3}),
]


@pytest.mark.parametrize("events,want", CASES)
def test_cases(spark, events, want):
    assert levels(spark, events) == want


def random_events(rng, n):
    out = []
    for _ in range(n):
        a = rng.choices("ACMRTFN", (8, 6, 5, 0.3, 1, 1, 1))[0]
        price = rng.choice([None, P, P + 1, P + 2])
        out.append((rng.randrange(1, 9), a, rng.randrange(1, 6), rng.choice([0, 1, -1, 1, -1]), price, rng.choice([0, 1, 3, 5, 8])))
    return out


def test_random_books_equal_a_fold(spark):
    events = random_events(random.Random(5), 6000)
    books = {}
    for b, a, o, s, p, z in events:
        books.setdefault(b, Book()).apply(a, o, s, p, z)
    df = frame(spark, events)
    got = {(r["instrument_id"], r["side"], r["price"]): r["qty"] for r in book.levels(df).collect()}
    assert got == {(b, *k): q for b, x in books.items() for k, q in x.levels.items()}
    live = {(r["instrument_id"], r["order_id"]): (r["side"], r["price"], r["size"]) for r in book.live_orders(df).collect()}
    assert live == {(b, o): v for b, x in books.items() for o, v in x.orders.items()}
    # Adding up live orders is not the same thing.
    naive = {}
    for (b, _), (s, p, z) in live.items():
        naive[b, s, p] = naive.get((b, s, p), 0) + z
    assert naive != got


def test_partitions_do_not_matter(spark):
    df = frame(spark, random_events(random.Random(6), 800))
    one = sorted(map(tuple, book.levels(df.repartition(1)).collect()))
    assert one == sorted(map(tuple, book.levels(df.repartition(7)).collect()))


@pytest.mark.parametrize("uncounted", [False, True])
def test_snapshots_equal_a_fold(spark, uncounted):
    events = random_events(random.Random(9), 900)
    df = frame(spark, events)
    if uncounted:
        df = df.selectExpr("ord", "instrument_id", "order_id", "action", "side", "price", "size", "case when ord % 10 = 3 then 0 else ts_recv end ts_recv")
    want, books, n = set(), {}, 0
    for i, (b, a, o, s, p, z) in enumerate(events, 1):
        books.setdefault(b, Book()).apply(a, o, s, p, z)
        if not (uncounted and i % 10 == 3):
            n += 1
            if n % 50 == 0:
                for k, x in books.items():
                    for side in (1, -1):
                        own = sorted((-side * q, q, v) for (t, q), v in x.levels.items() if t == side)
                        w = -(-len(own) // 5)
                        for g in range(0, len(own), w or 1):
                            part = own[g : g + w]
                            want.add((n, k, side, g // w, part[0][1], part[-1][1], sum(v for *_, v in part)))
    assert {tuple(r) for r in snapshots.snapshots(df, 50).collect()} == want


def test_views(spark):
    lv = book.levels(frame(spark, [A(1, 1, P, 3), A(2, 1, P + 1, 7), A(3, 1, P - 1, 2), A(4, -1, P + 9, 4)]))
    assert [tuple(r) for r in views.bbo(lv).collect()] == [(1, P + 1, 7, P + 9, 4)]
    assert [r["price"] for r in views.best_price(lv, 1).collect()] == [P + 1]
    assert views.best_price(lv, 0).count() == 0
    ranks = {(r["side"], r["price"]): r["level_rank"] for r in views.depth(lv).collect()}
    assert ranks == {(1, P + 1): 1, (1, P): 2, (1, P - 1): 3, (-1, P + 9): 1}
    assert {r["price"] for r in views.side_levels(lv, 0).collect()} == {P + 9}
    with pytest.raises(ValueError):
        views.grouped_depth(lv, 0)


@pytest.mark.parametrize("n_levels,sizes", [(6, [2, 2, 2]), (7, [2, 2, 2, 1]), (3, [1, 1, 1])])
def test_grouped_depth(spark, n_levels, sizes):
    lv = spark.createDataFrame([(1, 1, 100 + i, 1) for i in range(n_levels)], "instrument_id long, side int, price long, qty long")
    rows = views.grouped_depth(lv, 5).orderBy("bucket").collect()
    assert [r["qty"] for r in rows] == sizes
    assert rows[0]["first_price"] == 100 + n_levels - 1


def test_books_at_a_cut(spark):
    """Books after any event equal the books of the events up to it; the order may be the struct of a merge."""
    events = frame(spark, random_events(random.Random(21), 300))
    merged = merge.merge_order(events.drop("ts_recv").select("*", F.lit(0).alias("file_idx"), F.lit(0).cast("long").alias("row_block"), F.col("ord").alias("row_idx"), F.col("ord").alias("ts_recv")).drop("ord"))
    for at in (1, 57, 150, 300, 1000):
        want = sorted(map(tuple, book.levels(events.where(F.col("ord") <= at)).collect()))
        assert sorted(map(tuple, book.levels(events, at=at).collect())) == want
        place = F.struct(F.lit(at).cast("long").alias("t"), F.lit(0).alias("file_idx"), F.lit(0).cast("long").alias("row_block"), F.lit(at).cast("long").alias("row_idx"))
        assert sorted(map(tuple, book.levels(merged, at=place).collect())) == want
        assert sorted(map(tuple, book.live_orders(events, at=at).collect())) == sorted(map(tuple, book.live_orders(events.where(F.col("ord") <= at)).collect()))
