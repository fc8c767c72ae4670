import random

from pyspark.sql import functions as F
from test_book import A, P, frame, random_events

from tidebook.operators import book, snapshots, views
from tidebook.plans import render
from tidebook.streaming.books import stream_books


def test_texts(spark):
    lv = book.levels(frame(spark, [A(1, 1, 5_000_000_000_000, 10), A(2, -1, 5_010_000_000_000, 5)], 10))
    rule = "// ----------------\n"
    assert render.render_depth(views.depth(lv), 10) == f"{rule}// BUY\n{rule}  5000000000000 : 10\n{rule}// SELL\n{rule}  5010000000000 : 5\n"
    assert render.render_grouped(views.grouped_depth(lv, 5)) == "// 10\n// BUY\n  [5000000000000, 5000000000000] : 10\n// SELL\n  [5010000000000, 5010000000000] : 5\n"
    one = views.bbo(lv.where("side = 1"))
    body = "Instrument 10:\n  Best Bid: 5000000000000 x 10\n  Best Ask: (empty)\n"
    head, foot = "\n// ====== Final Best Bid/Ask ======\n", "// ====== End Best Bid/Ask ======\n"
    assert render.render_bbo(one) == head + body + foot
    assert render.render_bbo(one, 2) == head + head + body + foot + head + foot + foot
    assert render.render_summary(10, 2.0) == "Total messages processed : 10\nWall-clock time          : 2.000 s\nThroughput               : 5 msg/s\n"
    assert render.render_summary(10, 0).endswith(": 0 msg/s\n")
    report = render.code_report(spark)
    assert report.columns == ["component", "version", "hash", "date", "branch", "message"] and [r["component"] for r in report.collect()] == ["tidebook", "python", "spark", "system"]


def test_sharded_texts(spark):
    events = [A(k, 1, P + k, k) for k in range(1, 6)]
    lv = book.levels(frame(spark, events[:2], 2).union(frame(spark, events[2:4], 3)).union(frame(spark, events[4:], 4)))
    one = lambda i, lo, hi, q: f"// {i}\n// BUY\n" + "".join(f"  [{p}, {p}] : {n}\n" for p, n in zip((hi, lo) if hi > lo else (hi,), q, strict=True)) + "// SELL\n  (empty)\n"
    texts = {2: one(2, P + 1, P + 2, (2, 1)), 3: one(3, P + 3, P + 4, (4, 3)), 4: one(4, P + 5, P + 5, (5,))}
    grouped = views.grouped_depth(lv, 5)
    assert render.render_grouped(grouped) == texts[2] + texts[3] + texts[4]
    assert render.render_grouped(grouped, 2) == texts[2] + texts[4] + texts[3]
    assert "".join(render.grouped_texts(grouped)) == render.render_grouped(grouped)
    head, foot = "\n// ====== Final Best Bid/Ask ======\n", "// ====== End Best Bid/Ask ======\n"
    best = lambda i, p, q: f"Instrument {i}:\n  Best Bid: {p} x {q}\n  Best Ask: (empty)\n"
    assert render.render_bbo(views.bbo(lv), 2) == head + head + best(2, P + 2, 2) + best(4, P + 5, 5) + foot + head + best(3, P + 4, 4) + foot + foot


def test_snapshot_text(spark):
    df = frame(spark, [A(1, 1, P, 1), A(2, 1, P, 2), A(3, -1, P + 1, 3), A(4, 1, P, 4)])
    got = list(render.render_snapshots(snapshots.snapshots(df, 2)))
    assert got == [
        f"\n=== Snapshot at 2 events ===\n// 1\n// BUY\n  [{P}, {P}] : 3\n// SELL\n  (empty)\n===============================\n\n",
        f"\n=== Snapshot at 4 events ===\n// 1\n// BUY\n  [{P}, {P}] : 7\n// SELL\n  [{P + 1}, {P + 1}] : 3\n===============================\n\n",
    ]


def test_stream_equals_batch(spark, tmp_path):
    df = frame(spark, random_events(random.Random(8), 600))
    for i in range(3):
        df.where(f"ord > {i * 200} and ord <= {(i + 1) * 200}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = []
    q = stream_books(stream).writeStream.foreachBatch(lambda b, i: rows.extend(b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    state = {}
    for r in rows:
        state[r["instrument_id"], r["side"], r["price"]] = r["qty"] if r["exists"] else None
    want = {(r["instrument_id"], r["side"], r["price"]): r["qty"] for r in book.levels(df).collect()}
    assert {k: v for k, v in state.items() if v is not None} == want


def event_files(folder, rng, files=4, rows=50):
    """Files of events whose times rise but for some late ones; sequence numbers say nothing of the order."""
    from test_sources import line

    folder.mkdir()
    known = []
    for f in range(files):
        lines = []
        for k in range(rows):
            if known and rng.random() < 0.4:
                order, instrument, action = rng.choice(known), 0, rng.choice("CM")
            else:
                order, instrument, action = f * rows + k + 1, rng.randrange(1, 4), "A"
                known.append(order)
            at = k * 4 + rng.randrange(8) - (30 if rng.random() < 0.1 else 0) + 60
            text = line(recv=f"2026-04-01T00:{at // 60:02}:{at % 60:02}.{rng.randrange(3)}Z", action=action, side=rng.choice("BS"), price=f'"{rng.randrange(1, 5)}.5"', size=str(rng.randrange(9)), order=str(order))
            lines.append(text.replace('"instrument_id":436', f'"instrument_id":{instrument}').replace('"sequence":120067', f'"sequence":{rng.randrange(10**6)}'))
        (folder / f"{f}.mbo.json").write_text("\n".join(lines) + "\n")


def merged_stream(spark, folder, tmp_path, delay, name):
    """Rows given by a streaming merge, batch after batch, and the table that they were written to."""
    from tidebook.streaming.sources import StreamMerge, stream_json

    given, out = [], str(tmp_path / f"{name}-out")

    def sink(batch, i):
        given.append(batch.orderBy("ord").collect())
        batch.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch-{i}")

    merge = StreamMerge(spark, str(tmp_path / f"{name}-state"), delay, sink)
    merge.start(stream_json(spark, str(folder), 1), str(tmp_path / f"{name}-cp"), availableNow=True).awaitTermination(240)
    merge.finish()
    return given, out


def test_streaming_merge_equals_the_batch_merge(spark, tmp_path):
    from tidebook.operators import merge
    from tidebook.sources import events as ev

    folder = tmp_path / "in"
    event_files(folder, random.Random(3))
    key = lambda r: (r["ts_recv"], r["order_key"], r["sequence"], r["action"])
    want = [key(r) for r in merge.merge_order(ev.read_events(spark, str(folder), "json")).orderBy("ord").collect()]
    given, _ = merged_stream(spark, folder, tmp_path, 10**12, "slow")
    assert [key(r) for b in given for r in b] == want and not any(r["late"] for b in given for r in b)
    # With little patience, what comes too late is given then, and marked; nothing is lost, and what isn't late is in order.
    given, _ = merged_stream(spark, folder, tmp_path, 20 * 10**9, "fast")
    rows = [r for b in given for r in b]
    assert sorted(key(r) for r in rows) == sorted(want) and sum(r["late"] for r in rows) > 20
    prompt = [r["ord"] for r in rows if not r["late"]]
    assert prompt == sorted(prompt)


def test_json_stream_is_routed_into_books(spark, tmp_path):
    from tidebook.operators import merge, routing
    from tidebook.sources import events as ev
    from tidebook.streaming.sources import stream_route

    folder = tmp_path / "in"
    event_files(folder, random.Random(12))
    _, out = merged_stream(spark, folder, tmp_path, 10**12, "m")
    stream = spark.readStream.schema(spark.read.parquet(f"{out}/*").schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/*")
    rows = []
    q = stream_books(stream_route(stream)).writeStream.foreachBatch(lambda b, i: rows.extend(b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    state = {}
    for r in rows:
        state[r["instrument_id"], r["side"], r["price"]] = r["qty"] if r["exists"] else None
    batch = merge.merge_order(ev.read_events(spark, str(folder), "json"))
    want = {(r["book"], r["side"], r["price"]): r["qty"] for r in book.levels(routing.resolve_instrument(batch, on_unresolved="keep").where("book is not null"), ["book"], order_id="order_key").collect()}
    assert want and {k: v for k, v in state.items() if v is not None} == want


def test_late_updates_are_marked_by_level(spark, tmp_path):
    events = [[A(1, 1, P, 5), A(2, 1, P + 1, 6), A(3, -1, P + 9, 7)], [A(4, 1, P + 3, 1), A(5, 1, P, 2)]]
    first = frame(spark, events[0]).withColumn("ord", F.col("ord") + 10)
    second = frame(spark, events[1]).withColumn("ord", F.when(F.col("order_id") == 4, 40).otherwise(F.col("ord")).cast("long"))
    for i, df in enumerate((first, second)):
        df.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in/*"))
    rows = []
    q = stream_books(stream, expire_ms=10**9).writeStream.foreachBatch(lambda b, i: rows.append(b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = [{(r["side"], r["price"]): (r["qty"], r["late"]) for r in b} for b in rows if b]
    assert got[0] == {(1, P): (5, False), (1, P + 1): (6, False), (-1, P + 9): (7, False)}
    assert got[1] == {(1, P): (7, True), (1, P + 3): (1, False)}


def test_command_line(spark, tmp_path, capsys):
    from test_sources import line

    from tidebook import __main__ as cli

    (tmp_path / "a.mbo.json").write_text("\n".join(line(order=str(i + 1), side="BS"[i % 2], price=f'"{i % 2 + 1}.0"') for i in range(6)) + "\n")
    texts = list(cli.report(spark, str(tmp_path), every=4))
    assert texts[0] == "\n=== Snapshot at 4 events ===\n// 436\n// BUY\n  [1000000000, 1000000000] : 40\n// SELL\n  [2000000000, 2000000000] : 40\n===============================\n\n"
    assert texts[1].startswith("Total messages processed : 6\n")
    assert texts[2] == "\n// ====== Final Best Bid/Ask ======\nInstrument 436:\n  Best Bid: 1000000000 x 60\n  Best Ask: 2000000000 x 60\n// ====== End Best Bid/Ask ======\n"
    assert cli.main([]) == 2
