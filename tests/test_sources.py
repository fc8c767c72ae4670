from decimal import Decimal

import pyarrow as pa
import pyarrow.feather as pf
import pytest
from pyspark.sql import functions as F

from tidebook.functions import codecs, codes
from tidebook.sources import derived, feather
from tidebook.sources import events as ev

LINE = '{{"ts_recv":"{recv}","hd":{{"ts_event":"2026-04-01T00:00:21.480454469Z","rtype":160,"publisher_id":101,"instrument_id":436}},"action":"{action}","side":"{side}","price":{price},"size":{size},"channel_id":23,"order_id":"{order}","flags":128,"ts_in_delta":1041,"sequence":120067,"symbol":"X"}}'


def line(recv="2026-04-01T00:00:21.480470598Z", action="A", side="A", price='"1.161100000"', size="20", order="1775001621480460739"):
    return LINE.format(recv=recv, action=action, side=side, price=price, size=size, order=order)


def write(tmp_path, *lines, name="a.mbo.json"):
    p = tmp_path / name
    p.write_text("".join(x + "\n" for x in lines))
    return str(p)


def test_three_records(spark, tmp_path):
    path = write(tmp_path, line(), line(recv="2026-04-01T00:00:21.480541935Z", action="C", order="1775001620423626831"), line(recv="2026-04-01T00:02:03.720604803Z", action="C", side="B", order="10998373657385341895"))
    rows = ev.read_events(spark, path).orderBy("row_idx").collect()
    assert [r["ts_recv"] for r in rows] == [1775001621480470598 - 0, 1775001621480541935, 1775001723720604803]
    assert [r["action"] for r in rows] == ["A", "C", "C"]
    assert [r["side"] for r in rows] == [-1, -1, 1]
    assert (rows[0]["price"], rows[0]["flags"], rows[0]["rtype"], rows[0]["sequence"], rows[0]["publisher_id"]) == (1161100000, 128, 160, 120067, 101)
    assert rows[2]["order_id"] == Decimal("10998373657385341895")
    assert rows[2]["order_key"] == 10998373657385341895 - (1 << 64)


def test_bad_lines_are_set_aside(spark, tmp_path):
    path = write(tmp_path, "not json at all", "", line(), line(recv="2026-13-01T00:00:21Z"), line(recv="2026"), line().replace('"ts_recv"', '"other"'), line(recv="1970-01-01T00:00:00Z"))
    decoded = ev.decode_lines(ev.read_json_lines(spark, [path]))
    assert ev.good(decoded).count() == 1
    assert sorted(r["reason"] for r in ev.malformed(decoded).collect()) == ["not an object", "ts_recv missing", "ts_recv unusable", "ts_recv unusable", "ts_recv unusable"]


def test_objects_on_one_line(spark, tmp_path):
    path = write(tmp_path, line(order="1") + line(order="2") + " " + line(order="3"), line(order="4"))
    got = ev.read_events(spark, path, framing="concatenated").orderBy("row_block", "row_idx").collect()
    assert [int(r["order_id"]) for r in got] == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        ev.read_events(spark, path, framing="other")


def test_braces_inside_strings(spark, tmp_path):
    path = write(tmp_path, "".join(line(order=str(i)).replace('"X"', '"}{ \\\\\\" } {"') for i in (1, 2)) + " rubbish " + line(order="3") + "{")
    lines = ev.read_json_lines(spark, [path], "concatenated")
    assert [int(r["order_id"]) for r in ev.good(ev.decode_lines(lines)).orderBy("row_idx").collect()] == [1, 2, 3]
    assert [r["line"].strip() for r in ev.malformed(ev.decode_lines(lines)).orderBy("row_idx").collect()] == ["rubbish", "{"]


@pytest.mark.parametrize("names", [["b c", "a"], ["x[1]", "x1", "p*", "q?", "{r,s}", "ü%20 #"]])
def test_names_of_files(spark, tmp_path, names):
    """Every event of every file is there, whatever the file's name."""
    for n in names:
        write(tmp_path, line(order=str(names.index(n) + 1)), line(order=str(names.index(n) + 1)), name=f"{n}.mbo.json")
    got = [(r["file_idx"], int(r["order_id"])) for r in ev.read_events(spark, str(tmp_path), "json").collect()]
    assert sorted(got) == sorted((i, names.index(n) + 1) for i, n in enumerate(sorted(names, key=lambda n: n + ".mbo.json")) for _ in range(2))
    one = tmp_path / f"{names[0]}.mbo.json"
    assert ev.read_events(spark, str(one)).count() == 2


def test_json_round_trip(spark, sf, tmp_path):
    want = derived.canonical(derived.mbo_events(spark, sf)).select(*ev.EVENT_COLUMNS)
    ev.write_json(want.repartition(3), str(tmp_path / "out"))
    got = ev.read_events(spark, str(tmp_path / "out"), "json")
    assert got.select(*ev.EVENT_COLUMNS).exceptAll(want).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("text,want", [("2026-13-01T00:00:21Z", "2027-01-01T00:00:21Z"), ("2026/04/01 00:00:21.5Z", "2026-04-01T00:00:21.5Z"), ("2026-00-31T23:59:61", "2026-01-01T00:00:01Z"), ("2026-04-01T00:00:21.480470598Z", "2026-04-01T00:00:21.480470598Z"), ("2026-04-01", None), ("20x6-04-01T00:00:21Z", None)])
def test_lenient_times(spark, tmp_path, text, want):
    got = spark.range(1).select(codecs.iso_to_ns(F.lit(text), True).alias("a"), codecs.iso_to_ns(F.lit(want)).alias("b")).first()
    assert got["a"] == got["b"] and (got["a"] is None) == (want is None)
    path = write(tmp_path, line(recv=text))
    assert ev.read_events(spark, path, lenient_times=True).count() == (want is not None)


def test_prices_equal_the_pattern(spark):
    texts = ["", "-", ".", "1", "-1", "1.", ".5", "-.5", "00.10", "1.2.3", "1-2", "--5", "+5", " 7", "7 ", "1e5", "1.123456789999", "9223372036.854775807", "9223372036.854775808", "99999999999999999999", "-0.000000001", "abc", "1.2x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", codecs.price_exact(F.col("t")).alias("a"), codecs._price_by_pattern(F.col("t")).alias("b"))
    assert all(r["a"] == r["b"] for r in df.collect())


def test_empty_file(spark, tmp_path):
    assert ev.read_events(spark, write(tmp_path)).count() == 0


@pytest.mark.parametrize("price,want", [('"-0.250000000"', -250000000), ('"-5.000000000"', -5000000000), ("null", None), ('"1.123456789999"', 1123456789), ('"1.001"', 1001000000), ('"abc"', None), ("1.5", 1500000000)])
def test_prices(spark, tmp_path, price, want):
    assert ev.read_events(spark, write(tmp_path, line(price=price))).first()["price"] == want


def test_strict_types(spark, tmp_path):
    path = write(tmp_path, line(price="1.5", size='"7"'))
    assert ev.read_events(spark, path).first()["size"] == 7
    r = ev.read_events(spark, path, strict_types=True).first()
    assert (r["price"], r["size"]) == (None, 0)


def test_sides_and_sizes(spark, tmp_path):
    path = write(tmp_path, *[line(side=s, size=str(z)) for s, z in (("B", 20), ("S", 30), ("A", 25), ("N", 10), ("B", -3))])
    assert [(r["side"], r["size"]) for r in ev.read_events(spark, path).orderBy("row_idx").collect()] == [(1, 20), (-1, 30), (-1, 25), (0, 10), (1, 0)]


@pytest.mark.parametrize("name", ["a.json", "a.csv", "a.txt"])
def test_suffix(spark, tmp_path, name):
    path = write(tmp_path, line(), name=name)
    with pytest.raises(ValueError, match="unsupported format"):
        ev.read_events(spark, path)
    with pytest.raises(ValueError, match="unsupported format"):
        ev.read_events(spark, path, fmt="feather")


def test_folder_is_sorted_and_flat(spark, tmp_path):
    for n in ("b", "a", "c"):
        write(tmp_path, line(order=str(ord(n))), name=f"{n}.mbo.json")
    (tmp_path / "deep").mkdir()
    write(tmp_path / "deep", line(), name="d.mbo.json")
    got = {r["file_idx"]: int(r["order_id"]) for r in ev.read_events(spark, str(tmp_path), "json").collect()}
    assert got == {0: 97, 1: 98, 2: 99}
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        ev.read_events(spark, str(tmp_path / "none"), "json")
    assert ev.read_events(spark, str(tmp_path / "missing"), "json").count() == 0


FLAT = {"ts_recv": [5, None, 7], "ts_event": [1, 2, 3], "rtype": [160] * 3, "publisher_id": [1] * 3, "instrument_id": [9, 0, None], "action": ["A", "", None], "side": ["B", "A", None],
        "price": [1.0000000005, None, float("nan")], "size": [1, None, 3], "channel_id": [1] * 3, "order_id": [10998373657385341895.0, 12.0, None], "flags": [128] * 3, "ts_in_delta": [-4, None, 0], "sequence": [1, 2, 3]}


def test_feather(spark, tmp_path):
    t = pa.table(FLAT).cast(pa.schema([pa.field(f.name, pa.large_string() if f.name in ("action", "side") else f.type) for f in pa.table(FLAT).schema]))
    path = str(tmp_path / "a.mbo.json.feather")
    pf.write_feather(t, path, compression="lz4")
    rows = ev.read_events(spark, path).orderBy("row_idx").collect()
    assert [r["ts_recv"] for r in rows] == [5, 0, 7]
    assert [r["price"] for r in rows] == [1000000001, None, None]
    assert [r["action"] for r in rows] == ["A", "N", "N"]
    assert [int(r["order_id"]) for r in rows] == [10998373657385340928, 12, 0]
    assert rows[0]["ts_in_delta"] == -4 and rows[2]["instrument_id"] == 0
    pf.write_feather(t.drop_columns(["size"]), path)
    with pytest.raises(ValueError, match="missing columns: size"):
        ev.read_events(spark, path)


def test_feather_batches(spark, tmp_path, monkeypatch):
    """Record batches are partitions of their own; columns that no event has aren't read."""
    n = 1000
    t = pa.table({k: (v * n)[:n] if k != "sequence" else list(range(n)) for k, v in FLAT.items()} | {"symbol": ["X" * 100] * n})
    path = str(tmp_path / "b c.mbo.json.feather")
    pf.write_feather(t, path, chunksize=100, compression="uncompressed")
    monkeypatch.setattr(feather, "PARTITION_BYTES", 1)
    parts = feather.ArrowReader([path, path], ev.FLAT_COLUMNS).partitions()
    assert [p.value[2:] for p in parts[:10]] == [(k, k + 1) for k in range(10)] and len(parts) == 20
    one = list(feather.ArrowReader([path], ["sequence"]).read(parts[3]))
    assert one[0].schema.names == ["sequence", "file_idx", "row_block", "row_idx"] and one[0].column(0).to_pylist() == list(range(300, 400))
    got = ev.read_events(spark, path).orderBy("row_block", "row_idx").collect()
    assert [r["sequence"] for r in got] == list(range(n))


def test_write_feather(spark, sf, tmp_path):
    e = ev.EVENT_COLUMNS
    flat = derived.canonical(derived.mbo_events(spark, sf)).select(*[F.col(c).cast("double") if c in ("order_id", "price") else F.col(c).cast("long") if c not in ("action", "side") else F.col(c) for c in e if c != "order_key"])
    flat = flat.withColumn("side", F.when(F.col("side") == 1, "B").when(F.col("side") == -1, "A").otherwise("N")).withColumn("price", F.col("price") / 1e9)
    assert feather.write_feather(flat.repartition(2), str(tmp_path)).agg(F.sum("rows")).first()[0] == flat.count()
    back = ev.read_events(spark, str(tmp_path), "feather")
    assert back.select("sequence", "price", "side", "order_key").exceptAll(derived.canonical(derived.mbo_events(spark, sf)).select("sequence", "price", "side", "order_key")).count() == 0


def test_parquet_round_trip(spark, sf, tmp_path):
    want = derived.canonical(derived.mbo_events(spark, sf)).select(*ev.EVENT_COLUMNS)
    ev.convert(want.coalesce(1), str(tmp_path / "out"))
    got = ev.read_events(spark, str(tmp_path / "out"), "parquet")
    assert got.select(*ev.EVENT_COLUMNS).exceptAll(want).count() == 0
    assert got.agg(F.countDistinct("file_idx", "row_idx")).first()[0] == want.count()


def test_split_files_keep_their_order(spark, tmp_path):
    path = write(tmp_path, *[line(order=str(i + 1)) for i in range(400)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = ev.read_events(spark, path)
        assert df.rdd.getNumPartitions() > 3
        assert [int(r["order_id"]) for r in df.orderBy("row_block", "row_idx").collect()] == list(range(1, 401))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_codes_and_helpers(spark):
    r = spark.range(1).select(
        codecs.known_codes(F.lit(160), "rtype").alias("a"), codecs.known_codes(F.lit(7), "rtype").alias("b"), codecs.flag_names(F.lit(130)).alias("c"),
        codecs.unsigned(F.lit(-1), 32).alias("d"), codecs.price_as_double(F.lit(1500000000)).alias("e"), codecs.price_or_sentinel(F.lit(None).cast("long")).alias("f"),
        codecs.price_truncated(F.lit("1.001")).alias("g"), codecs.unsigned_number(F.lit("18446744073709551617"), 64).alias("h"), codecs.json_kind(F.lit('{"a":"1"}'), "$.a").alias("i"),
    ).first()
    assert (r["a"], r["b"], r["c"], r["d"], r["f"], r["g"], int(r["h"]), r["i"]) == ("Mbo", None, ["Last", "PublisherSpec"], (1 << 32) - 1, codes.UNDEFINED_PRICE, 1000999999, 1, "string")
    assert r["e"] == pytest.approx(1.5)
    k = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (None, 0)], "m int, s int").select(codecs.market_security_key(F.col("m"), F.col("s")).alias("k"))
    assert [r["n"] for r in k.groupBy("k").agg(F.count("*").alias("n")).orderBy("n").collect()] == [1, 1, 2]
    assert {codes.table(spark, n).count() for n in ("side", "order_type")} == {3}
