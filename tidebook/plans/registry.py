"""Registered queries over the driver's tables, and the same in DuckDB's SQL.

Fixed values: the layout of the line that event_print checks, and the codes and constants that appear in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, codes
from ..operators import book, merge, routing, snapshots, views
from ..operators.staging import scratch
from ..sources import derived
from ..sources import events as ev

GROUPS = 5
SNAPSHOT_EVERY = 1000
SHARDS = 4
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str, **types: str):
    """Register a query with its SQL; types: columns whose type the SQL gets by a cast."""
    if types:
        casts = ", ".join(f"CAST(\"{c}\" AS {t}) AS \"{c}\"" for c, t in types.items())
        sql = f"SELECT * REPLACE ({casts}) FROM ({sql}) typed"

    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return keep


_MBO = """mbo AS (
  SELECT event_id AS ord, epoch_us(ts) * 1000 AS ts_recv, user_id * 4 + k % 4 + 1 AS order_id, user_id % 8 + 1 AS instrument_id,
    CASE event_type WHEN 'signup' THEN 'A' WHEN 'click' THEN 'M' WHEN 'purchase' THEN 'C' WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'T' ELSE 'F' END
      WHEN 'error' THEN CASE WHEN k = 0 THEN 'R' ELSE 'N' END END AS action,
    CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE CASE WHEN k % 12 = 2 THEN 0 ELSE 1 END END AS side,
    CASE WHEN k <> 1 THEN 100000000000 + (k // 5) * 250000000 END AS price,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN value < 30 THEN 0 ELSE CAST(floor(value) AS BIGINT) % 20 END ELSE CAST(floor(value) AS BIGINT) % 50 END AS size, user_id, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""

# The fold: epochs by Clear, order states, level changes, running sums reflected at zero. {src} has book b.
_FOLD = """
e1 AS (SELECT *, sum(CASE WHEN action = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY b ORDER BY ord) AS ep FROM {src}),
e2 AS (SELECT *, max(ep) OVER (PARTITION BY b) AS mep, coalesce(action IN ('A', 'M') AND side <> 0 AND price IS NOT NULL, false) AS valid FROM e1),
e3 AS (SELECT *, coalesce(last_value(CASE WHEN valid THEN 1 WHEN action = 'C' AND size = 0 THEN 0 END IGNORE NULLS) OVER o, 0) = 1 AS tracked
       FROM e2 WHERE action IN ('A', 'C', 'M') WINDOW o AS (PARTITION BY b, ep, order_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e4 AS (SELECT *, CASE WHEN (valid OR (action = 'M' AND tracked)) AND side <> 0 THEN side END AS ws, CASE WHEN valid OR (action = 'M' AND tracked) THEN price END AS wp,
         CASE WHEN valid OR (action <> 'A' AND tracked) THEN size END AS wz FROM e3),
e5 AS (SELECT *, last_value(ws IGNORE NULLS) OVER o AS ps, last_value(wp IGNORE NULLS) OVER o AS pp, last_value(wz IGNORE NULLS) OVER o AS pz
       FROM e4 WINDOW o AS (PARTITION BY b, ep, order_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ops AS (SELECT b, ep, mep, ord, 0 AS sub, ps AS s, pp AS p, CASE WHEN action = 'C' THEN size - pz ELSE -pz END AS delta FROM e5 WHERE tracked AND ((action = 'C' AND pz > size) OR action = 'M')
  UNION ALL SELECT b, ep, mep, ord, 1, CASE WHEN action = 'M' AND tracked THEN coalesce(ws, ps) ELSE side END, CASE WHEN action = 'M' AND tracked THEN coalesce(wp, pp) ELSE price END, size
  FROM e5 WHERE valid OR (action = 'M' AND tracked)),
r1 AS (SELECT *, sum(delta) OVER l AS cs FROM ops WINDOW l AS (PARTITION BY b, ep, s, p ORDER BY ord, sub)),
r2 AS (SELECT *, cs - least(0, min(cs) OVER (PARTITION BY b, ep, s, p ORDER BY ord, sub)) AS q FROM r1)"""
_LEVELS = "lv AS (SELECT b AS instrument_id, s AS side, p AS price, CAST(arg_max(q, ord * 2 + sub) AS BIGINT) AS qty FROM r2 WHERE ep = mep GROUP BY b, s, p HAVING arg_max(q > 0 OR sub = 1, ord * 2 + sub))"


def _levels_sql(rest: str) -> str:
    return f"WITH {_MBO}, src AS (SELECT *, instrument_id AS b FROM mbo), {_FOLD.format(src='src')}, {_LEVELS} {rest}"


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.levels(derived.mbo_events(spark, sf_dir))


# --- books and their views -------------------------------------------------------------------------------------------


@query(_levels_sql("SELECT * FROM lv"), side='TINYINT')
def book_levels(spark, sf_dir):
    return _levels(spark, sf_dir)


@query(_levels_sql(", e6 AS (SELECT *, coalesce(CASE WHEN valid THEN 1 WHEN action = 'C' AND size = 0 THEN 0 END, CAST(tracked AS INT)) AS t, coalesce(ws, ps) AS s, coalesce(wp, pp) AS p, coalesce(wz, pz) AS z FROM e5 WHERE ep = mep) SELECT b AS instrument_id, order_id, arg_max(s, ord) AS side, arg_max(p, ord) AS price, arg_max(z, ord) AS size FROM e6 GROUP BY b, order_id HAVING arg_max(t, ord) = 1"), side='TINYINT')
def live_orders(spark, sf_dir):
    return book.live_orders(derived.mbo_events(spark, sf_dir))


@query(_levels_sql("SELECT instrument_id, 1 AS side, max(price) AS price FROM lv WHERE side = 1 GROUP BY 1 UNION ALL SELECT instrument_id, -1, min(price) FROM lv WHERE side = -1 GROUP BY 1"))
def best_price(spark, sf_dir):
    lv = _levels(spark, sf_dir)
    one = lambda s: views.best_price(lv, s).select("instrument_id", F.lit(s).alias("side"), "price")
    return one(1).union(one(-1))


@query(_levels_sql(", pts AS (SELECT DISTINCT instrument_id, CAST(s AS INT) AS side, CAST(100000000000 + (k // 5) * 250000000 AS BIGINT) AS price FROM mbo, (VALUES (1), (-1), (0)) v(s)) SELECT pts.*, coalesce(qty, 0) AS qty FROM pts LEFT JOIN lv USING (instrument_id, side, price)"))
def volume_at(spark, sf_dir):
    e = derived.mbo_events(spark, sf_dir)
    price = F.lit(100_000_000_000) + F.floor(F.col("k") / 5).cast("long") * 250_000_000
    points = e.select("instrument_id", F.explode(F.array(F.lit(1), F.lit(-1), F.lit(0))).alias("side"), price.alias("price")).distinct()
    return views.volume_at(_levels(spark, sf_dir), points).select("instrument_id", "side", "price", "qty")


@query(_levels_sql(", bs AS (SELECT DISTINCT instrument_id FROM mbo) SELECT instrument_id, CAST(count(*) FILTER (side = 1) = 0 AS INT) AS bid_empty, CAST(count(*) FILTER (side = -1) = 0 AS INT) AS ask_empty, CAST(count(side) = 0 AS INT) AS both_empty FROM bs LEFT JOIN lv USING (instrument_id) GROUP BY 1"))
def book_empty(spark, sf_dir):
    books = derived.mbo_events(spark, sf_dir).select("instrument_id").distinct()
    out = views.is_empty(_levels(spark, sf_dir), books)
    return out.select("instrument_id", *[F.col(c).cast("int").alias(c) for c in ("bid_empty", "ask_empty", "both_empty")])


@query(_levels_sql("SELECT *, row_number() OVER (PARTITION BY instrument_id, side ORDER BY -side * price) AS level_rank FROM lv"), side='TINYINT', level_rank='INTEGER')
def depth(spark, sf_dir):
    return views.depth(_levels(spark, sf_dir))


_GROUPED = "g1 AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY -side * price) AS rk, count(*) OVER (PARTITION BY {k}) AS n FROM {src}), g2 AS (SELECT *, (rk - 1) // ((n + 4) // 5) AS bucket FROM g1) SELECT {k}, bucket, arg_min(price, rk) AS first_price, arg_max(price, rk) AS last_price, CAST(sum(qty) AS BIGINT) AS qty FROM g2 GROUP BY {k}, bucket"


@query(_levels_sql(", " + _GROUPED.format(k="instrument_id, side", src="lv")), side='TINYINT', bucket='INTEGER')
def depth_grouped(spark, sf_dir):
    return views.grouped_depth(_levels(spark, sf_dir), GROUPS)


_BBO = "SELECT instrument_id, max(price) FILTER (side = 1) AS bid_price, arg_max(qty, price) FILTER (side = 1) AS bid_qty, min(price) FILTER (side = -1) AS ask_price, arg_min(qty, price) FILTER (side = -1) AS ask_qty FROM lv GROUP BY 1"


@query(_levels_sql(_BBO))
def bbo_final(spark, sf_dir):
    return views.bbo(_levels(spark, sf_dir))


@query(_levels_sql(f"SELECT *, instrument_id % {SHARDS} AS shard FROM ({_BBO})"), shard='INTEGER')
def bbo_sharded(spark, sf_dir):
    e = routing.resolve_instrument(derived.mbo_events(spark, sf_dir), shards=SHARDS, key="order_id")
    lv = book.levels(e.select("ord", "order_id", "action", "side", "price", "size", "book", "shard"), ["shard", "book"])
    out = views.bbo(lv, ["shard", "book"]).withColumnRenamed("book", "instrument_id")
    return out.select("instrument_id", "bid_price", "bid_qty", "ask_price", "ask_qty", "shard").orderBy("shard", "instrument_id")


@query(_levels_sql(f""", rk AS (SELECT ord, row_number() OVER (ORDER BY ord) AS rank FROM mbo WHERE ts_recv > 0),
cuts AS (SELECT ord AS cut_ord, rank AS cut FROM rk WHERE rank % {SNAPSHOT_EVERY} = 0),
eps AS (SELECT cut, cut_ord, b, max(ep) AS cep FROM cuts JOIN e1 ON e1.ord <= cut_ord GROUP BY ALL),
st AS (SELECT cut, r2.b AS instrument_id, s AS side, p AS price, arg_max(q, ord * 2 + sub) AS qty FROM eps JOIN r2 ON r2.b = eps.b AND r2.ep = eps.cep AND r2.ord <= cut_ord GROUP BY ALL HAVING arg_max(q > 0 OR sub = 1, ord * 2 + sub)), """
                   + _GROUPED.format(k="cut, instrument_id, side", src="st")), side='TINYINT', bucket='INTEGER')
def snapshot_every_n(spark, sf_dir):
    return snapshots.snapshots(derived.mbo_events(spark, sf_dir), SNAPSHOT_EVERY, GROUPS)


# --- routing -----------------------------------------------------------------------------------------------------------


def _zeroed(spark, sf_dir):
    """Events of which some name no instrument, and some no order."""
    e = derived.mbo_events(spark, sf_dir)
    hidden = (F.col("action") == "C") & (F.col("k") % 7 == 0)
    e = e.withColumn("instrument_id", F.when(hidden, 0).otherwise(F.col("instrument_id")))
    return e.withColumn("order_id", F.when(F.col("k") == 99, 0).otherwise(F.col("order_id")))


_ROUTED = f"""WITH {_MBO}, z AS (SELECT ord, CASE WHEN action = 'C' AND k % 7 = 0 THEN 0 ELSE instrument_id END AS instrument_id, CASE WHEN k = 99 THEN 0 ELSE order_id END AS order_id, action FROM mbo),
r AS (SELECT *, CASE WHEN order_id = 0 THEN 0 ELSE last_value(nullif(instrument_id, 0) IGNORE NULLS) OVER (PARTITION BY order_id ORDER BY ord) END AS book FROM z) """


@query(_ROUTED + "SELECT ord, order_id, book FROM r WHERE book IS NOT NULL")
def route(spark, sf_dir):
    return routing.resolve_instrument(_zeroed(spark, sf_dir), on_unresolved="drop", key="order_id").select("ord", "order_id", "book")


@query(_ROUTED + f"SELECT ord, order_id, book, coalesce(nullif(instrument_id, 0), book) % {SHARDS} AS shard FROM r WHERE book IS NOT NULL", shard='INTEGER')
def route_sharded(spark, sf_dir):
    e = routing.resolve_instrument(_zeroed(spark, sf_dir), on_unresolved="drop", shards=SHARDS, key="order_id")
    return routing.shard(e.select("ord", "order_id", "book", "shard"), SHARDS)


@query(_ROUTED + "SELECT ord, order_id, action FROM r WHERE book IS NULL")
def unresolved(spark, sf_dir):
    return routing.unresolved(_zeroed(spark, sf_dir), key="order_id").select("ord", "order_id", "action")


# --- merge ---------------------------------------------------------------------------------------------------------------


def _merged(feeds: DataFrame) -> DataFrame:
    m = merge.merge_order(feeds).withColumn("max_ts", F.col("ord.t"))
    return merge.global_rank(m, F.col("max_ts"), ["file_idx", "row_block", "row_idx"]).select("file_idx", "row_idx", "ts_recv", "max_ts", "rank")


_FEEDS = f"""WITH {_MBO}, f AS (SELECT CAST(user_id % 4 AS INT) AS file_idx, ord AS row_idx, ts_recv FROM mbo
UNION ALL SELECT 4, o_orderkey, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) * 1000000000 FROM orders
UNION ALL SELECT 5, l_orderkey, CAST(epoch(CAST(max(l_shipdate) AS TIMESTAMP)) AS BIGINT) * 1000000000 FROM lineitem GROUP BY l_orderkey),
m AS (SELECT *, max(ts_recv) OVER (PARTITION BY file_idx ORDER BY row_idx) AS max_ts FROM f {{where}})
SELECT *, row_number() OVER (ORDER BY max_ts, file_idx, row_idx) AS rank FROM m"""


@query(_FEEDS.format(where=""))
def merge_feeds(spark, sf_dir):
    return _merged(derived.feeds(spark, sf_dir))


QUERIES["merge"], ORACLE["merge"] = QUERIES.pop("merge_feeds"), ORACLE.pop("merge_feeds")


@query(_FEEDS.format(where="WHERE file_idx = 5"))
def merge_single(spark, sf_dir):
    return _merged(derived.feeds(spark, sf_dir).where("file_idx = 5"))


# --- scans and codecs ----------------------------------------------------------------------------------------------------

_CANON_COLS = "ts_recv, ts_recv - 1000 AS ts_event, CAST(order_id AS VARCHAR) AS order_id, price, instrument_id, user_id % 3 + 1 AS publisher_id, ord AS sequence, size, 1000 AS ts_in_delta, k % 7 AS channel_id, side, 160 AS rtype, (k * 4) % 256 AS flags, action"


def _text_ids(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) if c == "order_id" else F.col(c) for c in ev.EVENT_COLUMNS if c != "order_key"])


def _json_files(spark, sf_dir) -> str:
    """A folder of JSON event files; the events table is one row group, so its rows are dealt out first."""
    out = scratch(spark, "json")
    ev.write_json(derived.canonical(derived.mbo_events(spark, sf_dir).repartition(2 * SHARDS, "ord")), out)
    return out


@query(f"WITH {_MBO} SELECT {_CANON_COLS} FROM mbo", channel_id='INTEGER', side='TINYINT', rtype='SMALLINT', flags='SMALLINT')
def scan_json(spark, sf_dir):
    return _text_ids(ev.read_events(spark, _json_files(spark, sf_dir), "json"))


@query(f"WITH {_MBO} SELECT {_CANON_COLS} FROM mbo", channel_id='INTEGER', side='TINYINT', rtype='SMALLINT', flags='SMALLINT')
def convert(spark, sf_dir):
    out = scratch(spark, "converted")
    ev.convert(ev.read_events(spark, _json_files(spark, sf_dir), "json"), out)
    return _text_ids(ev.read_events(spark, out, "parquet"))


@query(f"WITH {_MBO} SELECT count(*) FILTER (ts_recv > 0) AS n_events FROM mbo")
def event_count(spark, sf_dir):
    return derived.mbo_events(spark, sf_dir).where("ts_recv > 0").agg(F.count("*").alias("n_events"))


@query(f"WITH {_MBO} SELECT ord, 'ts_recv=' || ts_recv || ' ts_event=' || (ts_recv - 1000) || ' order_id=' || order_id || ' side=' || side || ' price=' || coalesce(price, {codes.UNDEFINED_PRICE}) || ' size=' || size || ' action=' || ascii(action) AS line FROM mbo")
def event_print(spark, sf_dir):
    from .render import event_line

    e = derived.mbo_events(spark, sf_dir).withColumn("ts_event", F.col("ts_recv") - 1000)
    return e.select("ord", event_line().alias("line"))


@query(f"WITH {_MBO}, t AS (SELECT ord, ts_recv + CASE ord % 3 WHEN 0 THEN 0 WHEN 1 THEN ord % 1000 * 1000000 ELSE ord % 1000000007 % 1000000000 END AS ns FROM (SELECT ord, ts_recv // 1000000000 * 1000000000 AS ts_recv FROM mbo)) SELECT ord, ns AS parsed_ns, CAST(NULL AS BIGINT) AS bad_month, CAST(NULL AS BIGINT) AS too_short, ns AS lenient_ns, CAST(epoch(make_timestamp(year(u) + 1, 1, day(u), hour(u), minute(u), second(u))) AS BIGINT) * 1000000000 + ns % 1000000000 AS lenient_month FROM (SELECT *, make_timestamp(ns // 1000) AS u FROM t)")
def codec_ts(spark, sf_dir):
    e = derived.mbo_events(spark, sf_dir).select("ord", (F.floor(F.col("ts_recv") / codecs.NANO) * codecs.NANO).alias("s"))
    extra = F.when(F.col("ord") % 3 == 0, 0).when(F.col("ord") % 3 == 1, F.col("ord") % 1000 * 1_000_000).otherwise(F.col("ord") % 1_000_000_007 % 1_000_000_000)
    full = codecs.ns_to_iso(F.col("s") + extra)
    # No fraction, milliseconds, nanoseconds; with an offset, which is ignored.
    text = F.when(F.col("ord") % 3 == 0, F.concat(F.substring(full, 1, 19), F.lit("Z"))).when(F.col("ord") % 3 == 1, F.concat(F.substring(full, 1, 23), F.lit("+02:00"))).otherwise(full)
    e = e.withColumn("text", text)
    bad = F.concat(F.substring("text", 1, 5), F.lit("13"), F.substring("text", 8, 30))
    return e.select("ord", codecs.iso_to_ns(F.col("text")).alias("parsed_ns"), codecs.iso_to_ns(bad).alias("bad_month"), codecs.iso_to_ns(F.substring("text", 1, 16)).alias("too_short"), codecs.iso_to_ns(F.col("text"), True).alias("lenient_ns"), codecs.iso_to_ns(bad, True).alias("lenient_month"))


@query(f"WITH {_MBO}, t AS (SELECT ord, k - 50 AS whole, ord % 1000 AS milli, ord % 1000 / 1000.0::DOUBLE AS d FROM mbo), u AS (SELECT *, CAST((CASE WHEN whole < 0 THEN '-' ELSE '' END) || abs(whole) || '.' || lpad(CAST(milli AS VARCHAR), 3, '0') AS DOUBLE) AS x FROM t) SELECT ord, CASE WHEN whole < 0 THEN -1 ELSE 1 END * (abs(whole) * 1000000000 + milli * 1000000 + 123456) AS price_exact, CAST(trunc(x * 1e9::DOUBLE) AS BIGINT) AS price_truncated, CAST(CASE WHEN x * 1e9::DOUBLE < 0 THEN ceil(x * 1e9::DOUBLE - 0.5) ELSE floor(x * 1e9::DOUBLE + 0.5) END AS BIGINT) AS price_rounded, (CASE WHEN whole < 0 THEN -1 ELSE 1 END * (abs(whole) * 1000000000 + milli * 1000000 + 123456))::DOUBLE * 1e-9::DOUBLE AS price_double FROM u")
def codec_price(spark, sf_dir):
    e = derived.mbo_events(spark, sf_dir).select("ord", (F.col("k") - 50).alias("whole"), (F.col("ord") % 1000).alias("milli"))
    text = F.concat(F.when(F.col("whole") < 0, "-").otherwise(""), F.abs("whole").cast("string"), F.lit("."), F.lpad(F.col("milli").cast("string"), 3, "0"))
    return e.select("ord", codecs.price_exact(F.concat(text, F.lit("123456789"))).alias("price_exact"), codecs.price_truncated(text).alias("price_truncated"), codecs.price_rounded(text.cast("double")).alias("price_rounded"), codecs.price_as_double(codecs.price_exact(F.concat(text, F.lit("123456789")))).alias("price_double"))


_LETTERS = ["B", "S", "A", "N", "", None, "Buy", "b", "Ask", "Trade"]
_LETTERS_SQL = "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in _LETTERS) + "]"


def _letters(spark, sf_dir):
    return derived.mbo_events(spark, sf_dir).select("ord", F.array(*[F.lit(x) for x in _LETTERS])[(F.col("k") % len(_LETTERS)).cast("int")].alias("letter"))


@query(f"WITH {_MBO} SELECT ord, CASE substr(l, 1, 1) WHEN 'B' THEN 1 WHEN 'S' THEN -1 WHEN 'A' THEN -1 ELSE 0 END AS side FROM (SELECT ord, ({_LETTERS_SQL})[k % {len(_LETTERS)} + 1] AS l FROM mbo)", side='TINYINT')
def codec_side(spark, sf_dir):
    return _letters(spark, sf_dir).select("ord", codecs.side_code(F.col("letter")).alias("side"))


@query(f"WITH {_MBO} SELECT ord, coalesce(nullif(substr(l, 1, 1), ''), 'N') AS action FROM (SELECT ord, ({_LETTERS_SQL})[k % {len(_LETTERS)} + 1] AS l FROM mbo)")
def codec_action(spark, sf_dir):
    return _letters(spark, sf_dir).select("ord", codecs.action_code(F.col("letter")).alias("action"))


@query(f"WITH {_MBO} SELECT instrument_id, count(price) AS defined, count(*) - count(price) AS undefined FROM mbo GROUP BY 1")
def price_defined(spark, sf_dir):
    e = derived.mbo_events(spark, sf_dir)
    return e.groupBy("instrument_id").agg(F.count_if(F.col("price").isNotNull()).alias("defined"), F.count_if(F.col("price").isNull()).alias("undefined"))


_FLAG_SQL = ", ".join(f"CAST(flags & {b} <> 0 AS INT) AS {n.lower()}" for b, n in codes.FLAGS)


@query(f"WITH {_MBO}, f AS (SELECT ord, (k * 37) % 256 AS flags, (k * 11) % 256 AS other FROM mbo) SELECT ord, {_FLAG_SQL}, flags | other AS either, flags & other AS both, 255 - flags AS inverse FROM f", either='INTEGER', both='INTEGER', inverse='INTEGER')
def flags_decode(spark, sf_dir):
    f = derived.mbo_events(spark, sf_dir).select("ord", (F.col("k") * 37 % 256).cast("int").alias("flags"), (F.col("k") * 11 % 256).cast("int").alias("other"))
    bits = [codecs.has_flag(F.col("flags"), b).cast("int").alias(n.lower()) for b, n in codes.FLAGS]
    return f.select("ord", *bits, codecs.flags_or(F.col("flags"), F.col("other")).alias("either"), codecs.flags_and(F.col("flags"), F.col("other")).alias("both"), codecs.flags_not(F.col("flags")).alias("inverse"))


_RTYPE_SQL = ", ".join(f"({c}, '{n}')" for c, n in codes.RTYPE)


@query(f"WITH {_MBO}, t(code, name) AS (VALUES {_RTYPE_SQL}), r AS (SELECT k * 5 % 256 AS code, count(*) AS n FROM mbo GROUP BY 1) SELECT r.code, t.name, r.n FROM r LEFT JOIN t USING (code)", code='INTEGER')
def rtype_lookup(spark, sf_dir):
    r = derived.mbo_events(spark, sf_dir).groupBy((F.col("k") * 5 % 256).cast("int").alias("code")).agg(F.count("*").alias("n"))
    return r.join(F.broadcast(codes.table(spark, "rtype")), "code", "left").select("code", "name", "n")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k_text, 'number' AS k_kind, CAST(NULL AS VARCHAR) AS missing, CAST(NULL AS VARCHAR) AS missing_kind FROM events")
def json_extract(spark, sf_dir):
    e = derived.table(spark, sf_dir, "events").select("event_id", "props")
    p = F.col("props")
    return e.select("event_id", codecs.json_text(p, "$.k").alias("k_text"), codecs.json_kind(p, "$.k").alias("k_kind"), codecs.json_text(p, "$.none").alias("missing"), codecs.json_kind(p, "$.none").alias("missing_kind"))


@query(f"WITH {_MBO} SELECT ord, CASE WHEN k % 5 = 0 THEN 0 ELSE size END AS size, CASE WHEN k % 7 = 0 THEN 0 ELSE order_id END AS order_id, CASE WHEN k % 3 <> 0 THEN price END AS price, CASE WHEN k % 11 = 0 THEN 'N' ELSE action END AS action, 0 AS flags FROM mbo", flags='SMALLINT')
def defaults(spark, sf_dir):
    raw = derived.mbo_events(spark, sf_dir)
    k = F.col("k")
    hide = lambda c, m: F.when(k % m != 0, F.col(c))
    flat = raw.select(
        "ord", "ts_recv", F.col("ts_recv").alias("ts_event"), F.lit(None).cast("long").alias("rtype"), F.lit(None).cast("long").alias("publisher_id"), "instrument_id", hide("action", 11).alias("action"), F.lit("B").alias("side"),
        (hide("price", 3) / 1e9).alias("price"), hide("size", 5).alias("size"), F.lit(None).cast("long").alias("channel_id"), hide("order_id", 7).cast("double").alias("order_id"), F.lit(None).cast("long").alias("flags"),
        F.lit(None).cast("long").alias("ts_in_delta"), F.col("ord").alias("sequence"),
    )
    out = ev.from_flat(flat)
    return out.select(F.col("sequence").alias("ord"), "size", F.col("order_id").cast("long").alias("order_id"), "price", "action", "flags")


@query(f"WITH {_MBO} SELECT CASE k % 5 WHEN 0 THEN 'not an object' WHEN 1 THEN 'ts_recv missing' WHEN 2 THEN 'ts_recv unusable' ELSE 'ts_event unusable' END AS reason, count(*) AS n FROM mbo WHERE k % 5 <> 4 GROUP BY 1")
def malformed(spark, sf_dir):
    e = derived.mbo_events(spark, sf_dir)
    damage = e.select(F.col("ord").alias("row_idx"), (F.col("k") % 5).alias("m"))
    lines = ev.to_json_lines(derived.canonical(e)).join(damage, "row_idx")
    v, m = F.col("value"), F.col("m")
    broken = (
        F.when(m == 0, F.lit("not json at all")).when(m == 1, F.regexp_replace(v, '"ts_recv":"[^"]*",', "")).when(m == 2, F.regexp_replace(v, '("ts_recv":"....)-..', "$1-13"))
        .when(m == 3, F.regexp_replace(v, '("ts_event":"....)-..', "$1-13")).otherwise(v)
    )
    return ev.malformed(ev.decode_lines(lines.select(broken.alias("value"), "row_idx"))).groupBy("reason").agg(F.count("*").alias("n"))
