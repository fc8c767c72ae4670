"""The canonical event schema, and scans of event files into it.

*.mbo.json: one JSON object a line. *.mbo.json.feather: Arrow IPC with flat columns. *.parquet: canonical events.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs

EVENT_DDL = (
    "ts_recv long, ts_event long, order_id decimal(20,0), order_key long, price long, instrument_id long, publisher_id long, sequence long, "
    "size long, ts_in_delta int, channel_id int, side tinyint, rtype smallint, flags smallint, action string"
)
EVENT_COLUMNS = [c.split()[0] for c in EVENT_DDL.split(", ")]
#: Place of a record among all files: file number, start of the split, row within it.
ORDINAL = ["file_idx", "row_block", "row_idx"]
#: Columns of a flat Arrow file.
FLAT_COLUMNS = "ts_recv ts_event rtype publisher_id instrument_id action side price size channel_id order_id flags ts_in_delta sequence".split()
SUFFIXES = {"json": ".mbo.json", "feather": ".mbo.json.feather", "parquet": ".parquet"}

_JSON = (
    "ts_recv string, hd struct<ts_event:string,rtype:string,publisher_id:string,instrument_id:string>, action string, side string, price string, "
    "size string, channel_id string, order_id string, flags string, ts_in_delta string, sequence string"
)
_QUOTED = {"price": True, "order_id": True, "size": False, "flags": False, "channel_id": False, "ts_in_delta": False, "sequence": False}


def discover(spark: SparkSession, path: str, fmt: str) -> list[str]:
    """The files of a format at path, sorted: path itself, or those directly inside it; a file of another suffix raises ValueError.

    Any file system that Spark knows will do. An empty folder raises; a path that does not exist gives no files.
    """
    suffix = SUFFIXES[fmt]
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    if fs.getFileStatus(p).isFile():
        if not path.endswith(suffix):
            raise ValueError(f"unsupported format: {path} does not end in {suffix}")
        return [path]
    found = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isFile() and s.getPath().getName().endswith(suffix))
    if not found:
        raise ValueError(f"no *{suffix} files in {path}")
    return found


def _format_of(path: str) -> str:
    for fmt in ("feather", "json", "parquet"):
        if path.endswith(SUFFIXES[fmt]):
            return fmt
    raise ValueError(f"unsupported format: {path}")


#: Files whose numbers may be sent to every task.
FEW_FILES = 50_000


def _uri(spark: SparkSession, path: str) -> str:
    """A path as Spark names it in a row's metadata: with its scheme, and escaped."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()
    return re.sub("^file:/+", "file:/", uri)


def _literal(path: str) -> str:
    """A path that Spark takes as it stands, not as a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _numbered(df: DataFrame, files: list[str], name: str = "file_path") -> DataFrame:
    """file_idx from the file's place among the sorted files; a row of a file that isn't among them raises when it is read."""
    spark = df.sparkSession
    index = spark.createDataFrame([(_uri(spark, f), i) for i, f in enumerate(files)], "file_uri_ string, file_idx int")
    index = F.broadcast(index) if len(files) <= FEW_FILES else index
    joined = df.join(index, F.regexp_replace(name, "^file:/+", "file:/") == F.col("file_uri_"), "left")
    lost = F.raise_error(F.concat(F.lit("a row of an unknown file: "), F.col(name))).cast("int")
    return joined.withColumn("file_idx", F.coalesce("file_idx", lost)).drop("file_uri_", name)


def decode_lines(lines: DataFrame, price_mode: str = "exact", strict_types: bool = False, lenient_times: bool = False) -> DataFrame:
    """Lines (value string, and any ordinals) to events with a reason column, null for good ones.

    A record is refused if it isn't a JSON object, or if ts_recv is missing, zero or malformed, or ts_event is malformed. Any other mistyped
    field only falls back to its default. strict_types also treats a price or order_id that isn't quoted, or another number that is, as missing. lenient_times: see
    codecs.iso_to_ns.
    """
    # Unnested from an array of one, a record is parsed once; as a plain column it would be parsed again for every field.
    once = F.struct(F.col("value").alias("line_"), F.from_json(F.trim("value"), _JSON, {"mode": "PERMISSIVE"}).alias("r_"))
    raw = lines.where(F.length(F.trim("value")) > 0).select(*[c for c in lines.columns if c != "value"], F.inline(F.array(once)))
    text = F.trim(F.col("line_"))
    field = {n: F.col(f"r_.{n}") for n in ("action", "side", "ts_recv", *_QUOTED)} | {n: F.col(f"r_.hd.{n}") for n in ("ts_event", "rtype", "publisher_id", "instrument_id")}
    if strict_types:
        for n, quoted in _QUOTED.items():
            field[n] = F.when(codecs.json_kind(text, f"$.{n}") == ("string" if quoted else "number"), field[n])
    price = (codecs.price_exact if price_mode == "exact" else codecs.price_truncated)(field["price"])
    number = codecs.unsigned_number
    # Unnested too: the refusal and the key look at these again, and generated code in smaller pieces is compiled by the JVM.
    first = F.struct(
        codecs.iso_to_ns(field["ts_recv"], lenient_times).alias("ts_recv"), codecs.iso_to_ns(field["ts_event"], lenient_times).alias("event_"), number(field["order_id"], 64).alias("order_id"), price.alias("price")
    )
    raw = raw.select("*", F.inline(F.array(first)))
    is_object = F.coalesce(codecs.json_kind(text, "$") == "object", F.lit(False)) if strict_types else F.col("r_").isNotNull() & text.startswith("{")
    reason = (
        F.when(~is_object, "not an object").when(field["ts_recv"].isNull(), "ts_recv missing").when(F.col("ts_recv").isNull() | (F.col("ts_recv") == 0), "ts_recv unusable")
        .when(field["ts_event"].isNotNull() & F.col("event_").isNull(), "ts_event unusable")
    )
    out = raw.select(
        *[c for c in lines.columns if c != "value"], "line_", "ts_recv", F.coalesce("event_", F.lit(0)).alias("ts_event"),
        "order_id", "price", number(field["instrument_id"], 32).alias("instrument_id"),
        number(field["publisher_id"], 32).alias("publisher_id"), number(field["sequence"], 32).alias("sequence"), number(field["size"], 32).alias("size"),
        codecs.signed_number(field["ts_in_delta"]).cast("int").alias("ts_in_delta"), number(field["channel_id"], 16).cast("int").alias("channel_id"),
        codecs.side_code(field["side"]).alias("side"), number(field["rtype"], 8).cast("smallint").alias("rtype"), number(field["flags"], 8).cast("smallint").alias("flags"),
        codecs.action_code(field["action"]).alias("action"), reason.alias("reason"),
    )
    return out.withColumn("order_key", codecs.order_key(F.col("order_id")))


def good(decoded: DataFrame) -> DataFrame:
    kept = [c for c in ORDINAL if c in decoded.columns]
    return decoded.where("reason is null").select(*EVENT_COLUMNS, *kept)


def malformed(decoded: DataFrame) -> DataFrame:
    """The refused records with their reason and text."""
    kept = [c for c in ORDINAL if c in decoded.columns]
    return decoded.where("reason is not null").select(*kept, "reason", F.col("line_").alias("line"))


#: An object whose objects hold objects at most; braces inside strings don't count. Nothing that is matched is given back.
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_INNER = rf"\{{(?:[^{{}}\"]++|{_STRING})*+\}}"
_MIDDLE = rf"\{{(?:[^{{}}\"]++|{_STRING}|{_INNER})*+\}}"
_OBJECT = rf"\{{(?:[^{{}}\"]++|{_STRING}|{_MIDDLE})*+\}}"


def read_json_lines(spark: SparkSession, files: list[str], framing: str = "lines") -> DataFrame:
    """value and ordinals of every record of files: one a line, or with framing='concatenated' any number of objects on a line."""
    # A file's split lies in one partition, so the row's part of the id is enough beside the split's start.
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    df = spark.read.text([_literal(f) for f in files]).select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("row_block"), row.alias("row_idx"))
    if framing == "concatenated":
        # What lies between objects is a record too, which the decoder refuses.
        records = F.regexp_extract_all("value", F.lit(rf"({_OBJECT}|[^{{\s][^{{]*|\{{)"))
        df = df.select("file_path", "row_block", "row_idx", F.posexplode(records).alias("at_", "value"))
        df = df.withColumn("row_idx", F.shiftleft("row_idx", 20) + F.col("at_")).drop("at_")
    elif framing != "lines":
        raise ValueError(f"unknown framing {framing}")
    return _numbered(df, files)


def from_flat(df: DataFrame) -> DataFrame:
    """Flat columns of an Arrow file, order_id a double, to events. A null ts_recv becomes 0 and the row is kept; a missing column raises ValueError."""
    lacking = [c for c in FLAT_COLUMNS if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    zero = lambda c, kind="long": F.coalesce(F.col(c).cast("long"), F.lit(0)).cast(kind)
    wide = lambda c, bits, kind="long": F.pmod(zero(c), F.lit(1 << bits)).cast(kind)
    order = codecs.double_to_order_id(F.col("order_id")) if dict(df.dtypes)["order_id"] == "double" else F.coalesce(F.col("order_id").cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    out = df.select(
        zero("ts_recv").alias("ts_recv"), zero("ts_event").alias("ts_event"), order.alias("order_id"), codecs.price_rounded(F.col("price")).alias("price"),
        wide("instrument_id", 32).alias("instrument_id"), wide("publisher_id", 32).alias("publisher_id"), wide("sequence", 32).alias("sequence"), wide("size", 32).alias("size"),
        zero("ts_in_delta", "int").alias("ts_in_delta"), wide("channel_id", 16, "int").alias("channel_id"), codecs.side_code(F.col("side")).alias("side"),
        wide("rtype", 8, "smallint").alias("rtype"), wide("flags", 8, "smallint").alias("flags"), codecs.action_code(F.col("action")).alias("action"),
        *[c for c in ORDINAL if c in df.columns],
    )
    return out.withColumn("order_key", codecs.order_key(F.col("order_id"))).select(*EVENT_COLUMNS, *[c for c in ORDINAL if c in df.columns])


def read_events(
    spark: SparkSession, path: str, fmt: str | None = None, strict_types: bool = False, price_mode: str = "exact", framing: str = "lines", lenient_times: bool = False
) -> DataFrame:
    """All events at path, with their ordinals. Without fmt the suffix of path decides; the other settings are for JSON."""
    fmt = fmt or _format_of(path)
    files = discover(spark, path, fmt)
    if not files:
        return spark.createDataFrame([], EVENT_DDL + ", file_idx int, row_block long, row_idx long")
    if fmt == "json":
        return good(decode_lines(read_json_lines(spark, files, framing), price_mode, strict_types, lenient_times))
    if fmt == "feather":
        from .feather import register

        register(spark)
        return from_flat(spark.read.format("arrow_ipc").option("files", "\n".join(files)).option("columns", "\n".join(FLAT_COLUMNS)).load())
    df = spark.read.parquet(*[_literal(f) for f in files]).select(*EVENT_COLUMNS, F.col("_metadata.file_path").alias("file_path"), F.lit(0).cast("long").alias("row_block"), F.col("_metadata.row_index").alias("row_idx"))
    return _numbered(df, files)


def compact(events: DataFrame) -> DataFrame:
    """The six fields that a book needs least of."""
    return events.select("ts_event", "order_id", "instrument_id", "price", "side", "action")


def to_json_lines(events: DataFrame) -> DataFrame:
    """Events as lines (value) of the JSON form, plus any ordinals."""
    price = F.when(F.col("price").isNotNull(), F.concat(F.when(F.col("price") < 0, "-").otherwise(""), F.floor(F.abs("price") / codecs.NANO).cast("string"), F.lit("."), F.lpad(F.pmod(F.abs("price"), F.lit(codecs.NANO)).cast("string"), 9, "0")))
    side = F.when(F.col("side") == 1, "B").when(F.col("side") == -1, "A").otherwise("N")
    head = F.struct(codecs.ns_to_iso(F.col("ts_event")).alias("ts_event"), "rtype", "publisher_id", "instrument_id")
    doc = F.struct(codecs.ns_to_iso(F.col("ts_recv")).alias("ts_recv"), head.alias("hd"), "action", side.alias("side"), price.alias("price"), "size", "channel_id", F.col("order_id").cast("string").alias("order_id"), "flags", "ts_in_delta", "sequence")
    return events.select(F.to_json(doc).alias("value"), *[c for c in ORDINAL if c in events.columns])


def convert(events: DataFrame, out: str) -> None:
    """Write events as Parquet, which later scans read by column."""
    events.write.mode("overwrite").parquet(out)


def write_json(events: DataFrame, out: str) -> None:
    """Write events as *.mbo.json files in a new folder, one a partition."""
    spark = events.sparkSession
    to_json_lines(events).select("value").write.text(out)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.listStatus(p):
        if s.getPath().getName().startswith("part-"):
            fs.rename(s.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, s.getPath().getName().removesuffix(".txt") + SUFFIXES["json"]))
