"""Decoding of event fields as column expressions; all run inside Spark's generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codes

NANO = 1_000_000_000


def iso_to_ns(text: Column, lenient: bool = False) -> Column:
    """Nanoseconds since 1970 of 'YYYY-MM-DDThh:mm:ss[.fraction]zone', read as UTC whatever the zone; null if it isn't one.

    Up to nine digits of the fraction count. Needs the session's time zone to be UTC. lenient: only the length is checked; the fields are read by their place, whatever stands
    between them, and one that is out of its range counts on into the next (month 13 is the January after).
    """
    dot = F.substring(text, 20, 1) == "."
    tail = F.substring(text, 21, 9)
    # The zone's letter is cut off without a pattern; what else follows the digits needs one.
    short = F.substring_index(tail, "Z", 1)
    digits = F.when(F.translate(short, "0123456789", "") == "", short).otherwise(F.regexp_extract(tail, "^[0-9]*", 0))
    fraction = F.when(dot, F.rpad(digits, 9, "0").cast("long")).otherwise(0)
    if lenient:
        part = lambda at, n: F.substring(text, at, n).try_cast("long")
        month = part(1, 4) * 12 + part(6, 2) - 1
        first = F.make_date(F.floor(month / 12).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"), F.lit(1))
        days = F.unix_date(first) + part(9, 2) - 1
        seconds = ((days * 24 + part(12, 2)) * 60 + part(15, 2)) * 60 + part(18, 2)
        return F.when(F.length(text) >= 19, seconds * NANO + fraction)
    # The plain cast is several times faster than a pattern; what is left without digits shows that all fields are there.
    head = F.substring(text, 1, 19)
    whole = F.when((F.length(text) >= 19) & (F.translate(head, "0123456789", "") == "--T::"), head.try_cast("timestamp"))
    return F.unix_micros(whole) * 1000 + fraction


def ns_to_iso(ns: Column) -> Column:
    """The inverse of iso_to_ns, with nine digits."""
    seconds = F.floor(ns / NANO).cast("long")
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(F.pmod(ns, F.lit(NANO)).cast("string"), 9, "0"), F.lit("Z"))


_PRICE = r"^\s*(-?)([0-9]*)(?:\.([0-9]*))?"


def price_exact(text: Column) -> Column:
    """Decimal text to units of 1e-9; further decimals are cut off. Null for null or text without digits."""
    minus = text.startswith("-")
    body = F.when(minus, F.substring(text, 2, 1 << 30)).otherwise(text)
    whole = F.substring_index(body, ".", 1)
    # Digits around one dot at most are taken apart without a pattern; anything else goes to the pattern.
    rest = F.translate(body, "0123456789", "")
    plain = rest.isin("", ".") & (F.length(body) > F.length(rest))
    digits = F.concat(whole, F.rpad(F.substring(body, F.length(whole) + 2, F.lit(9)), 9, "0")).try_cast("long")
    return F.when(plain, F.when(minus, -digits).otherwise(digits)).otherwise(_price_by_pattern(text))


def _price_by_pattern(text: Column) -> Column:
    whole, part = F.regexp_extract(text, _PRICE, 2), F.regexp_extract(text, _PRICE, 3)
    digits = F.when(F.length(whole) + F.length(part) > 0, F.concat(whole, F.rpad(F.substring(part, 1, 9), 9, "0")))
    return F.when(F.regexp_extract(text, _PRICE, 1) == "-", -digits.try_cast("long")).otherwise(digits.try_cast("long"))


def price_truncated(text: Column) -> Column:
    """Decimal text through a double to units of 1e-9, cut off; some prices come out one unit low."""
    return (text.try_cast("double") * 1e9).try_cast("long")


def price_rounded(value: Column) -> Column:
    """A double to units of 1e-9, halves away from zero; null for null and NaN."""
    scaled = value * 1e9
    return F.when(~F.isnan(value), F.when(scaled < 0, F.ceil(scaled - 0.5)).otherwise(F.floor(scaled + 0.5)).cast("long"))


def price_as_double(price: Column) -> Column:
    return price * 1e-9


def price_or_sentinel(price: Column) -> Column:
    """The price, or the largest long where it is undefined."""
    return F.coalesce(price, F.lit(codes.UNDEFINED_PRICE))


def side_code(text: Column) -> Column:
    """1 for B, -1 for S or A, by the first character; else 0."""
    c = F.substring(text, 1, 1)
    return F.when(c == "B", 1).when(c.isin("S", "A"), -1).otherwise(0).cast("tinyint")


def action_code(text: Column) -> Column:
    """The first character; N if there is none."""
    return F.coalesce(F.nullif(F.substring(text, 1, 1), F.lit("")), F.lit("N"))


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def flag_names(flags: Column) -> Column:
    """Names of the set bits, highest first."""
    return F.filter(F.array(*[F.when(has_flag(flags, b), F.lit(n)) for b, n in codes.FLAGS]), lambda x: x.isNotNull())


def flags_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b).bitwiseAND(255)


def flags_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b).bitwiseAND(255)


def flags_not(a: Column) -> Column:
    return F.lit(255) - a.bitwiseAND(255)


def _wide(n: int) -> Column:
    """A whole number beyond a long, as a literal."""
    return F.lit(str(n)).cast("decimal(38,0)")


def unsigned(value: Column, bits: int) -> Column:
    """value modulo 2^bits, as an unsigned field of that width holds it; for up to 63 bits a long."""
    return F.pmod(value, F.lit(1 << bits)) if bits < 63 else F.pmod(value.cast("decimal(38,0)"), _wide(1 << bits))


def unsigned_number(text: Column, bits: int) -> Column:
    """Text of a whole number to an unsigned field: 0 if missing, negative or not a number, wrapped if too large."""
    kind = "decimal(20,0)" if bits > 62 else "long"
    plain = text.try_cast("long")
    plain = F.when(plain >= 0, plain if bits > 62 else F.pmod(plain, F.lit(1 << bits)))
    # Only numbers beyond a long need decimals, and only they get here.
    wide = F.when(text.rlike(r"^[0-9]{19,38}$"), F.pmod(text.try_cast("decimal(38,0)"), _wide(1 << bits)))
    return F.coalesce(plain.cast(kind), wide.cast(kind), F.lit(0).cast(kind))


def signed_number(text: Column, default: int = 0) -> Column:
    return F.coalesce(text.try_cast("long"), F.lit(default).cast("long"))


def order_key(order_id: Column) -> Column:
    """decimal(20,0) of 0 to 2^64-1 as the long of the same 64 bits."""
    wide = order_id.cast("decimal(21,0)")
    return F.when(wide >= _wide(1 << 63), wide - _wide(1 << 64)).otherwise(wide).cast("long")


def double_to_order_id(x: Column) -> Column:
    """A double that held an unsigned 64-bit number, exactly, as decimal(20,0); 0 for null, NaN and negatives."""
    half = 9223372036854775808.0
    low = F.when(x < half, x.try_cast("long").cast("decimal(20,0)"))
    high = (x - half).try_cast("long").cast("decimal(20,0)") + _wide(1 << 63).cast("decimal(20,0)")
    return F.coalesce(F.when(F.isnan(x) | (x < 0), None).otherwise(F.coalesce(low, high.cast("decimal(20,0)"))), F.lit(0).cast("decimal(20,0)"))


def json_text(doc: Column, path: str) -> Column:
    """A field of a JSON text as text, null if absent or null."""
    return F.get_json_object(doc, path)


def json_kind(doc: Column, path: str) -> Column:
    """'string', 'number', 'object', 'array', 'boolean' or null: the JSON type of a field."""
    # Of a text that isn't JSON there is no field.
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(doc), path, "variant"))
    return (
        F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array")
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), "number")
    )


def known_codes(code: Column, table: str) -> Column:
    """The name of a code, null for unknown ones."""
    pairs = codes.TABLES[table]
    return reduce(lambda when, p: when.when(code == p[0], p[1]), pairs[1:], F.when(code == pairs[0][0], pairs[0][1]))


def market_security_key(market: Column, security: Column) -> Column:
    """A hash of a security on a market, equal for equal pairs; nulls count as 0, the code for none."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    return F.xxhash64(zero(market), zero(security))
