"""Media columns and interleaved documents.

HTML becomes one ordered sequence of text and media-reference structs; references name payloads by digest, and a join
on the digest resolves them, so a payload is stored and decoded once however many documents show it.
"""

from __future__ import annotations

import hashlib
import html
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import short_batches, small

SEQUENCE = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("kind", "text", "digest", "caption"))]))
WIDTH = 64
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[a-zA-Z/!?][^>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
_ATTR = re.compile(r"""([a-zA-Z\-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_BREAKS = {"p", "div", "figure", "figcaption", "li", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "tr", "blockquote", "pre", "br"}


def encode_png(payload: bytes) -> bytes:
    """payload (a multiple of 64 bytes) as an 8-bit grey PNG, 64 samples wide."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """The samples of a PNG that encode_png wrote, one row per line; a damaged file raises ValueError."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, size = 8, b"", None
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("a filtered row")
    return rows[:, 1:]


def features(samples: np.ndarray) -> str:
    """Size, mean and deviation of the samples, and a 64-bit average hash: column means of eight bands against their mean."""
    x = samples.astype(np.float64)
    cut = (np.arange(8) * len(x)) // 8
    bands = np.stack([x[a : max(b, a + 1)].mean(0).reshape(8, 8).mean(1) for a, b in zip(cut, [*cut[1:], len(x)], strict=True)])
    bits = "".join("1" if v > bands.mean() else "0" for v in bands.ravel())
    return f"grey8 {samples.shape[1]}x{samples.shape[0]} mean={x.mean():.4f} std={x.std():.4f} ahash={int(bits, 2):016x}"


def interleave_html(page: str | None) -> list[dict]:
    """The text and media items of a page in order: pos counts from 0, img, audio and video sources are references, a figcaption or else alt text is the caption."""
    items: list[dict] = []
    text: list[str] = []
    open_figure, caption = None, None

    def flush() -> None:
        said = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if said:
            items.append({"kind": "text", "text": said, "digest": None, "caption": None})

    for m in _TOKEN.finditer(page or ""):
        tok = m[0]
        if tok[0] != "<" or tok == "<":
            (text if caption is None else caption).append(tok)
            continue
        if m[1] or tok.startswith("<!"):
            continue
        name = re.match(r"</?\s*([a-zA-Z0-9]*)", tok)[1].lower()
        if name in _BREAKS and caption is None:
            flush()
        if name == "figure":
            open_figure = len(items) if tok[1] != "/" else None
        elif name == "figcaption":
            if tok[1] != "/":
                caption = []
            elif caption is not None:
                said = " ".join(html.unescape("".join(caption)).split())
                for it in items[open_figure if open_figure is not None else max(0, len(items) - 1) :]:
                    if it["kind"] == "media":
                        it["caption"] = said
                caption = None
        elif name in ("img", "audio", "video", "source"):
            attr = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(tok)}
            if attr.get("src"):
                flush()
                items.append({"kind": "media", "text": None, "digest": attr["src"].removeprefix("media:"), "caption": attr.get("alt")})
    if caption:
        text += caption
    flush()
    return [{"pos": i, **it} for i, it in enumerate(items)]


def interleave(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with a column items (SEQUENCE); a null or empty page has no items."""
    out = T.StructType([*pages.schema.fields, T.StructField("items", SEQUENCE)])
    at = pages.columns.index(html_col)

    def run(batches):
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        for b in small(batches):
            found = [interleave_html(h) for h in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, "items"])

    return pages.mapInArrow(run, out)


def resolve(sequences: DataFrame, described: DataFrame) -> DataFrame:
    """Explode items of sequences and join each media reference to its row of described (one per digest).

    Positions and captions stay on the item; a reference without a payload keeps nulls. A payload that many pages show has many small
    references and one row here: adaptive execution splits the former and repeats the latter.
    """
    refs = sequences.select("*", F.explode_outer("items").alias("item")).drop("items")
    return refs.withColumn("digest", F.col("item.digest")).join(described, "digest", "left")


def describe(media: DataFrame) -> DataFrame:
    """Read stored media (digest, n_bytes, media) back and describe each payload."""

    def run(batches):
        for b in small(batches):
            out = {k: [] for k in ("digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for digest, n, stored in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                samples = decode_png(stored)
                payload = samples.tobytes()
                for k, v in zip(out, (digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(samples)), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64() if k in ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes") else pa.string()) for k in out]))

    kind = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(run, kind)


def store_texts(docs: DataFrame) -> DataFrame:
    """(digest, n_bytes, media): every distinct whole text as a PNG of its UTF-8 bytes, padded with 0 to a positive multiple of 64."""

    def run(batches):
        for b in small(batches):
            out = {"digest": [], "n_bytes": [], "media": []}
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = t.encode("utf-8")
                out["digest"].append(d)
                out["n_bytes"].append(len(raw))
                out["media"].append(encode_png(raw + bytes(-len(raw) % WIDTH if raw else WIDTH)))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("digest", pa.string()), ("n_bytes", pa.int64()), ("media", pa.binary())]))

    text = F.coalesce(F.col("text"), F.lit(""))
    stored = short_batches(docs).select(F.sha2(text, 256).alias("digest"), text.alias("text_")).mapInArrow(run, "digest string, n_bytes long, media binary")
    return stored.groupBy("digest").agg(F.first("n_bytes").alias("n_bytes"), F.first("media").alias("media"))


def document_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, html): a page for every document of docs (doc_id, text, source) that shows its text as a medium between a heading and a closing line."""
    shown = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("?")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    page = F.concat(
        F.lit("<h1>Document "), shown("doc_id"), F.lit('</h1><figure><img src="media:'), digest, F.lit('" alt="text"><figcaption>text of document '), shown("doc_id"),
        F.lit("</figcaption></figure><p>From "), shown("source"), F.lit("</p>"),
    )
    return docs.select("doc_id", page.alias("html"))


def text_media(docs: DataFrame) -> DataFrame:
    """Every document's text as a media payload, resolved through an interleaved page that shows it: the described payload with its place and caption on the page,
    and the number of the page's items.

    docs needs doc_id, text and source. A null text is empty; an empty text is one row of 64 zero samples; equal texts share one
    stored payload and get equal values, but for the caption, which names the document; repeated rows stay; an empty table gives no rows. The stored
    form is a pure function of the text, so a task that runs again writes the same bytes.
    """
    shown = interleave(document_pages(docs)).select("doc_id", F.size("items").alias("n_items"), F.filter("items", lambda i: i["kind"] == "media").alias("items"))
    out = resolve(shown, describe(store_texts(docs)))
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.col("item.pos").alias("pos"), F.col("item.caption").alias("caption"), "n_items"
    )
