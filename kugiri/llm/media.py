"""Interleaved document sequences: ordered text and media references, payloads resolved by digest.

A page becomes an array of items in document order. A text item has its text; a media item has the element, the address, the
digest and the caption (that of its figure, else its alternative text or title). The digest of a data: address is the SHA-256 of
the bytes that it holds, and its src is data:<mime>;digest=<digest>; that of any other address the SHA-256 of the address made
absolute by the page's. payloads() is the table of the bytes that pages hold in data: addresses, whole and once each, by digest.
Media items are joined by digest with the payloads: those given, and those of the pages; what is found is joined with the pages. An item keeps its position and its caption, whether or not its payload is found.

Addresses are read from src, data and, where these are missing or placeholders, from what lazy or responsive elements have
(data-src, srcset: the first of the set); a poster is an item ahead of its video; iframes and media within noscript are items too.

A null page has null items, one without text and media none. A reference that recurs is an item each time. A data: address
that can't be read keeps its address and has no payload. Of payloads with the same digest the one with the least (mime, size)
counts. Repeated rows have the same items each; columns other than page_id, url and html are ignored; an empty table gives no
rows. Pages are read to their end, whatever their length.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core
from .html import Block, Media, read

ITEM = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("tag", pa.string()), ("src", pa.string()), ("digest", pa.string()), ("caption", pa.string()), ("mime", pa.string()), ("size", pa.int64())])
SCHEMA = "page_id long, url string, page binary, items array<struct<pos int, kind string, text string, tag string, src string, digest string, caption string, mime string, size long>>"


def data_url(src: str) -> tuple[str, bytes] | None:
    """(mime, bytes) of a data: address, None if it can't be read."""
    head, comma, body = src[5:].partition(",")
    if not comma:
        return None
    raw = unquote_to_bytes(body)
    if head.lower().endswith(";base64"):
        try:
            raw = base64.b64decode(b"".join(raw.split()) + b"==", validate=False)
        except (binascii.Error, ValueError):
            return None
    return head.split(";")[0].strip().lower() or "text/plain", raw


def items(html: str, url: str | None, payloads: dict[str, tuple[str, bytes]] | None = None) -> list[dict]:
    """The items of a page; payloads: gets the bytes of its data: addresses by digest."""
    got = read(html, media=True)
    figure = lambda x: x.node.figure if x.node else 0
    captions: dict[int, list[str]] = {}
    held = {f for x in got if isinstance(x, Media) and (f := figure(x))}
    rest = []
    for x in got:
        if isinstance(x, Block) and x.node and x.node.caption and figure(x) in held:
            captions.setdefault(figure(x), []).append(x.text)
        else:
            rest.append(x)
    out = []
    for pos, x in enumerate(rest):
        if isinstance(x, Block):
            out.append({"pos": pos, "kind": "text", "text": x.text})
            continue
        mime = size = None
        src = x.src
        if src[:5].lower() == "data:":
            data = data_url(src)
            digest = hashlib.sha256(data[1] if data else src.encode("utf-8", "replace")).hexdigest()
            if data:
                mime, size, src = data[0], len(data[1]), f"data:{data[0]};digest={digest}"
                if payloads is not None:
                    payloads[digest] = min(data, payloads.get(digest, data))
        else:
            try:
                src = urljoin(url or "", src)
            except ValueError:
                pass
            digest = hashlib.sha256(src.encode("utf-8", "replace")).hexdigest()
        caption = " ".join(captions.get(figure(x), [])) or x.alt or None
        out.append({"pos": pos, "kind": "media", "tag": x.tag, "src": src, "digest": digest, "caption": caption, "mime": mime, "size": size})
    return out


def page_key(url: str | None, html: str | None) -> bytes:
    """128 bits: what moves with each page and each reference is kept short."""
    return hashlib.sha256(f"{url}\0{html}".encode("utf-8", "replace")).digest()[:16]


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
        name = [page_key(u, h) for u, h in rows]
        got = [None if h is None else items(h, u) for u, h in rows]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(name, pa.binary()), pa.array(got, pa.list_(ITEM))], ["page_id", "url", "page", "items"])


def references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The media items of pages, without what they say; digests as bytes."""
    names = ["page", "pos", "digest", "mime", "size"]
    for b in batches:
        got = [(page_key(u, h), x["pos"], bytes.fromhex(x["digest"]), x["mime"], x["size"]) for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist()) for x in items(h, u) if x["kind"] == "media"]
        columns = list(zip(*got)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.binary(), pa.string(), pa.int64()))], names)


def sequences(pages: DataFrame, payloads: DataFrame | None = None) -> DataFrame:
    """(page_id, url, n_items, n_media, n_resolved, items). payloads: (digest, mime, size)."""
    read_ = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # pages are read twice, which costs less than to keep a copy of all items
    refs = core.written(read_.where("html is not null").mapInArrow(references, "page binary, pos int, digest binary, mime string, size long").distinct())
    known = refs.where("size is not null").select("digest", "mime", "size")
    if payloads is not None:
        known = known.unionByName(payloads.select(F.unhex("digest").alias("digest"), "mime", F.col("size").cast("long")))
    known = known.groupBy("digest").agg(F.min(F.struct("mime", "size")).alias("payload"))
    found = refs.select("page", "pos", "digest").join(known, "digest").groupBy("page").agg(F.map_from_entries(F.collect_set(F.struct("pos", "payload"))).alias("found"))

    def resolved(x):
        p = F.try_element_at(F.col("found"), x.pos)
        return F.struct(*(x[c].alias(c) for c in ("pos", "kind", "text", "tag", "src", "digest", "caption")), p["mime"].alias("mime"), p["size"].alias("size"))

    both = read_.mapInArrow(parsed, SCHEMA).join(found, "page", "left").withColumn("items", F.transform("items", resolved)).select("page_id", "url", "items")
    n = lambda f: F.size(F.filter("items", f))
    return both.select("page_id", "url", F.when(F.col("items").isNotNull(), F.size("items")).alias("n_items"), F.when(F.col("items").isNotNull(), n(lambda x: x.kind == "media")).alias("n_media"), F.when(F.col("items").isNotNull(), n(lambda x: x["size"].isNotNull())).alias("n_resolved"), "items")


def payloads(pages: DataFrame) -> DataFrame:
    """(digest, mime, size, data) of the data: addresses of pages: each payload once, whole. Pages without any are passed over before they are read."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: dict[str, tuple[str, bytes]] = {}
            for h in b.column(0).to_pylist():
                items(h, None, got)
            yield pa.RecordBatch.from_arrays([pa.array(list(got)), pa.array([m for m, _ in got.values()], pa.string()), pa.array([len(d) for _, d in got.values()], pa.int64()), pa.array([d for _, d in got.values()], pa.binary())], ["digest", "mime", "size", "data"]) if got else none

    none = pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.string(), pa.string(), pa.int64(), pa.binary())], ["digest", "mime", "size", "data"])
    some = pages.select(F.col("html").cast("string").alias("html")).where(F.lower("html").contains("data:"))
    each = some.mapInArrow(held, "digest string, mime string, size long, data binary")
    return each.groupBy("digest").agg(F.min(F.struct("mime", "size", "data")).alias("p")).select("digest", "p.*")


def referring(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages whose end refers to their own address, in a figure with a caption, and the payloads (digest, mime, size) of all addresses, which are the pages: references and payloads where a crawl has pages alone."""
    quoted = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    figure = F.concat(F.lit('<figure><object data="'), quoted, F.lit('"></object><figcaption>'), quoted, F.lit("</figcaption></figure>"))
    known = pages.where("url is not null and html is not null").select(F.sha2("url", 256).alias("digest"), F.lit("text/html").alias("mime"), F.octet_length("html").cast("long").alias("size"))
    return pages.select("page_id", "url", F.concat("html", F.coalesce(figure, F.lit(""))).alias("html")), known


def op10_media(spark, sf_dir: str) -> DataFrame:
    """The sequences of all pages. They hold no media of their own (README), so each is given a reference to its address, which is resolved among the addresses of all."""
    return sequences(*referring(core.table(spark, sf_dir, "pages")))
