"""Media columns: pages become ordered text and media references, whose payloads are found by digest."""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.common import as_bytes, batches, cut, read, spread_join

ITEM = "struct<pos: int, kind: string, text: string, digest: string, caption: string>"
#: Samples in a row of the stored picture.
WIDTH = 64
_SKIP = {"script", "style", "nav", "footer"}
_BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "div", "article", "section", "td", "th", "blockquote", "pre", "br", "title"}
_MAGIC = b"\x89PNG\r\n\x1a\n"


class Interleaved(HTMLParser):
    """Text blocks and media references of a page in reading order; a figure's caption goes with its reference.

    What stands in _SKIP elements is left out. One that is never closed doesn't take the rest of the page with it:
    its text comes back as one block at the end. (What follows an unclosed script or style is its content.)
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[int] = []
        self.skip = 0
        self.skipped: list[str] = []
        self.keep = False

    def flush(self) -> None:
        text = "".join(self.text)
        self.text = []
        if not self.keep:
            text = " ".join(text.split())
        if text:
            self.items.append({"pos": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "audio", "video", "source"):
            self.flush()
            a = dict(attrs)
            source = a.get("src") or ""
            self.figure.append(len(self.items))
            self.items.append({"pos": len(self.items), "kind": "media", "text": None, "digest": source.removeprefix("sha256:") if source.startswith("sha256:") else hashlib.sha256(source.encode("utf-8", "surrogatepass")).hexdigest(), "caption": a.get("alt") or None})
        elif tag in _BLOCK:
            self.flush()
            self.keep = tag == "pre"
            if tag == "figure":
                self.figure = []

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
            if not self.skip:
                self.skipped = []
        elif tag == "figcaption" and self.caption is not None:
            told = " ".join("".join(self.caption).split())
            for i in self.figure:
                self.items[i]["caption"] = told or self.items[i]["caption"]
            self.caption, self.figure = None, []
        elif tag in _BLOCK:
            self.flush()
            self.keep = False

    def handle_data(self, data):
        if self.skip:
            if self.cdata_elem is None:
                self.skipped.append(data)
        else:
            (self.text if self.caption is None else self.caption).append(data)


def parse(page: str | None) -> list[dict]:
    """The items of a page; none for a null or empty one."""
    p = Interleaved()
    p.feed(page or "")
    p.close()
    p.flush()
    if p.skip:
        p.text, p.keep = p.skipped, False
        p.flush()
    return p.items


def encode(payload: bytes) -> bytes:
    """A payload of a multiple of WIDTH bytes as an 8-bit grey PNG, losslessly."""
    raw = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return _MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(raw), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 4)) + chunk(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """The samples of such a PNG; a damaged one raises ValueError."""
    if media[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit grey")
            shape = (height, width + 1)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape)
    if raw[:, 0].any():
        raise ValueError("rows are filtered")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, mean, deviation and a 64-bit hash of which columns are brighter than the mean."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).astype(np.int64)
    columns, n = x.sum(0), x.size
    bits = "".join("1" if c * WIDTH > columns.sum() else "0" for c in columns.tolist())
    mean = columns.sum() / n
    return f"{len(x)}:{mean:.4f}:{max(0.0, float((x * x).sum()) / n - mean * mean) ** 0.5:.4f}:{int(bits, 2):016x}"


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def page_of(text: str, digest: str, name: str) -> str:
    """A page with a text and, in a figure, the reference to its payload."""
    return f"<article><pre>{html.escape(text, quote=False)}</pre><figure><img src='sha256:{digest}' alt='payload'><figcaption>document {html.escape(name)}</figcaption></figure></article>"


def sequences(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``items``: array of ITEM in reading order, in place of the page.

    A null or empty page has no items. Repeated rows have the same items. Pages of any length are parsed whole. An
    empty table gives no rows. Other columns pass through; one named items is a ValueError.
    """
    rest = [c for c in pages.columns if c != column]
    if "items" in rest:
        raise ValueError("pages has a column named items")
    schema = pages.select(*rest, F.expr(f"cast(null as array<{ITEM}>) as items")).schema

    def run(it):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        for batch in batches(it):
            items = [parse(x) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(items, kind)], names=[*rest, "items"])

    return pages.mapInArrow(run, schema)


def describe(store: DataFrame) -> DataFrame:
    """One row for each digest of a store (digest, media): what the stored bytes hold, read back and verified.

    Only these few values go on to a join; payloads never move. A digest that is stored often is read often
    but leaves each map task once.
    """

    def run(it):
        import pyarrow as pa

        for batch in batches(it):
            out = []
            for digest, media in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist()):
                payload = decode(media)
                read_back = hashlib.sha256(payload).hexdigest()
                if read_back != digest:
                    raise ValueError(f"the payload stored under {digest} isn't it")
                out.append((digest, len(payload), read_back, zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    rows = store.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    columns = rows.columns[1:]
    return rows.groupBy("digest").agg(F.first(F.struct(*columns)).alias("m")).select("digest", "m.*")


def resolve(items: DataFrame, described: DataFrame) -> DataFrame:
    """Exploded items (with pos, kind, digest, caption) and their payload's values; what isn't stored, or has no digest, stays with nulls.

    A digest that a third of all items refer to meets its values by a broadcast. ``items`` should be checkpointed.
    """
    return spread_join(items, described, ["digest"])


SEEN = "struct<pos: int, kind: string, n_bytes: bigint, digest: string, caption: string>"


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, items (array of SEEN), pos, digest, caption and media for each row of ``docs`` (doc_id, text).

    Each text is written as a page with its payload's reference in a figure, and the page is parsed: what is told of
    the text is told by the parsed items. The payload is stored as a PNG under its digest.
    """

    def store(it):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("caption", pa.string())]))
        for batch in batches(it, 256):
            seen, refs, media, length = [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                payload = payload_of(text)
                items = parse(page_of(text.decode("utf-8", "surrogatepass"), hashlib.sha256(payload).hexdigest(), str(doc)))
                for x in items:
                    x["n_bytes"] = None if x["text"] is None else len(x.pop("text").encode("utf-8", "surrogatepass"))
                length.append(sum(x["n_bytes"] for x in items if x["kind"] == "text"))
                refs.append(next(x for x in items if x["kind"] == "media"))
                seen.append([{c: x[c] for c in ("pos", "kind", "n_bytes", "digest", "caption")} for x in items])
                media.append(encode(payload))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(length, pa.int64()), pa.array(seen, kind), *(pa.array([x[c] for x in refs], t) for c, t in (("pos", pa.int32()), ("digest", pa.string()), ("caption", pa.string()))), pa.array(media, pa.binary())],
                names=["doc_id", "n_bytes", "items", "pos", "digest", "caption", "media"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(store, f"doc_id long, n_bytes long, items array<{SEEN}>, pos int, digest string, caption string, media binary")


def media_table(docs: DataFrame) -> DataFrame:
    """Each document as a page with its text and its payload as a picture: parsed, stored, read back and resolved by digest.

    Null text: empty, with a payload of 64 zero bytes. Null doc_id: a row like any other. Equal texts have equal
    payloads and values, and repeated rows are rows of their own. Texts of any length go whole into one payload.
    Columns but doc_id and text are not read, so their names can't clash. An empty table gives no rows.

    What is joined by digest is what the stored bytes hold, read back and verified; the bytes themselves stay where
    they are stored, since a join of them would be a second copy of the corpus on disk.
    """
    held = cut(store_texts(docs))
    return resolve(held.drop("media"), cut(describe(held.select("digest", "media"))))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_table(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption", "items")
