"""Media columns: interleaved document sequences.

A document's HTML is parsed into an ordered array of text and media-reference structs; a reference names its payload by digest and
keeps its caption. Payloads are in a table keyed by digest, which a join resolves; what it finds is put at the reference's
position, so that text, media and captions stay in line. Payloads are stored as 8-bit grayscale PNG images of 64 samples a row,
without loss.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, texts

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEME = "sha256:"
#: Digests of stored payloads that a task keeps in mind.
SEEN = 1_000_000
PART = "position int, kind string, text string, digest string, caption string"


def padded(payload: bytes) -> bytes:
    """Payload with bytes 0 up to a positive multiple of 64."""
    return payload + bytes(max(WIDTH, -(-len(payload) // WIDTH) * WIDTH) - len(payload))


def png(samples: bytes) -> bytes:
    """An 8-bit grayscale image of WIDTH samples a row."""
    rows = np.zeros((len(samples) // WIDTH, WIDTH + 1), np.uint8)  # first byte: no filter
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def samples(image: bytes) -> bytes:
    """The samples of an image that png() made; chunk checksums are verified."""
    if not image.startswith(SIGNATURE):
        raise ValueError("not a PNG image")
    at, data = len(SIGNATURE), []
    while at < len(image):
        (size,), kind = struct.unpack_from(">I", image, at), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, WIDTH + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and how many differ from the one before."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={-(p * np.log2(p)).sum():.4f};changes={int((x[1:] != x[:-1]).sum())};rows={len(x) // WIDTH}"


class _Figure:
    """An open figure: its media parts, and its caption with the part that stands for it as long as no media is known."""

    def __init__(self):
        self.media: list[list] = []
        self.caption: str | None = None
        self.stand_in: list | None = None


class _Parser(HTMLParser):
    """Ordered parts of a page: text between block elements, and img elements with the caption of their figure or their alt.

    Ends that HTML allows to leave out are found: what is left out of a head is known by its own elements (titles, scripts, styles, templates),
    a caption ends with its figure, the next figure or caption, or the page, a figure with the page. A caption may come before or after its
    media; one without media, or without a figure, is text.
    """

    BLOCKS = frozenset("address article aside blockquote body br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
    SILENT = frozenset(("script", "style", "title", "template"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[list] = []
        self.words: list[str] = []
        self.silent, self.caption = 0, None
        self.figures: list[_Figure] = []

    def flush(self) -> None:
        text = "".join(self.words)
        self.words = []
        if text.strip():
            self.parts.append(["text", text, None, None])

    def end_caption(self) -> None:
        if self.caption is None:
            return
        text, self.caption = "".join(self.caption).strip(), None
        if not self.figures:
            if text:
                self.parts.append(["text", text, None, None])
            return
        figure = self.figures[-1]
        if figure.caption is None:
            figure.caption, figure.stand_in = text, ["text", text, None, None]
        else:  # a second one
            figure.stand_in[1] = figure.caption = f"{figure.caption}\n{text}".strip()
        if text and not any(p is figure.stand_in for p in self.parts):
            self.parts.append(figure.stand_in)

    def end_figure(self) -> None:
        self.end_caption()
        figure = self.figures.pop()
        if figure.media and figure.caption is not None:
            for part in figure.media:
                part[3] = figure.caption
            self.parts = [p for p in self.parts if p is not figure.stand_in]

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT:
            self.silent += 1
        elif tag == "img":
            self.flush()
            have = dict(attrs)
            source = have.get("src") or ""
            self.parts.append(["media", None, source.removeprefix(SCHEME) if source.startswith(SCHEME) else source, have.get("alt")])
            if self.figures:
                self.figures[-1].media.append(self.parts[-1])
        elif tag in self.BLOCKS:
            self.flush()
            if tag == "figure":
                self.end_caption()
                self.figures.append(_Figure())
            elif tag == "figcaption":
                self.end_caption()
                self.caption = []
            elif self.caption:
                self.caption.append("\n")

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag in self.BLOCKS:
            self.flush()
            if tag == "figure" and self.figures:
                self.end_figure()
            elif tag == "body":
                self.finish()

    def handle_data(self, data):
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)

    def finish(self) -> None:
        while self.figures:
            self.end_figure()
        self.end_caption()
        self.flush()


def parts(page: str) -> list[dict]:
    """The parts of a page in order; position counts them from 0. A caption is with its media, not a part of its own."""
    p = _Parser()
    p.feed(page)
    p.close()
    p.finish()
    return [{"position": k, "kind": x[0], "text": x[1], "digest": x[2], "caption": x[3]} for k, x in enumerate(p.parts)]


SEQUENCE = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([parts(x) for x in texts(batch.column("html"))], SEQUENCE)], names=["id", "parts"])


def sequences(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, parts array<struct<position, kind, text, digest, caption>> of every row. A null page has no part."""
    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(_sequences, f"id bigint, parts array<struct<{PART.replace(' ', ':')}>>".replace(",:", ","))


def references(seqs: DataFrame) -> DataFrame:
    """A row per media reference: id, position, digest, caption."""
    return seqs.select("id", F.explode(F.filter("parts", lambda p: p["kind"] == "media")).alias("p")).select("id", "p.position", "p.digest", "p.caption")


def resolve(refs: DataFrame, store: DataFrame, floor: int) -> DataFrame:
    """refs with the columns of store (one row a digest, with n_refs, the references to it); null where there is none.

    Digests of at least floor references are broadcast, the others joined, so that a payload that very many documents show doesn't
    meet in one task. floor bounds the broadcast: it is to be a fixed share of all references.
    """
    rest = [c for c in store.columns if c not in ("digest", "n_refs")]
    frequent = F.broadcast(store.filter(F.col("n_refs") >= floor).select(F.col("digest").alias("f_digest"), F.struct(*rest).alias("f")))
    rare = store.filter(F.col("n_refs") < floor).select(F.col("digest").alias("g_digest"), F.struct(*rest).alias("g"))
    found = refs.join(frequent, F.col("digest") == F.col("f_digest"), "left").join(rare, F.when(F.col("f_digest").isNull(), F.col("digest")) == F.col("g_digest"), "left")
    return found.select(*refs.columns, *(F.coalesce(F.col("f")[c], F.col("g")[c]).alias(c) for c in rest))


def interleaved(seqs: DataFrame, store: DataFrame, scratch: Scratch) -> DataFrame:
    """seqs (id, parts) with parts resolved: every part in its place, media parts with the columns of store as `payload`.

    store: digest and what is known of it, a row a digest. Only references move to the digests' tasks, not the texts; they come back
    to their row by id and a hash of its parts, so ids may be null or repeated. Rows repeated as a whole each get their row; a part
    whose digest isn't in store has a null payload, as text has; a row without media keeps its text.
    """
    stored = store.select("digest", F.struct(*(F.col(f"`{c}`") for c in store.columns if c != "digest")).alias("payload"))
    keyed = scratch.table(seqs.select("id", "parts", F.xxhash64("parts").alias("own")), "sequences")
    refs = keyed.select("id", "own", F.explode(F.filter("parts", lambda p: p["kind"] == "media")).alias("p")).select("id", "own", "p.position", "p.digest").distinct()
    counted = scratch.table(stored.join(refs.groupBy("digest").agg(F.count("*").alias("n_refs")), "digest"), "resolved")
    found = resolve(refs, counted, max(1000, refs.count() // 1000)).filter("payload is not null")
    by_row = found.groupBy(F.col("id").alias("r_id"), F.col("own").alias("r_own")).agg(F.map_from_entries(F.collect_list(F.struct("position", "payload"))).alias("payloads"))
    full = keyed.join(by_row, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("own") == F.col("r_own")), "left")
    return full.select("id", F.transform("parts", lambda p: F.struct(*(p[c].alias(c) for c in ("position", "kind", "text", "digest", "caption")), F.try_element_at("payloads", p["position"]).alias("payload"))).alias("parts"))


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text as a page, and its payload as an image; one that this partition has stored of late is not stored again."""
    seen: set[bytes] = set()
    for batch in batches:
        out, size = [], 0
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            digest = hashlib.sha256(raw)
            page = f'<article><p>{html.escape(text)}</p><figure><img src="{SCHEME}{digest.hexdigest()}" alt=""><figcaption>{len(raw)} bytes</figcaption></figure></article>'
            image = None if digest.digest() in seen else png(padded(raw))
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(digest.digest())
            own = parts(page)
            layout = [{k: p[k] for k in ("position", "kind", "caption")} for p in own]
            out += [{"id": doc, **{k: p[k] for k in ("position", "digest", "caption")}, "layout": layout, "media": image} for p in own if p["kind"] == "media"]
            size += len(image or b"")
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(out, MADE)
                out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, MADE)


LAYOUT = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("caption", pa.string())]))
MADE = pa.schema([("id", pa.int64()), ("position", pa.int32()), ("digest", pa.string()), ("caption", pa.string()), ("layout", LAYOUT), ("media", pa.binary())])
MADE_SQL = "id bigint, position int, digest string, caption string, layout array<struct<position:int,kind:string,caption:string>>, media binary"
FEATURES = pa.schema([("digest", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
FEATURES_SQL = "digest string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for digest, caption, image in zip(batch.column("digest").to_pylist(), batch.column("caption").to_pylist(), batch.column("media"), strict=True):
            image = image.as_py()
            payload, n = samples(image), int(caption.split()[0])
            if hashlib.sha256(payload[:n]).hexdigest() != digest:
                raise ValueError(f"the image of {digest} doesn't hold its payload")
            out.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload)))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(FEATURES.types)], schema=FEATURES)


def documents(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """id, position, digest, caption, layout and the features read back from the stored image, for every row.

    docs: doc_id bigint, text (null: empty); other columns are not read. Each text becomes a page that shows its payload; the page is
    parsed, the payload stored under its digest, and the reference resolved to what the stored image holds. layout has every part
    of the document's sequence in order (position, kind, caption), so the media part's place among the texts is known; the texts
    themselves stay where they are. Equal texts share a stored payload, so they get equal values. Rows that are repeated, or have
    no doc_id, each get their row; an empty table gives none. A text is held whole, with its image.
    """
    made = scratch.table(docs.select("doc_id", "text").mapInArrow(_made, MADE_SQL), "media")
    refs = made.select("id", "position", "digest", "caption", "layout")
    read = made.filter("media is not null").select("digest", "caption", "media").mapInArrow(_features, FEATURES_SQL)
    rest = [f.name for f in FEATURES if f.name != "digest"]
    each = read.withColumn("n_refs", F.lit(0)).unionByName(refs.groupBy("digest").agg(F.count("*").cast("int").alias("n_refs")), allowMissingColumns=True)
    store = scratch.table(each.groupBy("digest").agg(*(F.first(c, ignorenulls=True).alias(c) for c in rest), F.sum("n_refs").alias("n_refs")), "store")
    return resolve(refs, store, max(100, made.count() // 1000))
