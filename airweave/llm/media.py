"""Media columns: interleaved document sequences.

An HTML document is parsed to an ordered sequence of text segments and media
references with their captions. Media lie in a store keyed by the SHA-256 of
their payload, in a lossless form (8-bit greyscale PNG, 64 samples a row). A
digest join resolves the references; position and caption stay with each.

A figure's caption, before or after its references, is the caption of each of them;
elsewhere the alternative text is.

Defined cases: null html has an empty sequence; a figure left open ends with the page or the next figure; a reference that the store lacks
stays, with nulls for its payload; a digest stored twice counts once; null text
is an empty payload, which is padded to one row of zeros; repeated rows are
carried each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airweave.llm.common import mapped, split_join, stored, texts_of

#: Samples of a row; payloads are padded to a multiple.
WIDTH = 64
SCHEME = "media:"
_PNG = b"\x89PNG\r\n\x1a\n"
SEQUENCE = "array<struct<position: int, kind: string, text: string, ref: string, caption: string>>"


def padded(text: bytes) -> bytes:
    """``text`` with bytes 0 up to a positive multiple of the row width."""
    return text + b"\0" * (-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """Greyscale PNG of 8-bit samples, 64 a row, unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate((np.zeros((len(rows), 1), np.uint8), rows), axis=1).tobytes()
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")


def from_png(stored_bytes: bytes) -> np.ndarray:
    """Samples (rows x 64) of a PNG that :func:`to_png` wrote; raises if it is damaged."""
    if stored_bytes[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, shape = 8, b"", None
    while at < len(stored_bytes):
        (n,) = struct.unpack_from(">I", stored_bytes, at)
        kind, body = stored_bytes[at + 4 : at + 8], stored_bytes[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", stored_bytes, at + 8 + n)[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows aren't read here")
    return np.ascontiguousarray(lines[:, 1:])


def feature(samples: np.ndarray) -> str:
    """Size, range, sum and 16-bin histogram of samples."""
    counts = np.bincount(samples.ravel(), minlength=256)
    seen = np.flatnonzero(counts)
    bins = ",".join(map(str, counts.reshape(16, 16).sum(1)))
    return f"{samples.shape[1]}x{samples.shape[0]};{seen[0]}..{seen[-1]};sum={int(counts @ np.arange(256))};hist={bins}"


class _Parser(HTMLParser):
    """Text between block tags is one segment; img, audio, video and source are references."""

    INLINE = frozenset("a abbr b bdi bdo cite code em i kbd mark q s samp small span strong sub sup time u var wbr".split())
    MUTE = frozenset(("script", "style", "template", "head"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.said: list[str] = []
        self.mute = 0
        self.captioned: list[int] = []
        self.caption: list[str] | None = None
        self.said_of: str | None = None
        self.inside = False

    def close_text(self):
        text = " ".join("".join(self.said).split())
        self.said.clear()
        if text:
            self.out.append({"position": len(self.out), "kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in self.MUTE:
            self.mute += 1
        if tag in self.INLINE:
            return
        self.close_text()
        if tag == "figure":
            self.close_figure()
            self.inside = True
        if tag == "figcaption":
            self.caption = []
        at = dict(attrs)
        if tag in ("img", "audio", "video", "source") and at.get("src"):
            if self.inside:
                self.captioned.append(len(self.out))
            self.out.append({"position": len(self.out), "kind": "media", "text": None, "ref": at["src"].removeprefix(SCHEME), "caption": at.get("alt") or None})

    def handle_endtag(self, tag):
        if tag in self.MUTE:
            self.mute = max(0, self.mute - 1)
        if tag in self.INLINE:
            return
        if tag == "figcaption" and self.caption is not None:
            self.said_of = " ".join("".join(self.caption).split())
            self.caption = None
        self.close_text()
        if tag == "figure":
            self.close_figure()
            self.inside = False

    def close_figure(self):
        """Give the caption, which may stand before or after them, to the figure's references."""
        for i in self.captioned:
            self.out[i]["caption"] = self.said_of or self.out[i]["caption"]
        self.captioned, self.said_of = [], None

    def handle_data(self, data):
        if not self.mute:
            (self.said if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    """The ordered text and media references of a page; see ``SEQUENCE``."""
    p = _Parser()
    p.feed(html or "")
    p.close()
    p.close_text()
    p.close_figure()
    return p.out


def sequences(df: DataFrame, id_col: str = "page_id", html_col: str = "html", also: tuple[str, ...] = ()) -> DataFrame:
    """(id, sequence) of each row, and the long columns ``also``."""

    def run(batch: pa.RecordBatch):
        longs = {n: batch.column(2 + i) for i, n in enumerate(also)}
        yield {id_col: batch.column(0), "sequence": [parse(h) for h in batch.column(1).to_pylist()]} | longs

    taken = df.select(F.col(id_col).cast("long"), F.col(html_col).cast("string"), *[F.col(n).cast("long") for n in also])
    return mapped(taken, run, f"{id_col} long, sequence {SEQUENCE}" + "".join(f", {n} long" for n in also))


def resolve(seqs: DataFrame, facts: DataFrame, id_col: str, also: tuple[str, ...] = ()) -> DataFrame:
    """One row for each media reference: its id, position and caption, and the ``facts`` (by digest) of its payload."""
    refs = seqs.select(id_col, *also, F.explode("sequence").alias("x")).where("x.kind = 'media'").select(id_col, *also, "x.position", "x.caption", F.col("x.ref").alias("digest"))
    return split_join(refs, facts.dropDuplicates(["digest"]), ["digest"], "left")


def documents_as_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, html, digest, media): a page that refers to the text's payload, and the payload's stored form.

    A partition stores each of its last few thousand digests once; media is null elsewhere.
    """

    def run(batches):
        seen: dict[str, None] = {}
        shape = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("html", pa.string()), ("digest", pa.string()), ("media", pa.binary())])
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo in range(0, len(ids), 256):
                out: dict[str, list] = {n: [] for n in shape.names}
                for key, text in zip(ids[lo : lo + 256], texts_of(batch.slice(lo, 256)), strict=True):
                    payload = padded(text)
                    digest = hashlib.sha256(payload).hexdigest()
                    new = digest not in seen
                    if new:
                        seen[digest] = None
                        if len(seen) > 4096:
                            del seen[next(iter(seen))]
                    html = f'<article><p>{len(text)} bytes of text</p><figure><img src="{SCHEME}{digest}" alt="payload"><figcaption>text payload</figcaption></figure></article>'
                    for c, v in zip(out.values(), (key, len(text), html, digest, to_png(payload) if new else None), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_pydict(out, schema=shape)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, html string, digest string, media binary")


def facts(store: DataFrame) -> DataFrame:
    """What reading each stored form (digest, media) back shows."""

    def run(batch: pa.RecordBatch):
        out: dict[str, list] = {n: [] for n in ("digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for digest, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            media = media.as_py()
            samples = from_png(media)
            payload = samples.tobytes()
            row = (digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples))
            for c, v in zip(out.values(), row, strict=True):
                c.append(v)
        yield out

    return mapped(store.select("digest", "media"), run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_of_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text's payload, then resolve each document's page against the store."""
    store = stored(documents_as_media(df, id_col, text_col), "media")
    seen = facts(store.where(F.col("media").isNotNull()))
    pages = sequences(store, "doc_id", "html", ("n_bytes",))
    return resolve(pages, seen, "doc_id", ("n_bytes",))
