"""Interleaved documents: HTML becomes an ordered list of text and media references, and digests resolve the media.

A reference names its media by the SHA-256 of the payload (src="sha256:..."). References keep the position at which
they stand between the texts, and the caption of their figure. Media are stored as 8-bit grey pictures in the PGM
format (P5, maximum 255), the payload padded with bytes 255 to whole tiles.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, new_path, utf8

#: Samples in a row of the picture, and bytes to which a payload is padded: 24 rows of 24.
ROW, TILE = 24, 576
_SRC = re.compile(r"sha256:([0-9a-f]{64})")
_SKIP = frozenset(("script", "style", "template", "noscript"))
_BREAK = frozenset(("p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "figure", "article", "section", "header", "footer", "nav", "blockquote"))

PARTS = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
PARTS_DDL = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


#: Elements whose content is text up to their end tag, and those of them whose text has character references.
_RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))
_REFERENCES = frozenset(("textarea", "title"))
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]*+)))?)?""")


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", text, {}), ("start", tag, attributes) and ("end", tag, {}) in order, as browsers cut a page up.

    Every character is passed a bounded number of times: a tag, comment or quote without an end runs to the end of the
    page, and nothing is tried again behind it.
    """
    at, n = 0, len(html)
    while at < n:
        mark = html.find("<", at)
        if mark < 0:
            mark = n
        if mark > at:
            yield "text", unescape(html[at:mark]), {}
        if mark == n:
            return
        at = mark
        if html.startswith("<!--", at):
            end = html.find("-->", at + 2)  # <!--> is whole
            at = end + 3 if end >= 0 else n
        elif html.startswith(("<!", "<?"), at) or (html.startswith("</", at) and not _NAME.match(html, at + 2)):
            end = html.find(">", at)
            at = end + 1 if end >= 0 else n
        elif m := _NAME.match(html, at + (2 if html.startswith("</", at) else 1)):
            kind, tag, found = ("end" if html[at + 1] == "/" else "start"), m[0].lower(), {}
            at = m.end()
            while at < n and html[at] != ">":
                m = _ATTRIBUTE.match(html, at)
                at = m.end()
                if m[1]:
                    found.setdefault(m[1].lower(), unescape(next((v for v in m.groups()[1:] if v is not None), "")))
            if at >= n:
                return
            at += 1
            yield kind, tag, found if kind == "start" else {}
            if kind == "start" and tag in _RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                end = close.start() if close else n
                if end > at:
                    yield "text", unescape(html[at:end]) if tag in _REFERENCES else html[at:end], {}
                at = end
        else:
            yield "text", "<", {}
            at += 1


class _Interleaver:
    def __init__(self) -> None:
        self.parts: list[dict] = []
        self.held: list[str] = []
        self.skip = self.figure = 0
        self.caption: list[str] | None = None
        self.waiting: list[dict] = []

    def _close(self) -> None:
        text = "".join(self.held)
        self.held = []
        if text.strip():
            self._add("text", text, None, None)

    def _add(self, kind: str, text: str | None, digest: str | None, caption: str | None) -> dict:
        self.parts.append({"position": len(self.parts), "kind": kind, "text": text, "digest": digest, "caption": caption})
        return self.parts[-1]

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in _SKIP:
            self.skip += 1
        elif tag in ("img", "video", "audio", "source") and not self.skip:
            if found := _SRC.fullmatch(attributes.get("src", "")):
                self._close()
                part = self._add("media", None, found[1], attributes.get("alt") or None)
                if self.figure:
                    self.waiting.append(part)
        elif tag == "figcaption":
            self._close()
            self.caption = []
        elif tag in _BREAK:
            self._close()
            self.figure += tag == "figure"

    def end(self, tag: str) -> None:
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption":
            self._caption()
        elif tag in _BREAK:
            self._close()
            if tag == "figure":
                self._caption()  # left open, it ends with its figure
                self.figure, self.waiting = max(0, self.figure - 1), []

    def _caption(self) -> None:
        if self.caption is not None:
            said, self.caption = " ".join("".join(self.caption).split()), None
            for part in self.waiting:
                part["caption"] = said or part["caption"]

    def text(self, text: str) -> None:
        if not self.skip:
            (self.held if self.caption is None else self.caption).append(text)


def parse(html: str | None) -> list[dict]:
    """The parts of a page in order; null and empty pages have none. Text ends at block tags and at references."""
    reader = _Interleaver()
    for kind, said, attributes in tokens(html or ""):
        if kind == "text":
            reader.text(said)
        elif kind == "start":
            reader.start(said, attributes)
        else:
            reader.end(said)
    reader._caption()
    reader._close()
    return reader.parts


def interleave(pages: DataFrame, id_col: str, html_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """(id, *keep, parts): one row a page, whatever it holds.

    Null and empty pages have no parts; broken markup is read as far as it goes; ids may be null or repeated, and
    repeated rows stay rows of their own; an empty table gives no rows. A page is parsed in one task, whatever its
    length. Of the other columns only those in keep are looked at; these may not be named id, html or parts, which is
    an error.
    """
    if taken := {"id", "html", "parts"}.intersection(c.lower() for c in keep):
        raise ValueError(f"kept columns may not be named {', '.join(sorted(taken))}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, html = batch.columns
            for at in range(0, batch.num_rows, 256):
                parts = pa.array([parse(h.as_py()) for h in html[at : at + 256]], PARTS)
                yield pa.RecordBatch.from_arrays([*(c[at : at + 256] for c in kept), parts], ["id", *keep, "parts"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), *keep, F.col(html_col).alias("html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, parts {PARTS_DDL}")


def references(sequences: DataFrame) -> DataFrame:
    """One row for each media reference: id, what interleave kept, position, digest, caption. Pages without one give no row; a digest that stands twice in a page is two references."""
    kept = [c for c in sequences.columns if c != "parts"]
    parts = sequences.select(*kept, F.explode("parts").alias("p")).filter("p.kind = 'media'")
    return parts.select(*kept, "p.position", "p.digest", "p.caption")


def resolve(refs: DataFrame, media: DataFrame) -> DataFrame:
    """Joins references with what `media` holds for their digest, once a digest; unknown and null digests keep nulls. An empty table on either side loses no reference. Of a column that both have, that of refs stays.

    The join has a second key, a hash of the digest, so that the media, one a digest by an exchange on the digest
    alone, are exchanged once more for it: adaptive execution splits skewed digests only between two such exchanges.
    """
    taken = {c.lower() for c in refs.columns}
    held = media.select("digest", *[f"`{c}`" for c in media.columns if c.lower() not in taken])
    d, dh, rh = (free_name(refs, f"_media_{x}", held) for x in ("digest", "hash", "own"))
    known = held.dropDuplicates(["digest"]).withColumnRenamed("digest", d).withColumn(dh, F.xxhash64(d))
    return refs.withColumn(rh, F.xxhash64("digest")).join(known, (F.col(rh) == F.col(dh)) & (F.col("digest") == F.col(d)), "left").drop(d, dh, rh)


def pad(octets: bytes) -> bytes:
    return octets + b"\xff" * (max(TILE, -(-len(octets) // TILE) * TILE) - len(octets))


def to_picture(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def from_picture(picture: bytes) -> bytes:
    m = re.match(rb"P5\n(\d+) (\d+)\n255\n", picture)
    if not m or len(picture) - m.end() != int(m[1]) * int(m[2]):
        raise ValueError("not a picture of this format")
    return picture[m.end() :]


def feature(samples: np.ndarray) -> str:
    """Mean and spread of the samples, mean step between neighbours in a row, and a histogram of 8 levels."""
    n = len(samples)
    levels = np.bincount(samples >> 5, minlength=8)
    rows = samples.reshape(-1, ROW).astype(np.int16)
    step = int(np.abs(np.diff(rows, axis=1)).sum(dtype=np.int64))
    total, squares = int(samples.sum(dtype=np.int64)), int(np.square(samples.astype(np.uint16)).sum(dtype=np.int64))
    return f"n={n};sum={total};squares={squares};step={step};levels=" + ",".join(map(str, levels.tolist()))


def payload(text: Column) -> Column:
    """The text's bytes (none for null), padded with bytes 255 as `pad` does."""
    octets = F.coalesce(utf8(text), F.lit(b""))
    tiles = F.greatest(F.lit(1), F.ceil(F.octet_length(octets) / TILE))
    return F.rpad(octets, (tiles * TILE).cast("int"), F.lit(b"\xff"))


def picture(octets: Column) -> Column:
    """What `to_picture` gives, of a column of payloads."""
    head = F.concat(F.lit(f"P5\n{ROW} "), (F.octet_length(octets) / ROW).cast("int").cast("string"), F.lit("\n255\n"))
    return F.concat(utf8(head), octets)


def escaped(text: Column) -> Column:
    """The text as it stands in a page."""
    out = F.coalesce(text, F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def illustrated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, html): each text as a page that shows it and, in a figure, its picture."""
    n = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    digest = F.sha2(payload(F.col(text_col)), 256)
    html = F.concat(F.lit("<article><p>"), escaped(F.col(text_col)), F.lit('</p><figure><img src="sha256:'), digest, F.lit('" alt=""><figcaption>'), n.cast("string"), F.lit(" bytes</figcaption></figure></article>"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n_bytes"), html.alias("html"))


def store_pictures(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(digest, picture) of every text, by way of files at path."""
    octets = docs.select(payload(F.col(text_col)).alias("payload"))
    pictures = octets.select(F.sha2("payload", 256).alias("digest"), picture(F.col("payload")).alias("picture"))
    pictures.write.option("parquet.block.size", 16 << 20).option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema("digest string, picture binary").parquet(path)


def inspect(media: DataFrame) -> DataFrame:
    """Reads stored pictures back: digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, scalar in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                picture = scalar.as_py()
                payload = from_picture(picture)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(picture), hashlib.sha256(picture).hexdigest(), feature(np.frombuffer(payload, np.uint8))))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("digest", "picture").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def store_and_resolve(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text's picture, reads the pictures back, and joins what they hold to the references of the parsed pages: doc_id, n_bytes, position, caption, digest, and what `inspect` gives.

    A null text is an empty one: one tile of 255. Null ids stay, repeated rows stay rows of their own, and an empty
    table gives no rows. Of equal texts all pictures are stored, and one is joined. A very long text is one page and
    one picture in one task, some ten times its bytes of memory. Other columns are not looked at.
    """
    stored = store_pictures(docs, path or new_path(docs.sparkSession, "pictures"), text_col)
    # pictures stay with the rows they came from: nothing but digests and figures moves
    refs = references(interleave(illustrated(docs, id_col, text_col), "doc_id", "html", ("n_bytes",)))
    return resolve(refs, inspect(stored)).withColumnRenamed("id", "doc_id")
