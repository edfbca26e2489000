"""Media columns: interleaved document sequences and payloads stored as media.

HTML becomes an ordered array of structs, text and media references in the order of the page. A
reference names its payload by digest (``media:<sha256>``), keeps its position and the caption that
belongs to it, and is resolved by a join on the digest. Payloads are stored losslessly as greyscale PNG
images of 64 samples a line.

Scale: encoding, reading back and parsing are row by row. Images are written once to the shared folder (payloads that repeat
within a task once); the digest join moves digests and what was computed of an image that was read back, not the images.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, prepare, table, text_of

WIDTH = 64
#: Digests that a task remembers, so that its memory is bounded; repeats beyond them are stored again.
SEEN = 1 << 18
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_MARK = b"\x89PNG\r\n\x1a\n"
_SKIPPED = {"script", "style", "template", "noscript"}
_BLOCKS = {"p", "div", "article", "section", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "table", "blockquote", "figure", "nav", "header", "footer", "title", "td", "th"}


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def pad(raw: bytes) -> bytes:
    """``raw`` with zero bytes up to a positive multiple of 64."""
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def encode_png(payload: bytes) -> bytes:
    """8-bit greyscale PNG, one line for each 64 bytes; the same payload gives the same bytes."""
    lines = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    return _MARK + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(stored: bytes) -> bytes:
    """The samples of :func:`encode_png`; checks the mark, the checksums and the size."""
    if stored[:8] != _MARK:
        raise ValueError("not a PNG")
    at, parts, height = 8, [], 0
    while at < len(stored):
        (size,), name = struct.unpack(">I", stored[at : at + 4]), stored[at + 4 : at + 8]
        body = stored[at + 8 : at + 8 + size]
        if struct.unpack(">I", stored[at + 8 + size : at + 12 + size])[0] != zlib.crc32(name + body):
            raise ValueError("damaged PNG chunk")
        if name == b"IHDR":
            height = struct.unpack(">II", body[:8])[1]
        elif name == b"IDAT":
            parts.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines aren't written here")
    return lines[:, 1:].tobytes()


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.words, self.skip, self.caption = [], [], 0, None

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # no section that the parser knows: a comment, as browsers take it
            return self.parse_bogus_comment(i)

    def _text(self):
        text = " ".join("".join(self.words).split())
        if text:
            self.items.append([len(self.items), "text", text, None, None])
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skip += 1
        elif tag in _BLOCKS:
            self._text()
        if tag == "figcaption":
            self._text()
            self.caption = []
        if tag in ("img", "video", "audio", "source") and not self.skip:
            self._text()
            a = dict(attrs)
            src = a.get("src") or ""
            digest = src[6:] if src.startswith("media:") else hashlib.sha256(src.encode("utf-8", "replace")).hexdigest()
            self.items.append([len(self.items), "media", src or None, digest, a.get("alt")])

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            caption, self.caption = " ".join("".join(self.caption).split()), None
            last = next((i for i in reversed(self.items) if i[1] == "media"), None)
            if last is not None and caption:
                last[4] = caption
        elif tag in _BLOCKS:
            self._text()

    def handle_data(self, data):
        if not self.skip:
            (self.words if self.caption is None else self.caption).append(data)


def parse_html(html: str | None) -> list[dict]:
    """Ordered texts and media references; null or empty HTML gives an empty sequence.

    A caption is the ``figcaption`` that follows in the figure, else the ``alt`` text, else null.
    """
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    if reader.caption:
        reader.words = reader.caption
    reader._text()
    return [dict(zip(("position", "kind", "text", "digest", "caption"), i)) for i in reader.items]


def interleave(df: DataFrame, id_column: str, html_column: str = "html") -> DataFrame:
    """(id, sequence) for each row of ``df``."""
    prepare(df.sparkSession)
    kind = df.schema[id_column].dataType.simpleString()
    sequence = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse_html(h.as_py()) for h in batch.column(1)], sequence)], [id_column, "sequence"])

    return df.select(id_column, html_column).mapInArrow(run, f"`{id_column}` {kind}, sequence {SEQUENCE}")


def store(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write each row's text as an image to the shared folder and read the table again: id, digest, n_bytes, media.

    The digest also holds the length of the text, as zero bytes at its end and those of the padding look alike in a payload.
    A payload that a task has stored before is not stored by it again: media is null there.
    """
    prepare(df.sparkSession)
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches):
        seen = set()
        for batch in batches:
            digests, sizes, media = [], [], []
            for text in batch.column(1):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                payload = pad(raw)
                digests.append(f"{hashlib.sha256(payload).hexdigest()}-{len(raw)}")
                sizes.append(len(raw))
                new = digests[-1] not in seen
                media.append(encode_png(payload) if new else None)
                if new and len(seen) < SEEN:
                    seen.add(digests[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], [id_column, "digest", "n_bytes", "media"])

    return materialize(df.select(id_column, text_of(text_column).alias("text")).mapInArrow(run, f"`{id_column}` {kind}, digest string, n_bytes long, media binary"), "media")


def read_media(stored: DataFrame) -> DataFrame:
    """One row for each stored image (digest, media): what its samples give once they are read back."""

    def run(batches):
        for batch in batches:
            rows = []
            for media in batch.column(1):
                own = media.as_py()
                back = decode_png(own)
                samples = np.frombuffer(back, np.uint8)
                feature = f"{WIDTH}x{len(back) // WIDTH};sum={int(samples.sum(dtype=np.int64))};used={int(np.count_nonzero(np.bincount(samples, minlength=256)))}"
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(own), hashlib.sha256(own).hexdigest(), feature))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def resolve(sequences: DataFrame, media: DataFrame, id_column: str) -> DataFrame:
    """One row for each media reference: id, position, caption and the columns of ``media`` (null where no payload has the digest).

    ``media`` has one row a digest. Write both before (``materialize``): a digest with very many references
    then has an exchange of its own and is split at run time.
    """
    references = sequences.select(id_column, F.explode("sequence").alias("r")).where("r.kind = 'media'").select(id_column, "r.position", "r.caption", "r.digest")
    return references.hint("merge").join(media, "digest", "left")


def payload_digest(text: Column) -> Column:
    """The digest under which :func:`store` keeps a text, as a column."""
    size = F.octet_length(text)
    rest = F.greatest(F.lit(WIDTH), F.ceil(size / WIDTH) * WIDTH) - size
    return F.concat_ws("-", F.sha2(F.concat(text.cast("binary"), F.unhex(F.repeat(F.lit("00"), rest.cast("int")))), 256), size.cast("string"))


def article(text: Column, digest: Column) -> Column:
    """A page of a text: its lines as paragraphs, and behind the first of them a figure that refers to a payload."""
    escaped = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    first = F.substring_index(escaped, "\n", 1)
    rest = F.replace(F.substr(escaped, F.length(first) + 2), F.lit("\n"), F.lit("</p><p>"))
    return F.concat(F.lit("<article><p>"), first, F.lit('</p><figure><img src="media:'), digest, F.lit('"><figcaption>payload '), F.substring(digest, 1, 12), F.lit("</figcaption></figure><p>"), rest, F.lit("</p></article>"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stored payload, found again through the reference that stands among its paragraphs.

    Each document is a page: its lines are paragraphs, with a figure behind the first; the page is parsed into a sequence, and the
    figure's reference is resolved against the payloads. Null texts count as empty; equal texts have equal values; repeated rows resolve alike.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    stored = store(docs)
    read = read_media(stored.where("media IS NOT NULL"))
    values = [c for c in read.columns if c != "digest"]
    # of each payload, however many tasks have stored it, one row
    media = materialize(read.groupBy("digest").agg(*[F.first(c).alias(c) for c in values]), "payloads")
    pages = docs.select(F.struct("doc_id", F.octet_length("text").cast("long").alias("n_bytes")).alias("known"), article(F.col("text"), payload_digest(F.col("text"))).alias("html"))
    return resolve(interleave(pages, "known"), media, "known").select("known.doc_id", "known.n_bytes", *values, "position", "caption")
