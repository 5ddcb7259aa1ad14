"""Interleaved sequences of text and media from HTML, with payloads resolved by digest.

HTML is parsed into an ordered list of structs: pieces of text and references
to media, each with its position and, for media, its caption. References name
their payload by the SHA-256 of its stored form; a join on that digest with the
media store brings what is read back from the stored bytes. Text and media keep
their positions, so a document can be put together again in order.

Media are stored as grey images of 8-bit samples (PGM, 192 samples wide), which
hold any bytes without loss. The store is written and read by the tasks that
have the rows; payloads are not shuffled, only digests and features are.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import in_small_batches, written

WIDTH = 192
#: Magic, a comment with the number of bytes before filling up, width and height, the largest sample.
PGM = re.compile(rb"P5\n# (\d+) bytes\n(\d+) (\d+)\n255\n")
BLOCKS = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "td", "th", "table", "article", "section", "header", "footer", "nav", "figure", "figcaption", "title", "body", "blockquote", "pre"}
ITEMS = "array<struct<position:int,kind:string,text:string,src:string,digest:string,caption:string>>"


class _Sequence(HTMLParser):
    """Collects [kind, text, src, digest, caption] in the order of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.parts: list[str] = []
        self.hidden = self.caption = self.figure = 0
        self.captions: list[str] = []
        self.in_figure: list[list] = []

    def flush(self) -> None:
        text = "".join(self.parts).strip()
        if text:
            self.items.append(["text", text, None, None, None])
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in ("img", "video", "audio", "source"):
            given = dict(attrs)
            src = given.get("src") or ""
            self.flush()
            digest = src.rpartition("sha256:")[2] if "sha256:" in src else given.get("data-sha256")
            self.items.append(["media", None, src, digest.lower() if digest else None, given.get("alt") or None])
            if self.figure:
                self.in_figure.append(self.items[-1])
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure += 1
            elif tag == "figcaption":
                self.caption += 1
                self.captions = []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.caption = max(0, self.caption - 1)
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure" and self.figure:
                self.end_figure()

    def end_figure(self) -> None:
        self.figure -= 1
        caption = " ".join("".join(self.captions).split())
        for item in self.in_figure:  # the caption of a figure belongs to all its media
            item[4] = caption or item[4]
        self.captions, self.in_figure = [], []

    def handle_data(self, data):
        if not self.hidden:
            (self.captions if self.caption else self.parts).append(data)

    def read(self, html: str) -> list[list]:
        self.feed(html)
        self.close()
        self.flush()
        if self.figure:
            self.end_figure()
        return self.items


def sequences(pages: DataFrame, id_col: str, html_col: str, with_text: bool = True) -> DataFrame:
    """(id, items): the ordered structs of each page; null HTML has none.

    Captions are the figure's caption, else the alternative text. Without
    ``with_text`` the text items keep their positions and lose their texts.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "text", "src", "digest", "caption")
        kind = pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in names)]))
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = []
                for html in batch.column(1):
                    items = _Sequence().read(html.as_py() or "")
                    found.append([{"position": k, **dict(zip(names, i, strict=True))} | ({} if with_text else {"text": None}) for k, i in enumerate(items)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["id", "items"])

    return in_small_batches(rows, parsed, f"id {rows.schema['id'].dataType.simpleString()}, items {ITEMS}")


def stored_form(text: Column) -> Column:
    """The PGM image of a text's UTF-8 bytes, filled up with blanks to whole rows; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    n = F.octet_length(text)
    height = F.greatest(F.ceil(n / WIDTH), F.lit(1)).cast("int")
    head = F.concat(F.lit("P5\n# "), n.cast("string"), F.lit(f" bytes\n{WIDTH} "))
    return F.concat(head, height.cast("string"), F.lit("\n255\n"), text, F.repeat(F.lit(" "), height * WIDTH - n)).cast("binary")


def samples(stored: bytes) -> tuple[int, bytes]:
    """The number of bytes before filling up, and the payload of a stored image."""
    head = PGM.match(stored)
    if head is None or len(stored) - head.end() != int(head[2]) * int(head[3]):
        raise ValueError("not a PGM image of 8-bit samples")
    return int(head[1]), stored[head.end() :]


def feature_of(payload: bytes) -> str:
    """A thumbnail of 32 bits (columns against their median) and a histogram of 16 bins, in hexadecimal digits."""
    values = np.frombuffer(payload, np.uint8)
    columns = values.reshape(-1, WIDTH).sum(axis=0, dtype=np.int64).reshape(32, -1).sum(axis=1)
    bits = int("".join("1" if c > m else "0" for c, m in zip(columns, np.repeat(np.sort(columns)[16], 32), strict=True)), 2)
    share = np.bincount(values >> 4, minlength=16) * 15 / len(values)
    return f"{bits:08x}-" + "".join(f"{int(np.ceil(x)):x}" for x in share)


def described(store: DataFrame) -> DataFrame:
    """One row per digest of the store (digest, media), from its bytes as read back."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for k in range(batch.num_rows):
                media = batch.column(0)[k].as_py()
                n_bytes, payload = samples(media)
                values = (hashlib.sha256(media).hexdigest(), len(media), n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), feature_of(payload))
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            names = ["media_sha256", "media_bytes", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    schema = "media_sha256 string, media_bytes bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, feature string"
    made = in_small_batches(store.select("media"), read, schema)
    # equal digests have equal rows; the aggregation combines on the map side
    return made.groupBy("media_sha256").agg(*[F.first(c).alias(c) for c in made.columns[1:]])


def interleave(pages: DataFrame, store: DataFrame, id_col: str = "id", html_col: str = "html", with_text: bool = True) -> DataFrame:
    """One row per item of a page: id, position, kind, text, src, digest, caption, and what is stored under the digest.

    ``store`` has the column ``media`` (stored bytes). Rows in order of
    position make up the page. A reference without a digest, or with one that
    the store lacks, keeps its row with nulls. Pages without items have no
    rows; repeated pages repeat theirs. Media stored twice resolve once.
    """
    items = sequences(pages, id_col, html_col, with_text).select(F.col("id").alias(id_col), F.explode("items").alias("item")).select(id_col, "item.*")
    items = written(items, "items")
    media = items.where("digest is not null")
    # written, so that the join has two plain sides: descriptions are broadcast where they are few, and a digest that
    # very many references name is split by AQE otherwise
    known = written(described(store), "described")
    found = media.join(known, media["digest"] == F.col("media_sha256"), "left")
    return found.unionByName(items.where("digest is null"), allowMissingColumns=True)


def text_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents as pages, each with its own text as a stored image, and the store.

    The page has a paragraph for each line and, after the first, a figure whose
    image is named by its digest. Returns pages (id, html) and the store
    (media), both from one written table.
    """
    store = docs.select(F.col(id_col).alias("id"), stored_form(F.col(text_col).cast("string")).alias("media"))
    store = written(store, "media", compression="zstd")
    # the page's text is read from the image as well
    head = F.regexp_extract(F.decode(F.substring("media", 1, 64), "ISO-8859-1"), rf"^(P5\n# [0-9]+ bytes\n{WIDTH} [0-9]+\n255\n)", 1)
    n_bytes = F.regexp_extract(head, "# ([0-9]+) bytes", 1).cast("int")
    body = F.decode(F.substring("media", F.length(head) + 1, n_bytes), "UTF-8")
    safe = F.replace(F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    figure = F.concat(
        F.lit('</p><figure><img src="sha256:'), F.sha2("media", 256),
        F.lit('"><figcaption>Document '), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("</figcaption></figure><p>"),
    )
    first = F.substring_index("body", "\n", 1)
    rest = F.replace(F.substring(F.col("body"), F.length(first) + 2, F.length("body")), F.lit("\n"), F.lit("</p><p>"))
    html = F.concat(F.lit("<article><p>"), first, figure, rest, F.lit("</p></article>"))
    return store.select("id", "media", safe.alias("body")).select("id", html.alias("html")), store.select("media")
