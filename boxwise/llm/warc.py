"""WARC derivatives: metadata and plain-text conversion records of response records.

Every response gives two records that refer to it by its record id and carry
its target URI, its date, the status and headers of the source and both digests:
a ``metadata`` record (application/warc-fields) and a ``conversion`` record
(text/plain) with the text of the HTML. Each row is worked on by itself; nothing
is shuffled and no key can be hot. The text comes from one pass of Python over
each page: the same by Spark's regular expressions takes several passes.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxwise.llm.common import small_batches

CRLF = "\r\n"
BLOCKS = set(
    "address article aside blockquote body br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html"
    " li main nav ol p pre section table td th title tr ul".split()
)
#: Comments, and elements whose content is no text; the end of the page ends them too.
HIDDEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<script\b.*?(?:</script\s*>|\Z)|<style\b.*?(?:</style\s*>|\Z)")
TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)\b[^>]*>|<[a-zA-Z/!?][^>]*>")
TITLE = re.compile(r"(?is)<title\b[^>]*>(.*?)</title")
LANG = re.compile(r"(?is)<html\b[^>]*?\slang=[\"']?([A-Za-z-]+)")
#: Character references with their semicolon; what lacks it stays as it is.
REFERENCE = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});")
LINK = re.compile(r"(?i)<a\b[^>]*?\shref=")


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def record_id(*parts: Column) -> Column:
    """A UUID (version 8) from the SHA-256 of the parts, null as empty: the same input gives the same id."""
    h = F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)
    pieces = (F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def unescaped(text: str) -> str:
    return REFERENCE.sub(lambda m: unescape(m[0]), text)


def tidy(text: str) -> str:
    """Runs of blanks as one, lines without blanks at their ends, no empty lines."""
    for c in "\t\r\f\x0b\xa0":
        text = text.replace(c, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return "\n".join(line for line in (x.strip(" ") for x in text.split("\n")) if line)


def page_text(html: str) -> tuple[str, str, str, int]:
    """Text (block elements on lines of their own), title, language and number of links of a page."""
    shown = TAG.sub(lambda m: "\n" if m[1] and m[1].lower() in BLOCKS else "", HIDDEN.sub("", html))
    title, language = TITLE.search(html), LANG.search(html)
    title = tidy(unescaped(TAG.sub("", title[1]))).replace("\n", " ") if title else ""
    return tidy(unescaped(shown)), title, language[1] if language else "", len(LINK.findall(html))


PAGE = T.StructType([T.StructField(c, T.StringType()) for c in ("text", "title", "language")] + [T.StructField("links", T.IntegerType())])


@F.pandas_udf(PAGE)
def page_texts(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(map(page_text, html), columns=["text", "title", "language", "links"])


def as_responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages, as a crawler would store them.

    Columns: id, record_id, target_uri, date, block. Null HTML is an empty body.
    """
    body = F.coalesce(F.col(html_col), F.lit(""))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(body).cast("string"), F.lit(CRLF + CRLF),
    )
    return pages.select(
        F.col(id_col).alias("id"),
        record_id(F.lit("response"), F.col(id_col), F.col(url_col), F.sha2(body.cast("binary"), 256)).alias("record_id"),
        F.col(url_col).alias("target_uri"), F.lit(date).alias("date"), F.concat(head, body).alias("block"),
    )


def derive(responses: DataFrame) -> DataFrame:
    """Two records (metadata, conversion) for each response (id, record_id, target_uri, date, block).

    ``block`` is the HTTP response: status line, headers, an empty line, the
    body; without an empty line all of it is the body and status and headers
    are null. Null blocks count as empty; a null target URI stays null. A
    repeated response gives repeated records with the same ids. Further
    columns are ignored; an empty table gives no records.
    """
    small_batches(responses.sparkSession)
    source = responses.select("id", "record_id", "target_uri", "date", F.coalesce("block", F.lit("")).alias("block"))
    end = F.instr("block", CRLF + CRLF)
    parts = source.withColumns({
        "head": F.when(end > 0, F.substring("block", F.lit(1), end - 1)),
        "body": F.when(end > 0, F.substring("block", end + 4, F.length("block"))).otherwise(F.col("block")),
    })
    # what is read more than once is a column of its own, so that each page is parsed once
    read = parts.select(
        "id", "record_id", "target_uri", "date", "head",
        digest(F.col("block")).alias("source_block_digest"), digest(F.col("body")).alias("source_payload_digest"),
        F.nullif(F.regexp_extract("head", r"^HTTP/[0-9.]+ ([0-9]{3})", 1), F.lit("")).alias("source_status"),
        F.nullif(F.regexp_extract("head", r"(?i)\r\ncontent-type:[ \t]*([^\r\n]*)", 1), F.lit("")).alias("source_content_type"),
        page_texts("body").alias("page"),
    )
    ids = read.select("*", "page.*").drop("page").withColumns({
        "metadata_id": record_id(F.lit("metadata"), F.col("record_id")), "conversion_id": record_id(F.lit("conversion"), F.col("record_id")),
    })
    field = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit(CRLF))
    metadata = F.concat(
        field("title", F.col("title")), field("language", F.col("language")), field("links", F.col("links")), field("characters", F.length("text")),
        field("source-status", F.col("source_status")), field("source-content-type", F.col("source_content_type")),
        field("source-payload-digest", F.col("source_payload_digest")), field("conversion-record-id", F.col("conversion_id")),
    )
    record = lambda kind, content_type, block: F.struct(
        F.lit(kind).alias("warc_type"), F.col(f"{kind}_id").alias("record_id"), F.lit(content_type).alias("content_type"), block.alias("block")
    )
    made = ids.select(
        "id", F.col("record_id").alias("refers_to"), F.col("date").alias("refers_to_date"), "target_uri", "source_status",
        F.col("head").alias("source_headers"), "source_payload_digest", "source_block_digest",
        F.explode(F.array(record("metadata", "application/warc-fields", metadata), record("conversion", "text/plain; charset=utf-8", F.col("text")))).alias("made"),
    )
    return made.select(
        "id", "made.*", "refers_to", "refers_to_date", "target_uri", "source_status", "source_headers", "source_payload_digest", "source_block_digest",
        digest(F.col("made.block")).alias("block_digest"), F.octet_length("made.block").cast("bigint").alias("content_length"),
    )


def serialised(records: DataFrame) -> DataFrame:
    """(id, record): each record of ``derive`` as the bytes of a WARC/1.1 file."""
    header = lambda name, column: F.when(F.col(column).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(column).cast("string"), F.lit(CRLF))).otherwise("")
    names = {
        "WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Date": "refers_to_date", "WARC-Target-URI": "target_uri", "WARC-Refers-To": "refers_to",
        "WARC-Refers-To-Target-URI": "target_uri", "WARC-Refers-To-Date": "refers_to_date", "WARC-Source-Payload-Digest": "source_payload_digest",
        "WARC-Block-Digest": "block_digest", "Content-Type": "content_type", "Content-Length": "content_length",
    }
    whole = F.concat(F.lit(f"WARC/1.1{CRLF}"), *[header(n, c) for n, c in names.items()], F.lit(CRLF), F.col("block"), F.lit(CRLF + CRLF))
    return records.select("id", whole.cast("binary").alias("record"))
