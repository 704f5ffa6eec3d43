"""WARC derivatives: a linked metadata and a plain-text conversion record for each response record.

Records are rows: record_id, warc_type, target_uri, date, content_type, block (bytes), and payload_digest where a source states
one. `read` takes them from WARC files (1.0 and 1.1) and `write` puts them there, through Spark's own text source, so files may
lie in any store. Records end where their Content-Length says; a payload may hold a version line. Uncompressed files are split,
and only a payload with a version line that lies across a split is misread there; compressed files are not split.
`derive` needs no shuffle: each response gives its two records in one pass.

Both derivatives name the response in refers_to, with its URI and date, and the metadata record also names the conversion
made beside it. Source HTTP headers are carried along, and the source's payload digest as it stands there, or made from the
payload where there is none; `write` keeps both. Identifiers are made from the response's identifier, so a repeated run gives
equal records, and repeated responses give repeated derivatives.

A null block or text counts as empty; a block without a blank line after its headers is all headers, however long. A null URI,
date or identifier stays null. Records of other types give no derivative. An empty table gives an empty result; texts of any
length are converted whole; there are no ties to break. Other columns are ignored. Payloads are read as
UTF-8, with a replacement character for bytes that are none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import text_or_empty

VERSION = "WARC/1.1\r\n"
#: What every record begins with, up to the minor version.
MARK = b"WARC/1."
COLUMNS = ("record_id", "warc_type", "target_uri", "date", "content_type", "block")
# Elements whose content is no text, and elements that end a line.
SILENT = ("script", "style", "noscript", "template")
LINES = "address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
# Entities that are decoded, the ampersand last; others stay as they stand.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def uuid_of(name: Column) -> Column:
    """A record identifier that only the name decides; null for null."""
    h = F.md5(name.cast("binary"))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(name.isNotNull(), F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")))


def digest(body: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(body, 256))


def plain_text(page: Column) -> Column:
    """The visible text of a page: a line for each block element, blanks collapsed."""
    # Comments and silent elements go in one pass, whichever begins first.
    silent = "|".join(rf"{name}(?:[ \t\r\n/][^>]*)?>.*?</{name}[ \t\r\n]*>" for name in SILENT)
    text = F.regexp_replace(page, rf"(?is)<(?:!--.*?-->|{silent})", " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{LINES})(?:[ \t\r\n/][^>]*)?>", "\n")
    text = F.regexp_replace(text, r"<[a-zA-Z/!?][^>]*>", "")
    text = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), text)
    # Only blanks that change are matched: most are single spaces between words.
    text = F.regexp_replace(text, r" [ \t\r]+|[\t\r][ \t\r]*", " ")
    return F.btrim(F.regexp_replace(text, r" \n[ \n]*|\n[ \n]+", "\n"), F.lit(" \n"))


def field(headers: Column, name: str) -> Column:
    """The first value of a header field, null where it is missing."""
    found = F.regexp_extract(headers, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def responses(pages: DataFrame, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of raw pages, with id_col."""
    body = F.encode(text_or_empty(html_col), "UTF-8")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    name = F.concat_ws(" ", F.lit("response"), F.col(id_col).cast("string"), F.col(url_col))
    return pages.select(id_col, uuid_of(name).alias("record_id"), F.lit("response").alias("warc_type"), F.col(url_col).alias("target_uri"), F.lit(date).alias("date"), F.lit("application/http; msgtype=response").alias("content_type"), F.concat(F.encode(head, "UTF-8"), body).alias("block"))


def derive(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The metadata and conversion records of the responses, with the columns `keep` of their response.

    Beside COLUMNS: refers_to, refers_to_uri, refers_to_date, concurrent_to, source_headers, source_digest (of the
    response's payload), block_digest, content_length.
    """
    stated = F.col("payload_digest") if "payload_digest" in records.columns else F.lit(None).cast("string")
    rows = records.filter("warc_type = 'response'").select(*keep, *[F.col(c).alias(f"_{c}") for c in COLUMNS], stated.alias("_stated"))
    block = F.coalesce(F.col("_block"), F.lit(b""))
    # A string of the bytes as they are: cut at the blank line without reading characters.
    rows = rows.withColumn("_raw", F.substring_index(block.cast("string"), "\r\n\r\n", 1).cast("binary"))
    rows = rows.withColumn("_payload", F.expr("substring(coalesce(_block, X''), octet_length(_raw) + 5)")).withColumn("_head", F.decode("_raw", "ISO-8859-1"))
    page = F.make_valid_utf8(F.col("_payload").cast("string"))
    rows = rows.withColumn("_digest", F.coalesce("_stated", digest(F.col("_payload")))).withColumn("_text", plain_text(page))
    meta, text = uuid_of(F.concat(F.lit("metadata "), "_record_id")), uuid_of(F.concat(F.lit("conversion "), "_record_id"))
    title = F.trim(F.regexp_extract(page, r"(?is)<title(?:[ \t\r\n][^>]*)?>([^<]*)", 1))
    lang = F.regexp_extract(page, r"""(?i)<html[^>]*[ \t\r\n]lang=["']?([a-zA-Z-]+)""", 1)
    links = F.regexp_count(page, F.lit(r"(?i)<a[ \t\r\n][^>]*href="))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit("\r\n"))
    facts = F.concat(line("http-status", F.regexp_extract("_head", r"^HTTP/[0-9.]+ ([0-9]{3})", 1)), line("http-content-type", field(F.col("_head"), "Content-Type")), line("source-payload-digest", F.col("_digest")), line("title", title), line("language", lang), line("outlinks", links), line("conversion-record-id", text))
    made = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), meta.alias("record_id"), text.alias("concurrent_to"), F.lit("application/warc-fields").alias("content_type"), F.encode(facts, "UTF-8").alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), text.alias("record_id"), meta.alias("concurrent_to"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.encode("_text", "UTF-8").alias("block")),
    )
    out = rows.withColumn("_made", F.explode(made))
    return out.select(
        *keep,
        *[F.col(f"_made.{c}").alias(c) for c in ("record_id", "warc_type")],
        F.col("_target_uri").alias("target_uri"),
        F.col("_date").alias("date"),
        F.col("_made.content_type").alias("content_type"),
        F.col("_made.block").alias("block"),
        F.col("_record_id").alias("refers_to"),
        F.col("_target_uri").alias("refers_to_uri"),
        F.col("_date").alias("refers_to_date"),
        F.col("_made.concurrent_to").alias("concurrent_to"),
        F.col("_head").alias("source_headers"),
        F.col("_digest").alias("source_digest"),
        digest(F.col("_made.block")).alias("block_digest"),
        F.octet_length("_made.block").cast("long").alias("content_length"),
    )


#: Header fields of a record and the columns they come from; columns that a table lacks are left out.
FIELDS = {
    "WARC-Type": "warc_type",
    "WARC-Record-ID": "record_id",
    "WARC-Target-URI": "target_uri",
    "WARC-Date": "date",
    "WARC-Refers-To": "refers_to",
    "WARC-Refers-To-Target-URI": "refers_to_uri",
    "WARC-Refers-To-Date": "refers_to_date",
    "WARC-Concurrent-To": "concurrent_to",
    "WARC-Block-Digest": "block_digest",
    "WARC-Payload-Digest": "payload_digest",
    "WARC-Source-Payload-Digest": "source_digest",
    "WARC-Source-Headers": "source_headers",
    "Content-Type": "content_type",
}
#: Fields of several lines, which stand in base 64.
FOLDED = ("source_headers",)


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files of the records, one a partition."""
    shown = lambda c: F.replace(F.base64(F.encode(c, "UTF-8")), F.lit("\r\n"), F.lit("")) if c in FOLDED else F.col(c)
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), shown(c), F.lit("\r\n"))).otherwise("") for name, c in FIELDS.items() if c in records.columns]
    block = F.coalesce(F.col("block"), F.lit(b""))
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    records.select(F.concat(F.lit(VERSION), *lines, size, block.cast("string")).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Head and block of each record, from the parts between marks: a record that is not over takes the next part too."""
    held, missing = b"", 0

    def parts() -> Iterator[bytes]:
        for b in batches:
            yield from b.column(0).to_pylist()

    def made(record: bytes) -> pa.RecordBatch:
        head, _, rest = record.partition(b"\r\n\r\n")
        return pa.RecordBatch.from_arrays([pa.array([head.partition(b"\r\n")[2]], pa.binary()), pa.array([rest[: size_of(head)]], pa.binary())], ["head", "block"])

    def size_of(head: bytes) -> int:
        for line in head.split(b"\r\n"):
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                return int(value)
        return 0

    for part in parts():
        if held and missing > 0:
            held += MARK + part
            missing -= len(MARK) + len(part)
        elif part.strip():
            if held:
                yield made(held)
            head, _, rest = part.partition(b"\r\n\r\n")
            held, missing = part, size_of(head) - len(rest)
    if held:
        yield made(held)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, with the columns of FIELDS and block; a field without a value is null."""
    raw = spark.read.option("lineSep", MARK.decode()).text(path).select(F.col("value").cast("binary"))
    rows = raw.mapInArrow(_whole, "head binary, block binary").withColumn("head", F.make_valid_utf8(F.col("head").cast("string")))
    back = lambda c, x: F.decode(F.unbase64(x), "UTF-8") if c in FOLDED else x
    return rows.select(*[back(c, field(F.col("head"), name)).alias(c) for name, c in FIELDS.items()], "block")
