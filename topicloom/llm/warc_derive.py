"""WARC derivatives: linked metadata and plain-text conversion records of responses.

Each response gives a ``conversion`` record with the page's text, and a ``metadata`` record
with what the page says about itself, its links, the headers and digests of its source
record as they stand there, its HTTP headers, and digests of what was read.  Both name the
response in WARC-Refers-To and keep its target and date; the metadata names the
conversion.  Record ids follow from the response's id, so a repeated run writes the same
records.  Rows are derived where they are read: nothing is shuffled.

Text is found in one pass over the page: comments, tags and what scripts, styles and the
title hold go; elements that do not belong inside a line part words.  What is not closed
goes on to the end of the page, so time is linear however broken a page is.

Null html is an empty page and still gives both records, with empty text; a null target,
date, http header or map of headers, and headers without a value, stay out of the record.
A response without id is named after its target and payload digest.  Repeated responses
give repeated records; texts of any length are kept whole; extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.html import decoded
from topicloom.llm.common import chunks, released
from topicloom.session import ship_package

CRLF = "\r\n"
#: The date of records whose source has none: archives must have one.
UNDATED = "1970-01-01T00:00:00Z"
#: Status line and headers, to the first empty line.
_HTTP_HEAD = "(?s)^HTTP/.*?\r?\n\r?\n"

# Elements within a line, from the HTML standard.
INLINE = frozenset(
    """a abbr acronym applet audio b basefont bdi bdo big cite code data datalist del dfn
    em embed font i iframe img ins kbd label map mark meter object output param picture
    progress q rp rt ruby s samp slot small source span strike strong sub sup svg time
    track tt u var wbr""".split()
)
_CLOSING = {
    name: re.compile(rf"</{name}(?=[\s/>])[^>]*", re.IGNORECASE) for name in ("script", "style", "title")
}
_NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
_COMMENT_END = re.compile("--!?>")
_IN_TAG = re.compile("[>=]")
_VALUE = re.compile(r"""\s*(?:"[^"]*"?|'[^']*'?)?""")
_BLANK = re.compile("[ \t\n\f\r]+")


def _tag_end(page: str, at: int) -> int:
    """The place behind a tag whose attributes begin at ``at``; quoted values may hold ``>``."""
    while found := _IN_TAG.search(page, at):
        if found[0] == ">":
            return found.end()
        at = _VALUE.match(page, found.end()).end()
    return len(page)


def plain_text(page: str) -> str:
    """The text of a page: entities decoded, white space collapsed and trimmed."""
    parts, at, size = [], 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            parts.append(decoded(page[at:]))
            break
        if mark > at:
            parts.append(decoded(page[at:mark]))
        name = _NAME.match(page, mark + 1)
        if name:
            at, kind = _tag_end(page, name.end()), name[1].lower()
            if kind in _CLOSING and page[mark + 1] != "/":
                closed = _CLOSING[kind].search(page, at)
                at = closed.end() + 1 if closed else size
            if kind not in INLINE and "-" not in kind:
                parts.append(" ")
        elif page.startswith("!--", mark + 1):
            end = _COMMENT_END.search(page, mark + 2)
            at = end.end() if end else size
        elif page[mark + 1 : mark + 2] in ("!", "?", "/"):
            at = page.find(">", mark) + 1 or size
        else:
            parts.append("<")
            at = mark + 1
    return _BLANK.sub(" ", "".join(parts)).strip(" ")


def responses(records: DataFrame) -> DataFrame:
    """(record_id, target_uri, date, http, html, headers) of the library's WARC records."""
    payload = F.make_valid_utf8(F.col("payload").cast("string"))
    http = F.regexp_extract(payload, _HTTP_HEAD, 0)
    return records.where("warc_type = 'response'").select(
        F.coalesce("record_id", "trec_id").alias("record_id"), "target_uri",
        F.col("headers")["WARC-Date"].alias("date"), http.alias("http"),
        F.substring(payload, F.length(http) + 1, F.length(payload)).alias("html"), "headers",
    )


def urn(text: Column) -> Column:
    """A record id that follows from ``text``."""
    digits = F.md5(text.cast("binary"))
    parts = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\f\\r]+", " "))


def _fields(pairs: list[tuple[str, Column]], lists: list[tuple[str, Column]]) -> Column:
    """``name: value`` lines; null and empty values are left out."""

    def line(name):
        return lambda value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    single = [F.when(F.length(v) > 0, line(n)(v)).otherwise(F.lit("")) for n, v in pairs]
    many = [F.array_join(F.transform(v, line(n)), "") for n, v in lists]
    return F.concat(*[F.coalesce(p, F.lit("")) for p in single + many])


@released
def _texts(batches):
    for batch in batches:
        for part, pages in chunks(batch, "html"):
            text = pa.array([plain_text(p.decode("utf-8", "replace")) for p in pages], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, text], [*part.schema.names, "text"])


def derive(pages: DataFrame, headers_col: str | None = None) -> DataFrame:
    """Records of the responses (record_id, target_uri, date, http, html): two rows each.

    ``headers_col`` names a map of the source record's headers, as ``responses`` gives it.

    source_id, warc_type, record_id, refers_to, target_uri, date, content_type,
    content_length, block_digest, block.
    """
    ship_package(pages.sparkSession)
    headers = F.lit(None).cast("map<string,string>") if headers_col is None else F.col(headers_col)
    page = F.coalesce(F.col("html").cast("string"), F.lit(""))
    source = F.coalesce(
        F.col("record_id").cast("string"),
        urn(F.concat(F.coalesce("target_uri", F.lit("")), digest(page))),
    )
    known = pages.select(
        source.alias("source_id"), *[F.col(c).cast("string").alias(c) for c in ("target_uri", "date", "http")],
        page.alias("html"), headers.alias("headers"),
    )
    named = (
        "source_id string, target_uri string, date string, http string, html string, "
        "headers map<string,string>, text string"
    )
    with_text = known.mapInArrow(_texts, named)
    conversion_id = urn(F.concat("source_id", F.lit("#conversion")))
    http_lines = F.filter(F.split(F.coalesce("http", F.lit("")), "\r?\n"), lambda x: F.trim(x) != "")
    given = F.filter(F.array_sort(F.map_entries("headers")), lambda x: F.length(x["value"]) > 0)
    source_lines = F.transform(given, lambda x: F.concat(x["key"], F.lit(": "), x["value"]))
    title = F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)
    about = _fields(
        [
            ("title", _spaced(title)),
            ("language", F.regexp_extract("html", "(?i)<html[^>]*\\slang=\"([^\"]*)\"", 1)),
            ("charset", F.regexp_extract("html", "(?i)<meta[^>]*charset=\"?([A-Za-z0-9_-]+)", 1)),
            ("source-payload-digest", digest(F.col("html"))),
            ("source-payload-length", F.octet_length("html").cast("string")),
            ("conversion-record-id", conversion_id),
            ("conversion-block-digest", digest(F.col("text"))),
        ],
        [
            ("source-warc", source_lines),
            ("source-http", http_lines),
            ("outlink", F.regexp_extract_all("html", F.lit("(?i)<a\\s[^>]*href=\"([^\"]*)\""), 1)),
        ],
    )

    def record(kind, record_id, content_type, block):
        return F.struct(
            F.lit(kind).alias("warc_type"), record_id.alias("record_id"),
            F.lit(content_type).alias("content_type"), block.alias("block"),
        )

    both = F.array(
        record("metadata", urn(F.concat("source_id", F.lit("#metadata"))), "application/warc-fields", about),
        record("conversion", conversion_id, "text/plain; charset=utf-8", F.col("text")),
    )
    rows = with_text.select("source_id", "target_uri", "date", F.inline(both))
    return rows.select(
        "source_id", "warc_type", "record_id", F.col("source_id").alias("refers_to"), "target_uri", "date",
        "content_type", F.octet_length("block").cast("long").alias("content_length"),
        digest(F.col("block")).alias("block_digest"), "block",
    )


def as_warc(records: DataFrame, undated: str = UNDATED) -> DataFrame:
    """(value): each record in the WARC 1.0 format but for its closing blank lines, for a
    text sink with the line separator ``\\r\\n\\r\\n``.  Records without date get ``undated``."""
    head = _fields(
        [
            ("WARC-Type", F.col("warc_type")), ("WARC-Record-ID", F.col("record_id")),
            ("WARC-Refers-To", F.col("refers_to")), ("WARC-Target-URI", F.col("target_uri")),
            ("WARC-Date", F.coalesce("date", F.lit(undated))), ("WARC-Block-Digest", F.col("block_digest")),
            ("Content-Type", F.col("content_type")),
            ("Content-Length", F.col("content_length").cast("string")),
        ],
        [],
    )
    return records.select(F.concat(F.lit("WARC/1.0" + CRLF), head, F.lit(CRLF), "block").alias("value"))
