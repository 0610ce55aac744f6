"""Web-archive records to page text."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions.html import html_to_text

HTTP_HEADER = r"(?s)^HTTP/.*?\r?\n\r?\n"


def response_pages(records: DataFrame) -> DataFrame:
    """``(page_id, html, path, record_no)`` of the response records; a record without type
    is dropped.

    The page id is the collection's document id, the record id where that is missing, or
    else the record's place, ``path#record_no``: records without ids never become one
    page.  A leading HTTP header block is not part of the page.
    """
    return _pages(records.where(F.col("warc_type") == "response"))


def _pages(records: DataFrame, *more: str) -> DataFrame:
    place = F.concat("path", F.lit("#"), F.col("record_no").cast("string"))
    payload = F.make_valid_utf8(F.col("payload").cast("string"))
    return records.select(
        F.coalesce("trec_id", "record_id", place).alias("page_id"),
        F.regexp_replace(payload, HTTP_HEADER, "").alias("html"),
        "path", "record_no", *more,
    )


def responses_and_damage(records: DataFrame) -> DataFrame:
    """``response_pages``, and rows with ``error`` for what could not be read."""
    wanted = (F.col("warc_type") == "response") | F.col("error").isNotNull()
    return _pages(records.where(wanted), "error")


def damage(records: DataFrame) -> DataFrame:
    """``(path, record_no, error)`` of what could not be read, whatever type it had."""
    return records.where(F.col("error").isNotNull()).select("path", "record_no", "error")


def page_text(
    pages: DataFrame, keys: Sequence[str] = ("page_id",), html: str = "html"
) -> DataFrame:
    """``(*keys, text, error)``: body text of whole pages; narrow.

    A null page has empty text.  A page that cannot be read has empty text and the
    reason in ``error``, so failures can be counted.
    """
    keys = list(keys)

    def convert(batches):
        for batch in batches:
            texts, errors = [], []
            for page in batch.column(html).to_pylist():
                try:
                    texts.append(html_to_text(page or ""))
                    errors.append(None)
                except Exception as e:  # one bad page must not fail the job
                    texts.append("")
                    errors.append(f"{type(e).__name__}: {e}")
            columns = [batch.column(k) for k in keys]
            columns += [pa.array(texts, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "text", "error"])

    schema = T.StructType([pages.schema[k] for k in keys])
    schema = schema.add("text", "string").add("error", "string")
    return pages.select(*keys, html).mapInArrow(convert, schema)
