"""Document sources and what is done to a text on its way in."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.text import is_blank

# Limits of a document and of a request, and the codes of what can't be read.
MAX_BYTES = 5 * 1024 * 1024
MAX_REQUEST = MAX_BYTES * 4 // 3 + 64 * 1024
TOO_LARGE, UNREADABLE, UNSUPPORTED, INVALID = "document_too_large", "unreadable_document", "unsupported_media_type", "invalid_request"
PDF_MAGIC = "255044462D"


def clean(text: Column) -> Column:
    """Line ends as line feeds, no-break spaces as spaces."""
    return F.replace(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit("\u00a0"), F.lit(" "))


def layout(text: Column) -> Column:
    """Page text printed by position: gaps of three blanks at most, no blanks at line ends, one empty line at most."""
    narrow = F.regexp_replace(text, r"[ \t]{3,}", "   ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(narrow, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def from_text(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``pages`` (one page), ``media_type`` and ``error``; a bad row gets a code, it never fails the job."""
    t = F.col(text)
    error = F.when(F.octet_length(t) > MAX_BYTES, TOO_LARGE).when(is_blank(t), UNREADABLE)
    return df.withColumns({"error": error, "media_type": F.lit("text/plain"), "pages": F.when(error.isNull(), F.array(clean(t)))})


def from_bytes(df: DataFrame, data: str = "content", media_type: str = "media_type", size: str | None = None) -> DataFrame:
    """As ``from_text`` for BINARY rows with a media type: size first, then PDF by type or magic, then text that must be UTF-8.

    ``size`` names a column with the bytes of each document, for content that was not read because of it. PDF rows get
    ``media_type`` alone; ``with_pdf_pages`` reads them.
    """
    d = F.col(data)
    kind = F.lower(F.trim(F.split_part(F.coalesce(F.col(media_type), F.lit("")), F.lit(";"), F.lit(1))))
    pdf = (kind == "application/pdf") | F.coalesce(F.hex(F.substring(d, 1, 5)) == PDF_MAGIC, F.lit(False))
    textual = kind.isin("", "application/octet-stream") | F.startswith(kind, F.lit("text/"))
    text = F.when(textual & ~pdf, F.try_validate_utf8(d.cast("string")))
    large = (F.coalesce(F.octet_length(d), F.lit(0)) if size is None else F.coalesce(F.col(size), F.octet_length(d), F.lit(0))) > MAX_BYTES
    error = F.when(large, TOO_LARGE).when(pdf & d.isNotNull(), None).when(~textual & ~pdf, UNSUPPORTED).when(text.isNull() | is_blank(text), UNREADABLE)
    return df.withColumns({
        "error": error, "media_type": F.when(pdf, "application/pdf").when(textual, "text/plain").otherwise(kind), "pages": F.when(error.isNull() & ~pdf, F.array(clean(text))),
    })


def no_reader(content: bytes) -> list[str]:
    raise ValueError("no reader of PDF pages was given")


def with_pdf_pages(df: DataFrame, reader: Callable[[bytes], list[str]] = no_reader, positional: bool = False, data: str = "content") -> DataFrame:
    """The rows of ``from_bytes`` with the pages of PDF rows by ``reader``, a function of the bytes that gives the text of each page.

    No parser is part of this library. Whatever the reader raises, and pages that are all blank, make the row an unreadable
    document, never the job fail; without a reader all PDF rows are. ``positional`` is for text printed by position.
    """

    @F.pandas_udf("array<string>")
    def read(contents: pd.Series) -> pd.Series:
        def one(content: bytes | None) -> list[str] | None:
            try:
                pages = [str(p or "") for p in reader(content)] if content is not None else []
            except Exception:  # noqa: BLE001
                return None
            return pages if any(p.strip() for p in pages) else None

        return contents.map(one)

    todo = (F.col("media_type") == "application/pdf") & F.col("error").isNull()
    tidy = (lambda p: layout(clean(p))) if positional else clean
    df = df.withColumn("_read", F.when(todo, read(F.when(todo, F.col(data)))))
    return df.withColumns({
        "pages": F.when(todo, F.transform("_read", tidy)).otherwise(F.col("pages")), "error": F.when(todo & F.col("_read").isNull(), UNREADABLE).otherwise(F.col("error")),
    }).drop("_read")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as ``path, content BINARY, media_type, bytes``; files over the limit are left unread by their size alone.
    ``from_bytes(..., size="bytes")`` then knows them."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.when(F.col("length") <= MAX_BYTES, F.col("content")).alias("content"), F.lit("text/plain").alias("media_type"), F.col("length").alias("bytes"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Request files as ``path, body, error``: by the size in the file's metadata, before a body is read, larger ones are too large."""
    files = spark.read.format("binaryFile").load(path)
    fits = F.col("_metadata.file_size") <= MAX_REQUEST
    body = F.when(fits, F.try_validate_utf8(F.col("content").cast("string")))
    return files.select("path", body.alias("body"), F.when(~fits, TOO_LARGE).when(body.isNull(), INVALID).alias("error"))


def from_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """JSON bodies as ``text``, ``content``, ``media_type``, ``config`` (JSON), ``reference_date DATE`` and ``error``.

    A body needs a document with exactly one of text and base64, and may have a media type, an object as config, and an ISO date. Other keys, in the
    body or in the document, and values of other types make it invalid: types are read off the variant, for a plain reading would turn numbers into strings.
    """
    b = F.col(body)
    df = df.withColumn("_v", F.try_parse_json(b))
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get("_v", path, "variant")), F.lit("VOID"))
    string = lambda path: F.try_variant_get("_v", path, "string")
    only = lambda keys, *known: F.coalesce(F.size(F.array_except(keys, F.array(*map(F.lit, known)))) == 0, F.lit(False))
    text, coded, media, date = string("$.document.text"), string("$.document.base64"), string("$.document.media_type"), string("$.reference_date")
    content, day = F.try_to_binary(coded, F.lit("base64")), F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(date, "yyyy-MM-dd"))
    has = lambda path: kind(path) != "VOID"
    typed = F.lit(True)
    for path in ("$.document.text", "$.document.base64", "$.document.media_type", "$.reference_date"):
        typed = typed & kind(path).isin("VOID", "STRING")
    fine = (
        only(F.json_object_keys(b), "document", "config", "reference_date") & only(F.json_object_keys(F.get_json_object(b, "$.document")), "text", "base64", "media_type")
        & (has("$.document.text") != has("$.document.base64")) & typed & (F.startswith(kind("$.config"), F.lit("OBJECT")) | ~has("$.config"))
        & (coded.isNull() | content.isNotNull()) & (date.isNull() | day.isNotNull()) & (F.octet_length(b) <= MAX_REQUEST)
    )
    df = df.withColumn("_fine", F.coalesce(fine, F.lit(False)))
    ok = lambda c: F.when(F.col("_fine"), c)
    done = df.withColumns({
        "text": ok(text), "content": ok(content), "media_type": ok(media), "config": ok(F.get_json_object(b, "$.config")), "reference_date": ok(day),
        "error": F.when(~F.col("_fine"), INVALID),
    })
    return done.drop("_v", "_fine")
