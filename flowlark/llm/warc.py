"""Derivative builder for web archives: metadata and plain-text records that refer to their responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Named characters that are decoded, once each. Fixed values.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"),
    ("&middot;", "·"), ("&bull;", "•"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&laquo;", "«"), ("&raquo;", "»"),
    ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&euro;", "€"), ("&#39;", "'"), ("&#34;", '"'), ("&amp;", "&"),
]

#: What is taken out whole, what ends a line, and any other tag.
UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<noscript\b.*?</noscript\s*>"
LINE_ENDS = r"(?i)</?(?:p|div|br|hr|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|title|blockquote|pre)\b[^>]*>"
TAGS = r"(?s)<[a-zA-Z/!?][^>]*>"
#: White space that is not already one space.
SPACES = r"[\n\t\x0B\f ]{2,}|[\n\t\x0B\f]"


def plain_text(html: Column) -> Column:
    """The text of a page: a line for each block with text, runs of white space as one space."""
    text = F.regexp_replace(F.regexp_replace(html, r"[\x00\r]", ""), UNSEEN, " ")
    text = F.regexp_replace(F.regexp_replace(text, SPACES, " "), LINE_ENDS, "\n")
    text = F.regexp_replace(text, TAGS, "")
    text = F.regexp_replace(decoded(text), r"[ \x{A0}]{2,}|\x{A0}", " ")
    return F.regexp_replace(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def decoded(text: Column) -> Column:
    """The text with its named characters. Each begins with the one `&` it holds, so the text is cut there and each piece looked at once."""

    def one(piece: Column, place: Column) -> Column:
        out = F.when(place == 0, piece)
        for name, character in ENTITIES:
            out = out.when(F.startswith(piece, F.lit(name[1:])), F.concat(F.lit(character), F.substring(piece, len(name), 2**31 - 1)))
        return out.otherwise(F.concat(F.lit("&"), piece))

    return F.array_join(F.transform(F.split(text, "&"), one), "")


def uuid_urn(name: Column) -> Column:
    """A record id that is the same on every run: the md5 of the name, laid out as a UUID."""
    h = F.md5(name.cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records for a table of pages (page_id, url, html)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    name = F.concat(F.lit("response:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("url").cast("string"), F.lit("")))
    return pages.select(
        uuid_urn(name).alias("record_id"),
        F.col("page_id").cast("long").alias("source_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit("text/html; charset=utf-8").alias("payload_type"),
        html.alias("payload"),
    )


def derived_records(responses: DataFrame) -> DataFrame:
    """Two records for each response: `metadata` about it and the `conversion` of its payload to plain text.

    responses: record_id, source_id, target_uri, date, payload_type, payload. Both records name the
    response in `refers_to` with its URI and date; the metadata block keeps the source's headers
    (type, length, payload digest) and names the conversion; `header` is the record's header block.
    Record ids follow from the response's id, so repeated responses give repeated records.
    A null payload, URI or date counts as empty; a null record_id gives null ids but whole records;
    an empty table gives an empty result. No rows are joined or grouped.
    """
    empty = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("target_uri", "date", "payload_type", "payload")}
    rows = responses.select("record_id", "source_id", *(v.alias(k) for k, v in empty.items()))
    rows = rows.withColumns(
        {
            "text": plain_text(F.col("payload")),
            "source_digest": digest(F.col("payload")),
            "metadata_id": uuid_urn(F.concat(F.lit("metadata:"), F.col("record_id"))),
            "conversion_id": uuid_urn(F.concat(F.lit("conversion:"), F.col("record_id"))),
        }
    ).select("*", F.octet_length("payload").cast("long").alias("source_length"))
    fields = F.concat_ws(
        "\r\n",
        F.concat(F.lit("source-content-type: "), F.col("payload_type")),
        F.concat(F.lit("source-content-length: "), F.col("source_length").cast("string")),
        F.concat(F.lit("source-payload-digest: "), F.col("source_digest")),
        F.concat(F.lit("derived-conversion: "), F.coalesce(F.col("conversion_id"), F.lit(""))),
        F.lit(""),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("type"), F.col("metadata_id").alias("id"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("type"), F.col("conversion_id").alias("id"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    out = rows.select("record_id", "source_id", "target_uri", "date", F.explode(kinds).alias("r")).select(
        F.col("r.id").alias("record_id"),
        F.col("r.type").alias("warc_type"),
        "source_id",
        F.col("record_id").alias("refers_to"),
        F.col("target_uri").alias("refers_to_target_uri"),
        F.col("date").alias("refers_to_date"),
        F.col("r.content_type").alias("content_type"),
        F.octet_length("r.block").cast("long").alias("content_length"),
        digest(F.col("r.block")).alias("block_digest"),
        F.col("r.block").alias("block"),
    )
    lines = [
        ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "refers_to_date"), ("WARC-Target-URI", "refers_to_target_uri"),
        ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "refers_to_target_uri"), ("WARC-Refers-To-Date", "refers_to_date"),
        ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    ]
    header = [F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for name, c in lines]
    return out.withColumn("header", F.concat_ws("\r\n", F.lit("WARC/1.1"), *header, F.lit("\r\n")))
