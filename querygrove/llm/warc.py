"""WARC derivatives: metadata and plain-text conversion records of responses.

Every response record gives two records that name it in WARC-Refers-To: a
metadata record of its source headers and digests, and a conversion record of
its text.  Identifiers are made from the source record's identifier, so that a
second run gives the same records and a lost task is simply run again.

Null urls and bodies are empty; a page without text has an empty conversion.
Repeated rows give repeated records.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE = "2026-01-01T00:00:00Z"


def _uuid(name: Column) -> Column:
    h = F.md5(name)
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4)) for x in (
        F.substring(h, a, n), F.lit("-"))], F.substring(h, 21, 12), F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def plain_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags out, common entities decoded, blanks folded."""
    t = F.coalesce(html, F.lit(""))
    for pattern, new in (("(?is)<script[^>]*>.*?</script>", " "), ("(?is)<style[^>]*>.*?</style>", " "),
                         ("(?s)<!--.*?-->", " "),
                         ("(?i)<(?:/p|br|/h[1-6]|/li|/div|/article|/title|/footer)[^>]*>", "\n"), ("<[^>]*>", ""),
                         ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
                         ("[ \\t\\r]+", " "), (" ?\\n[ \\n]*", "\n"), ("^[ \\n]+|[ \\n]+$", "")):
        t = F.regexp_replace(t, pattern, new)
    return t


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
              date: str = DATE) -> DataFrame:
    """Response records of fetched pages: page_id, record_id, target_uri, date, headers, payload, payload_digest."""
    p = pages.select(F.col(page_id).alias("page_id"), F.coalesce(url, F.lit("")).alias("target_uri"),
                     F.coalesce(html, F.lit("")).alias("payload"))
    return p.select("page_id", _uuid(F.concat_ws("|", F.lit("response"), F.coalesce(F.col("page_id").cast("string"),
                                                                                  F.lit("")), "target_uri")).alias("record_id"),
                    "target_uri", F.lit(date).alias("date"),
                    F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                             F.octet_length("payload").cast("string")).alias("headers"),
                    "payload", _digest(F.col("payload")).alias("payload_digest"))


def derivatives(sources: DataFrame) -> DataFrame:
    """Two records for each response; ``record`` is the whole record, ready to be written."""
    s = sources.withColumn("made", F.explode(F.array(
        F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("content_type"), F.concat(
            F.lit("source-record: "), "record_id", F.lit("\r\nsource-payload-digest: "), "payload_digest",
            F.lit("\r\nsource-length: "), F.octet_length("payload").cast("string"), F.lit("\r\nsource-header: "),
            F.regexp_replace("headers", "\r\n", "\r\nsource-header: "), F.lit("\r\n")).alias("block")),
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain; charset=utf-8").alias("content_type"),
                 plain_text(F.col("payload")).alias("block")))))
    out = s.select("page_id", F.col("made.kind").alias("record_type"),
                   _uuid(F.concat_ws("|", "made.kind", "record_id")).alias("record_id"),
                   F.col("record_id").alias("refers_to"), "target_uri", "date",
                   F.col("made.content_type").alias("content_type"), F.col("made.block").alias("block"))
    out = out.select("*", _digest(F.col("block")).alias("block_digest"),
                     F.octet_length("block").cast("long").alias("content_length"))
    def line(name, c):
        return [F.lit(f"\r\n{name}: "), F.col(c).cast("string")]
    header = F.concat(F.lit("WARC/1.1"), *line("WARC-Type", "record_type"), *line("WARC-Record-ID", "record_id"),
                      *line("WARC-Refers-To", "refers_to"), *line("WARC-Target-URI", "target_uri"),
                      *line("WARC-Date", "date"), *line("WARC-Block-Digest", "block_digest"),
                      *line("Content-Type", "content_type"), *line("Content-Length", "content_length"))
    return out.withColumn("record", F.concat(header, F.lit("\r\n\r\n"), "block"))


def write(records: DataFrame, path: str) -> None:
    """WARC files: each record is followed by two line ends, as the format asks."""
    records.select("record").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def digest(pages: DataFrame) -> DataFrame:
    """The derivative records of all pages, with the digest of each whole record in place of its bytes."""
    return derivatives(responses(pages)).select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "content_length", "block_digest",
        F.sha2("record", 256).alias("record_sha256"), F.col("block").alias("text"))
