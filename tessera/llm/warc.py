"""Derivatives of WARC responses: linked metadata records and plain-text conversion records.

Each response gives a metadata record (WARC-Type metadata, fields of the source's headers and of what was found) and a
conversion record with the page's plain text. Both refer to the response (WARC-Refers-To, its target URI and date)
and to each other's origin by digests: WARC-Payload-Digest is that of the source's payload, WARC-Block-Digest that of
the record's own block. A source's own identifier, digest and headers are kept. Identifiers that it lacks are derived from the target, date, payload and type, so that building again gives the same
records; a repeated page gives repeated records.

Everything is an expression of Spark SQL: one pass over the pages, no shuffle, no Python on the executors.

Plain text: comments, scripts, styles and the head's title are dropped with what they hold, block-level tags become line
feeds, other tags nothing, the five predefined entities, &nbsp;, &copy; and numeric references their characters, and runs of white space one space or line feed.
A null page has an empty text and the digest of an empty payload; a null url becomes the empty target. A row with a null
page_id is built like any other. An empty table gives an empty result. Columns other than those named aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Tags that break a line; entities by their characters, the ampersand last.
BREAKS = "p|div|br|li|ul|ol|h[1-6]|tr|table|nav|article|section|header|footer|body|html|title|pre|blockquote|form|aside|main"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&amp;", "&"))
DATE = "2024-01-01T00:00:00Z"
SPACE = "[ \\t\\f\\r\\x0b]"

#: In order: what is searched, what replaces it. Java's and RE2's expressions agree on these.
STEPS = (
    ("(?s)<!--.*?-->", ""),
    ("(?is)<script(\\s[^>]*)?>.*?</script\\s*>", ""),
    ("(?is)<style(\\s[^>]*)?>.*?</style\\s*>", ""),
    ("(?is)<title(\\s[^>]*)?>.*?</title\\s*>", ""),
    (f"(?i)</?({BREAKS})(\\s[^>]*)?/?>", "\n"),
    ("<[a-zA-Z/!][^>]*>", ""),
)


#: What follows &# in a numeric reference.
NUMBER = "^([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"


def numbered(text: Column) -> Column:
    """The text with numeric references as their characters; those of no character stay."""

    def piece(p: Column, i: Column) -> Column:
        found = F.regexp_extract(p, NUMBER, 1)
        n = F.when(found.rlike("^[xX]"), F.conv(F.substring(found, 2, 6), 16, 10)).otherwise(found).cast("int")
        valid = ((n > 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n <= 0x10FFFF))
        char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when(i == 0, p).when((found != "") & valid, F.concat(char, F.substring(p, F.length(found) + 2, F.length(p)))).otherwise(F.concat(F.lit("&#"), p))

    # most texts have none
    return F.when(F.contains(text, F.lit("&#")), F.array_join(F.transform(F.split(text, "&#"), piece), "")).otherwise(text)


def plain_text(html: Column) -> Column:
    out = html
    for search, put in STEPS:
        out = F.regexp_replace(out, search, put)
    # as the one element of an array the text so far is made once, though the expression names it three times
    out = F.transform(F.array(out), numbered)[0]
    for search, put in ENTITIES:
        out = F.replace(out, F.lit(search), F.lit(put))
    out = F.regexp_replace(out, f"{SPACE}+", " ")
    return F.regexp_replace(F.regexp_replace(out, " ?\n[ \n]*", "\n"), "^[ \n]+|[ \n]+$", "")


def title(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(html, "(?is)<title(\\s[^>]*)?>(.*?)</title\\s*>", 2), "\\s+", " "), "^ | $", "")


def sha256(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def record_id(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("\x1f", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


HEADERS = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date", "WARC-Payload-Digest", "WARC-Block-Digest", "Content-Type", "Content-Length")


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records for each response (page_id, uri, date, content_type, http_status, payload): page_id, warc_type and HEADERS as columns, and the block.

    A response may bring its own record_id, payload_digest (with its algorithm's name in front) and headers (a map): the first two
    are then what the records refer to, and the headers stand in the metadata, by their names, as they came. Where they are null or not
    columns, the id and digest are computed and there are no more headers.
    """
    given = {c: F.col(c).cast("string") if c in responses.columns else F.lit(None).cast("string") for c in ("record_id", "payload_digest")}
    headers = F.lit("")
    if "headers" in responses.columns:
        entries = F.array_sort(F.map_entries("headers"))
        lines = F.transform(entries, lambda e: F.concat(F.lit("sourceHeader: "), e["key"], F.lit(": "), F.regexp_replace(F.coalesce(e["value"].cast("string"), F.lit("")), "[\r\n]+", " "), F.lit("\r\n")))
        headers = F.coalesce(F.array_join(lines, ""), F.lit(""))
    # the expensive expressions stand in a projection of their own, below the rows' doubling
    one = responses.select(
        *(given[c].alias(f"given_{c}") for c in given), headers.alias("headers"),
        "page_id", F.coalesce("uri", F.lit("")).alias("uri"), F.coalesce("date", F.lit(DATE)).alias("date"), F.coalesce("content_type", F.lit("")).alias("content_type"), F.coalesce("http_status", F.lit(0)).alias("http_status"), F.coalesce("payload", F.lit("")).alias("payload")
    ).withColumn("payload_digest", F.coalesce("given_payload_digest", sha256(F.col("payload"))))
    one = one.withColumn("refers_to", F.coalesce("given_record_id", record_id(F.col("uri"), F.col("date"), F.col("payload_digest"), F.lit("response"))))
    blocks = F.array(
        F.struct(
            F.lit("metadata").alias("warc_type"),
            F.lit("application/warc-fields").alias("type"),
            F.concat(
                F.lit("sourceContentType: "), F.col("content_type"), F.lit("\r\nsourceStatus: "), F.col("http_status").cast("string"), F.lit("\r\nsourceLength: "), F.octet_length("payload").cast("string"),
                F.lit("\r\nsourceDigest: "), F.col("payload_digest"), F.lit("\r\ntitle: "), title(F.col("payload")), F.lit("\r\n"), F.col("headers"),
            ).alias("block"),
        ),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("type"), plain_text(F.col("payload")).alias("block")),
    )
    two = one.withColumn("made", F.explode(blocks)).select("*", "made.*").drop("made", "payload", "headers")
    return two.select(
        "page_id", "warc_type",
        record_id(F.col("uri"), F.col("date"), F.col("payload_digest"), F.col("warc_type"), F.col("given_record_id")).alias("record_id"),
        F.col("date").alias("warc_date"), F.col("uri").alias("target_uri"), F.col("refers_to"), F.col("uri").alias("refers_to_target_uri"), F.col("date").alias("refers_to_date"),
        "payload_digest", sha256(F.col("block")).alias("block_digest"), F.col("type").alias("content_type"), F.octet_length("block").cast("long").alias("content_length"), "block",
    )


def serialised(records: DataFrame) -> DataFrame:
    """page_id, record: each record in the form of a WARC/1.1 file, as binary; joined in any order they are a file."""
    values = ("warc_type", "record_id", "warc_date", "target_uri", "refers_to", "refers_to_target_uri", "refers_to_date", "payload_digest", "block_digest", "content_type", "content_length")
    head = F.concat(F.lit("WARC/1.1\r\n"), *[F.concat(F.lit(f"{h}: "), F.col(v).cast("string"), F.lit("\r\n")) for h, v in zip(HEADERS, values, strict=True)], F.lit("\r\n"))
    return records.select("page_id", F.concat(head, F.col("block"), F.lit("\r\n\r\n")).cast("binary").alias("record"))


def responses_of(pages: DataFrame) -> DataFrame:
    """Crawled pages (page_id, url, html) as responses."""
    return pages.select("page_id", F.col("url").alias("uri"), F.lit(DATE).alias("date"), F.lit("text/html; charset=utf-8").alias("content_type"), F.lit(200).alias("http_status"), F.col("html").alias("payload"))


def op1_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    return derivatives(responses_of(table(spark, sf_dir, "pages")))


def _sql(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle() -> str:
    """DuckDB's SQL, by its own functions and RE2."""
    text = "payload"
    for search, put in STEPS:
        text = f"regexp_replace({text}, {_sql(search)}, {_sql(put)}, 'g')"
    found = f"regexp_extract(p, '{NUMBER}', 1)"
    n = f"try_cast(case when {found}[1] in ('x', 'X') then '0x' || {found}[2:] else {found} end as bigint)"
    text = f"array_to_string(list_transform(string_split({text}, '&#'), lambda p, i: case when i = 1 then p when {found} <> '' and ({n} between 1 and 55295 or {n} between 57344 and 1114111) then chr({n}::integer) || substr(p, length({found}) + 2) else '&#' || p end), '')"
    for search, put in ENTITIES:
        text = f"replace({text}, {_sql(search)}, {_sql(put)})"
    for search, put in ((f"{SPACE}+", " "), (" ?\\n[ \\n]*", "\n"), ("^[ \\n]+|[ \\n]+$", "")):
        text = f"regexp_replace({text}, {_sql(search)}, {_sql(put)}, 'g')"
    head = "regexp_replace(regexp_replace(regexp_extract(payload, '(?is)<title(\\s[^>]*)?>(.*?)</title\\s*>', 2), '\\s+', ' ', 'g'), '^ | $', '', 'g')"
    uuid = lambda kind: f"(select '<urn:uuid:' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) || '>' from (select md5(target_uri || chr(31) || '{DATE}' || chr(31) || payload_digest || chr(31) || {kind}) as m))"
    return f"""
with p as (select page_id, coalesce(url, '') as target_uri, coalesce(html, '') as payload, 'sha256:' || sha256(coalesce(html, '')) as payload_digest from pages),
r as (
    select page_id, target_uri, payload_digest, 'metadata' as warc_type, 'application/warc-fields' as content_type,
        'sourceContentType: text/html; charset=utf-8' || chr(13) || chr(10) || 'sourceStatus: 200' || chr(13) || chr(10) || 'sourceLength: ' || strlen(payload)::varchar || chr(13) || chr(10)
        || 'sourceDigest: ' || payload_digest || chr(13) || chr(10) || 'title: ' || {head} || chr(13) || chr(10) as block from p
    union all
    select page_id, target_uri, payload_digest, 'conversion', 'text/plain; charset=utf-8', {text} from p
)
select page_id, warc_type, {uuid('warc_type')} as record_id, '{DATE}' as warc_date, target_uri, {uuid("'response'")} as refers_to, target_uri as refers_to_target_uri, '{DATE}' as refers_to_date,
    payload_digest, 'sha256:' || sha256(block) as block_digest, content_type, strlen(block)::bigint as content_length, block
from r
"""


ORACLE = {"op1_warc_derivatives": oracle()}
