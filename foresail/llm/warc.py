"""WARC derivatives: metadata and plain-text conversion records for response records, in DataFrame functions but for entities."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CRLF = "\r\n"
#: What is taken from the HTML, in order, as the SQL says it: comments and invisible elements go, block elements end
#: lines, other tags go.  On unclosed tags these patterns read to the end from each; `without_tags` does the same in
#: one pass a step.
TAG_STEPS: tuple[tuple[str, str], ...] = (
    ("(?s)<!--.*?-->", ""),
    ("(?is)<script[^>]*>.*?</script[^>]*>", ""),
    ("(?is)<style[^>]*>.*?</style[^>]*>", ""),
    ("(?i)</?(p|br|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|footer|header|title|body|head)( [^>]*|/)?>", "\n"),
    ("<[^>]*>", ""),
)
#: The entities that the SQL knows; the ampersand is last, so that nothing is decoded twice.
ENTITIES: tuple[tuple[str, str], ...] = (
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
)
SPACE_STEPS: tuple[tuple[str, str], ...] = (("[ \t\r\f]+", " "), (" ?\n ?", "\n"), ("\n+", "\n"), ("^[ \n]+|[ \n]+$", ""))


#: What HTML5 may read as a reference, and, of that, what ends in a semicolon.
_ANY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]{0,31});")


def _decoded(reference: str) -> str:
    if len(reference) > 40 and reference[1] == "#":  # no such character, and too long a number to read
        base = 3 if reference[2] in "xX" else 2
        number = reference[base:].rstrip(";").lstrip("0")
        if len(number) > 12:
            return "\ufffd"
        reference = f"{reference[:base]}{number or '0'};"
    made = unescape(reference)
    return " " + made[1:] if made[0:1] == "\xa0" else made  # a no-break space counts as space


@lru_cache(maxsize=1 << 14)
def _any(reference: str) -> str:
    return _decoded(reference)


@lru_cache(maxsize=1 << 14)
def _closed(reference: str) -> str:
    return _decoded(reference) if reference[1] == "#" or reference[1:] in html5 else reference


@F.arrow_udf(StringType())
def decode_all(column: pa.Array) -> pa.Array:
    """Texts with the character references that HTML5 knows decoded once: all numbers and names, some of them without a semicolon."""
    return pa.array([_ANY.sub(lambda m: _any(m[0]), x) if x and "&" in x else x for x in column.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def decode_closed(column: pa.Array) -> pa.Array:
    """As `decode_all`, of the references that end in a semicolon."""
    return pa.array([_CLOSED.sub(lambda m: _closed(m[0]), x) if x and "&" in x else x for x in column.to_pylist()], pa.string())


def _until_close(html: Column) -> tuple[Column, Column]:
    """html up to its last `>`, in which every `<` is closed, and what is behind it."""
    tail = F.substring_index(html, ">", -1)
    return F.left(html, F.char_length(html) - F.char_length(tail)), tail


def without_tags(html: Column) -> Column:
    """As the TAG_STEPS do, in time proportional to the length of html.

    What isn't closed by the end makes the second alternative take all that is left, and put it back: nothing behind
    it can be closed either.  An end tag is looked for once, as the first one found is closed if any later one is.
    Looking ahead for the start keeps places that begin nothing cheap.
    """
    html = F.regexp_replace(html, "(?s)(?=<!--)(?:<!--.*?-->|(.*))", "$1")
    for name in ("script", "style"):
        html = F.regexp_replace(html, f"(?is)(?=<{name})(?:<{name}[^>]*+>(?>.*?</{name})[^>]*+>|(.*))", "$1")
    head, tail = _until_close(html)
    html = F.concat(F.regexp_replace(head, *TAG_STEPS[3]), tail)
    return F.regexp_replace(html, "(?s)(?=<)(?:<[^>]*+>|(.*))", "$1")


def _first_found(html: Column, pattern: str) -> Column:
    """Group 1 of the first match where it isn't empty; empty if there is none.  Most pages need their first match only."""
    one = F.regexp_extract(html, pattern, 1)
    later = F.get(F.filter(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda x: x != ""), F.lit(0))
    return F.when(one != "", one).otherwise(F.coalesce(later, F.lit("")))


def first_title(html: Column) -> Column:
    """What is in the first title element that has text only; empty if there is none."""
    found = _first_found(_until_close(html)[0], "(?i)<title[^>]*+>(?:([^<]*+</title>))?")
    return F.regexp_replace(found, "(?i)</title>$", "")


def first_language(html: Column) -> Column:
    """The last `lang` of the first html tag that has one; empty if there is none."""
    return F.rtrim(_first_found(html, '(?i)<html(?:[^>]* lang="([^"]*+")|[^>]*+)'), F.lit('"'))


def html_text(html: Column, sql_form: bool = False) -> Column:
    """The visible text of a page, a line for each block."""
    html = without_tags(html)
    html = (decode_closed if sql_form else decode_all)(html)
    # the SPACE_STEPS, without the matches that change nothing
    for pattern, by in (("[ \t\r\f]{2,}|[\t\r\f]", " "), (" \n ?|\n ", "\n"), ("\n{2,}", "\n")):
        html = F.regexp_replace(html, pattern, by)
    return F.btrim(html, F.lit(" \n"))


def _sha(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def _urn(digest: Column) -> Column:
    """A name-based record id from the first 32 hex digits of a digest."""
    cut = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records (record_id, target_uri, warc_date, http_headers, payload, payload_digest) of a page table."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    uri = F.coalesce(F.col(url).cast("string"), F.lit(""))
    key = F.concat_ws("\n", F.lit("response"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), uri, _sha(payload))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit(CRLF),
    )
    return pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        _urn(_sha(key)).alias("record_id"),
        uri.alias("target_uri"),
        F.lit(date).alias("warc_date"),
        head.alias("http_headers"),
        payload.alias("payload"),
        F.concat(F.lit("sha256:"), _sha(payload)).alias("payload_digest"),
    )


def header(name: str, at: Column) -> Column:
    """The value of a header line; empty if there is none."""
    return F.regexp_extract(at, rf"(?i)(?:^|\n){name}: *([^\r\n]*)", 1)


def derivatives(df: DataFrame, sql_form: bool = False) -> DataFrame:
    """Two records for each response: `metadata` (application/warc-fields) and `conversion` (text/plain).

    Both name the response in WARC-Refers-To, and its target URI and date; the metadata block preserves the
    source's content type, length and payload digest, and links to the conversion.  Record ids are digests of
    the response's id and the type, so that a run that is repeated gives the same records.  `record` is the
    whole record as written to a file.  Null fields of a response count as empty strings; an empty payload gives
    an empty conversion; repeated responses give repeated records; an empty table gives none.

    Character references are decoded in text and title.  The SQL of op8 leaves those without a semicolon, and all in
    the title, as they are written; so does `sql_form`.
    """
    title = first_title(F.coalesce(F.col("payload").cast("string"), F.lit("")))
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = df.select(
        "page_id",
        *[empty(c).alias(c) for c in ("record_id", "target_uri", "warc_date", "http_headers", "payload_digest")],
        F.octet_length(empty("payload")).alias("source_bytes"),
        html_text(empty("payload"), sql_form).alias("plain"),
        F.regexp_replace(title if sql_form else decode_all(title), "[\r\n]+", " ").alias("title"),
        first_language(empty("payload")).alias("lang"),
    )
    urn = lambda kind: _urn(_sha(F.concat_ws("\n", F.lit(kind), F.col("record_id"))))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    fields = F.concat(
        line("title", F.col("title")),
        line("language", F.col("lang")),
        line("source-content-type", header("Content-Type", F.col("http_headers"))),
        line("source-content-length", header("Content-Length", F.col("http_headers"))),
        line("source-payload-digest", F.col("payload_digest")),
        line("conversion", urn("conversion")),
    )
    made = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), urn("metadata").alias("id"), F.lit("application/warc-fields").alias("type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), urn("conversion").alias("id"), F.lit("text/plain; charset=utf-8").alias("type"), F.col("plain").alias("block")),
    )
    rows = source.select("page_id", "record_id", "target_uri", "warc_date", "payload_digest", F.explode(made).alias("m"))
    block = F.col("m.block")
    digest = F.concat(F.lit("sha256:"), _sha(block))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("m.warc_type")),
        line("WARC-Record-ID", F.col("m.id")),
        line("WARC-Refers-To", F.col("record_id")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("warc_date")),
        line("WARC-Block-Digest", digest),
        line("Content-Type", F.col("m.type")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
        F.lit(CRLF + CRLF),
    )
    return rows.select(
        "page_id",
        F.col("m.warc_type").alias("warc_type"),
        F.col("m.id").alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        F.col("payload_digest").alias("source_digest"),
        F.octet_length(block).cast("long").alias("block_bytes"),
        digest.alias("block_digest"),
        record.alias("record"),
    )


def derivative_digests(pages: DataFrame) -> DataFrame:
    """The derivatives of a page table with the digest of each whole record in place of the record."""
    made = derivatives(responses(pages), sql_form=True)
    return made.withColumn("record_sha256", _sha(F.col("record"))).drop("record")


def oracle() -> str:
    """DuckDB SQL for `derivative_digests` over the view `pages`."""
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def esc(s: str) -> str:
        return "".join(f"'||chr({ord(c)})||'" if c in "\r\n\t\f" else ("''" if c == "'" else c) for c in s)

    s = lambda x: "('" + esc(x) + "')"
    text = "payload"
    for pattern, by in TAG_STEPS:
        text = f"regexp_replace({text}, {s(pattern)}, {s(by)}, 'g')"
    for name, by in ENTITIES:
        text = f"replace({text}, {q(name)}, {q(by)})"
    for pattern, by in SPACE_STEPS:
        text = f"regexp_replace({text}, {s(pattern)}, {s(by)}, 'g')"
    urn = lambda x: f"('<urn:uuid:'||substr({x},1,8)||'-'||substr({x},9,4)||'-'||substr({x},13,4)||'-'||substr({x},17,4)||'-'||substr({x},21,12)||'>')"
    crlf = "chr(13)||chr(10)"
    return f"""
WITH p AS (SELECT CAST(page_id AS BIGINT) page_id, coalesce(url,'') target_uri, coalesce(html,'') payload FROM pages),
r AS (SELECT *, sha256(payload) psha, sha256('response'||chr(10)||coalesce(CAST(page_id AS VARCHAR),'')||chr(10)||target_uri||chr(10)||sha256(payload)) rsha,
  strlen(payload) nbytes, {text} plain,
  regexp_replace(regexp_extract(payload, '(?i)<title[^>]*>([^<]*)</title>', 1), {s("[" + CRLF + "]+")}, ' ', 'g') title,
  regexp_extract(payload, '(?i)<html[^>]* lang="([^"]*)"', 1) lang FROM p),
i AS (SELECT *, {urn("rsha")} rid FROM r),
j AS (SELECT *, sha256('metadata'||chr(10)||rid) msha, sha256('conversion'||chr(10)||rid) csha FROM i),
k AS (SELECT *, {urn("msha")} mid, {urn("csha")} cid FROM j),
l AS (SELECT *, 'title: '||title||{crlf}||'language: '||lang||{crlf}||'source-content-type: text/html; charset=utf-8'||{crlf}
  ||'source-content-length: '||nbytes||{crlf}||'source-payload-digest: sha256:'||psha||{crlf}||'conversion: '||cid||{crlf} fields FROM k),
u AS (SELECT page_id, 'metadata' warc_type, mid record_id, rid refers_to, target_uri, psha, fields block, 'application/warc-fields' ctype FROM l
  UNION ALL SELECT page_id, 'conversion', cid, rid, target_uri, psha, plain, 'text/plain; charset=utf-8' FROM l)
SELECT page_id, warc_type, record_id, refers_to, target_uri, 'sha256:'||psha AS source_digest, CAST(strlen(block) AS BIGINT) AS block_bytes,
  'sha256:'||sha256(block) AS block_digest,
  sha256('WARC/1.1'||{crlf}||'WARC-Type: '||warc_type||{crlf}||'WARC-Record-ID: '||record_id||{crlf}||'WARC-Refers-To: '||refers_to||{crlf}
  ||'WARC-Target-URI: '||target_uri||{crlf}||'WARC-Date: 2024-01-01T00:00:00Z'||{crlf}||'WARC-Block-Digest: sha256:'||sha256(block)||{crlf}
  ||'Content-Type: '||ctype||{crlf}||'Content-Length: '||strlen(block)||{crlf}||{crlf}||block||{crlf}||{crlf}) AS record_sha256
FROM u"""
