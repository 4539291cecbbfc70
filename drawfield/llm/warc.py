"""WARC derivatives: a metadata and a plain-text conversion record for every response.

A response keeps its record id, target, date, source headers and payload digest. Each derivative refers to it
(``WARC-Refers-To``, ``-Target-URI``, ``-Date``), the metadata record repeats the source headers and the
payload digest, and each record carries the digest of its own block. Ids are derived from the
response's, so a repeated run gives the same records. All of it is text functions: no shuffle.

Null html is an empty payload, a null url an empty target; both still give two records. Repeated rows
give repeated records. Very long pages are converted whole, malformed ones in linear time too: what is not
closed reaches to the end of the page. Extra columns are not read.
"""

from html import unescape
from html.entities import name2codepoint

from pyspark.sql import functions as F

from drawfield.llm.common import query, table

CRLF = "\r\n"
DATE = "2026-01-01T00:00:00Z"  # the table of pages has no dates

# Elements whose content is not text, and elements that end a line.
UNSEEN = ("script", "style", "noscript", "template", "title")
BREAKS = "address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tr|ul"
#: The names of HTML 4 and ``&apos;``, with the letters that the standard library gives them.
NAMED = {**{name: unescape(f"&{name};") for name in (*name2codepoint, "apos")}, "nbsp": " "}

# The rest of a tag after its name: a ">" inside a quoted value does not end it (up to 32 values; then any does), the page's end does.
_REST = """[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*){0,32}(?:>|\\z)"""
#: One pass from left to right. What is not closed goes on to the end of the page, so each letter is read once.
HIDDEN = "(?is)<(?:!--.*?(?:-->|\\z)|" + "|".join(
    f"{name}(?:[\\s/]{_REST}|>).*?(?:</{name}[^>]*(?:>|\\z)|\\z)" for name in UNSEEN) + ")"
LINE_ENDS = f"(?i)</?(?:{BREAKS})(?:[\\s/]{_REST}|>)"
TAGS = f"<[A-Za-z/!?](?:{_REST}|[^>]*(?:>|\\z))"
REFERENCE = "^(?:#([0-9]{1,7})|#[xX]([0-9A-Fa-f]{1,6})|([A-Za-z][A-Za-z0-9]{1,8}));"


def uuid_of(text):
    """A record id made from a text: ``<urn:uuid:...>``."""
    h = F.md5(text)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def digest(text):
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def plain_text(html):
    """Text of a page: comments and unseen elements go, block elements end lines, references are decoded.

    A comment, unseen element or tag that is not closed reaches to the end of the page.
    """
    text = F.regexp_replace(html, HIDDEN, " ")
    text = F.regexp_replace(text, LINE_ENDS, "\n")
    text = F.regexp_replace(text, TAGS, "")
    # Bound to a name, so that it is computed once.
    text = F.get(F.transform(F.array(text), lambda t: F.when(F.contains(t, F.lit("&")), decoded(t)).otherwise(t)), F.lit(0))
    text = F.regexp_replace(text, "[ \\t\\r\\f]+", " ")
    text = F.regexp_replace(text, " ?\\n[ \\n]*", "\n")
    return F.regexp_replace(text, "^[ \\n]+|[ \\n]+$", "")


def decoded(text):
    """``&name;``, ``&#233;`` and ``&#xe9;`` as letters, once, from left to right; unknown ones stay as they are."""
    names = F.map_from_arrays(F.array(*map(F.lit, NAMED)), F.array(*map(F.lit, NAMED.values())))

    def found(part):
        return F.struct(part.alias("part"), *[F.regexp_extract(part, REFERENCE, i).alias(n) for i, n in ((1, "number"), (2, "hexadecimal"), (3, "name"))])

    def coded(ref):  # each step is bound to a name, so that it is computed once
        code = F.when(ref["number"] != "", ref["number"].cast("int")).when(
            ref["hexadecimal"] != "", F.conv(ref["hexadecimal"], 16, 10).cast("int"))
        return F.struct(ref["part"].alias("part"), ref["name"].alias("name"), code.alias("code"))

    def letter(ref):
        code = ref["code"]
        sign = (F.when(ref["name"] != "", F.try_element_at(names, ref["name"]))
                .when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))
        return F.struct(ref["part"].alias("part"), sign.alias("sign"))

    def written(ref):
        part = ref["part"]
        return F.when(ref["sign"].isNull(), F.concat(F.lit("&"), part)).otherwise(
            F.concat(ref["sign"], F.substr(part, F.instr(part, ";") + 1)))

    parts = F.split(text, "&")
    refs = F.transform(F.transform(F.transform(F.slice(parts, 2, 1 << 30), found), coded), letter)
    return F.concat(F.element_at(parts, 1), F.array_join(F.transform(refs, written), ""))


def responses(pages):
    """Response records of a page table: ``page_id``, ``record_id``, ``target_uri``, ``date``, ``headers``,
    ``payload``, ``payload_digest``."""
    payload, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF
                             + "Content-Length: "), F.octet_length(payload).cast("string"))
    return pages.select(
        "page_id", uuid_of(F.concat(F.lit("response "), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                                    F.lit(" "), url)).alias("record_id"),
        url.alias("target_uri"), F.lit(DATE).alias("date"), headers.alias("headers"), payload.alias("payload"),
        digest(payload).alias("payload_digest"))


def derive(source):
    """Two rows per response: ``record_type`` (``metadata``, ``conversion``), ``record_id``, ``refers_to``,
    ``target_uri``, ``date``, ``content_type``, ``content_length``, ``block_digest``, ``payload_digest``, ``block``."""
    about = F.concat(F.lit("source-payload-digest: "), F.col("payload_digest"), F.lit(CRLF + "source-headers:" + CRLF + " "),
                     F.replace("headers", F.lit(CRLF), F.lit(CRLF + " ")), F.lit(CRLF))
    both = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"),
                 about.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"),
                 plain_text(F.col("payload")).alias("block")))
    rows = source.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest",
                         F.inline(both))
    return rows.select(
        "page_id", "record_type", uuid_of(F.concat("record_type", F.lit(" "), "refers_to")).alias("record_id"),
        "refers_to", "target_uri", "date", "content_type",
        F.octet_length("block").cast("long").alias("content_length"), digest(F.col("block")).alias("block_digest"),
        "payload_digest", "block")


def as_text(records):
    """Each record as it stands in a file, one text column."""
    lines = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"),
             ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "date"),
             ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"),
             ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    head = [F.concat(F.lit(f"{name}: "), F.col(column).cast("string"), F.lit(CRLF)) for name, column in lines]
    return records.select(F.concat(F.lit("WARC/1.1" + CRLF), *head, F.lit(CRLF), "block").alias("value"))


def write_warc(records, path):
    """WARC files: records follow each other with two line ends between, as the format wants."""
    as_text(records).write.option("lineSep", CRLF + CRLF).text(path)


def _plain_sql():
    def quoted(pattern):
        return pattern.replace("'", "''")
    text = f"regexp_replace(payload, '{quoted(HIDDEN)}', ' ', 'g')"
    text = f"regexp_replace({text}, '{quoted(LINE_ENDS)}', chr(10), 'g')"
    text = f"regexp_replace({text}, '{quoted(TAGS)}', '', 'g')"
    code = (f"coalesce(TRY_CAST(nullif(regexp_extract(x, '{REFERENCE}', 1), '') AS INTEGER), "
            f"TRY_CAST(nullif('0x' || regexp_extract(x, '{REFERENCE}', 2), '0x') AS INTEGER))")
    names = "MAP {" + ", ".join(f"'{n}': chr({ord(c)})" for n, c in NAMED.items()) + "}"
    sign = (f"coalesce(CASE WHEN {code} BETWEEN 1 AND 1114111 AND {code} NOT BETWEEN 55296 AND 57343 THEN chr({code}) END, "
            f"({names})[regexp_extract(x, '{REFERENCE}', 3)])")
    parts = f"string_split({text}, '&')"
    text = (f"(SELECT p[1] || array_to_string([coalesce({sign} || regexp_replace(x, '{REFERENCE}', ''), '&' || x) FOR x IN p[2:]], '') "
            f"FROM (SELECT {parts} AS p))")
    text = f"regexp_replace({text}, '[ \\t\\r\\f]+', ' ', 'g')"
    text = f"regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"regexp_replace({text}, '^[ \\n]+|[ \\n]+$', '', 'g')"


def _uuid_sql(text):
    cuts = " || '-' || ".join(f"substr(md5({text}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || {cuts} || '>'"


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, coalesce(url, '') AS target_uri FROM pages),
r AS (SELECT *, {_uuid_sql("'response ' || coalesce(CAST(page_id AS VARCHAR), '') || ' ' || target_uri")} AS refers_to,
             'sha256:' || sha256(payload) AS payload_digest FROM p),
b AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
         'source-payload-digest: ' || payload_digest || chr(13) || chr(10) || 'source-headers:' || chr(13) || chr(10)
         || ' HTTP/1.1 200 OK' || chr(13) || chr(10) || ' Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
         || ' Content-Length: ' || strlen(payload) || chr(13) || chr(10) AS block FROM r
  UNION ALL
  SELECT *, 'conversion', 'text/plain; charset=utf-8', {_plain_sql()} FROM r)
SELECT page_id, record_type, {_uuid_sql("record_type || ' ' || refers_to")} AS record_id, refers_to, target_uri,
       content_type, CAST(strlen(block) AS BIGINT) AS content_length, payload_digest, 'sha256:' || sha256(block) AS block_digest
FROM b
"""


@query("op3_warc", SQL)
def op3_warc(spark, sf_dir):
    return derive(responses(table(spark, sf_dir, "pages"))).select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "content_type", "content_length",
        "payload_digest", "block_digest")
