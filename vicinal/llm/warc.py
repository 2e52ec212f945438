"""WARC derivatives: a metadata and a plain-text conversion record for each response record.

Responses come from WARC files (`responses`) or from any table of pages. Both derivatives refer to the response by its identifier (WARC-Refers-To), repeat its target, date and HTTP headers,
and carry digests of their own block and of the payload they were made from. Pages are read by a tokenizer that
goes through them once. Identifiers are name-based
(SHA-1 of what the record is made of), so a task that runs again makes the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: RFC 4122's namespace for URLs
#: Shown where a page table has no capture date.
NO_DATE = "1970-01-01T00:00:00Z"

#: Elements that start lines; elements whose content is not shown and ends at their own end tag only.
BLOCK = frozenset(
    "address article aside blockquote body br dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = {x: re.compile(rf"</{x}\s*+>", re.I) for x in ("script", "style", "noscript", "template")}
_TITLE_END = re.compile(r"</title\s*+>", re.I)
_TAG = re.compile(r"<(/?)([A-Za-z][^\s<>/]*+)([^<>]*+)>")
_DECLARATION = re.compile(r"<[!?][^<>]*+>")
_VALUE = r"\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))"
_HREF, _LANG = re.compile(rf"(?<![^\s\"'/])href{_VALUE}", re.I), re.compile(rf"(?<![^\s\"'/])lang{_VALUE}", re.I)
_SPACE = re.compile(r"[^\S\n]++")


def read_page(page: str) -> dict:
    """title, lang, outlinks and text of a page, in one pass over its tags.

    The text is the first title and what else is shown, as lines: comments, declarations, CDATA sections and
    raw elements are left out, block elements start lines, character references are resolved after the tags
    are gone, white space is collapsed, blank lines are dropped. A comment, CDATA section or raw element that
    never ends hides the rest; a title that never ends is ordinary text. No character is looked at more often
    than a fixed number of times, whatever is left open.
    """
    title, lang, links, out = None, "", [], []
    at, n, no_title = 0, len(page), False
    while at < n:
        i = page.find("<", at)
        i = n if i < 0 else i
        out.append(page[at:i])
        if i == n:
            break
        after = page[i + 1 : i + 2]
        if after in ("!", "?"):
            ends = "-->" if page.startswith("<!--", i) else "]]>" if page.startswith("<![CDATA[", i) else None
            if ends:
                j = page.find(ends, i + (4 if ends == "-->" else 9))
                at = n if j < 0 else j + 3
                out.append(" ")
                continue
            m = _DECLARATION.match(page, i)
            out.append(" " if m else "<")
            at = m.end() if m else i + 1
            continue
        m = _TAG.match(page, i)
        if not m:
            out.append("<")
            at = i + 1
            continue
        closing, name, rest = m.group(1), m.group(2).lower(), m.group(3)
        at = m.end()
        if not closing and name in RAW:
            found = RAW[name].search(page, at)
            at = found.end() if found else n
            out.append(" ")
            continue
        if not closing and name == "title" and title is None and not no_title:
            found = _TITLE_END.search(page, at)
            if found:
                title = _without_tags(page[at : found.start()])
                at = found.end()
                out.append("\n")
                continue
            no_title = True
        if not closing and name == "a" and (v := _HREF.search(rest)):
            links.append(html.unescape(v.group(1) or v.group(2) or v.group(3) or ""))
        if not closing and name == "html" and not lang and (v := _LANG.search(rest)):
            lang = v.group(1) or v.group(2) or v.group(3) or ""
        if name in BLOCK:
            out.append("\n")
    body = html.unescape("".join(out))
    heading = html.unescape(title or "")
    text = heading + "\n" + body
    return {
        "title": " ".join(heading.split()),
        "lang": lang,
        "outlinks": links,
        "text": "\n".join(x for line in text.split("\n") if (x := _SPACE.sub(" ", line).strip())),
    }


def _without_tags(text: str) -> str:
    return _TAG.sub("", text)


def plain_text(page: str) -> str:
    return read_page(page)["text"]


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(31).join(parts))}>"


def derive(target: str, date: str, headers: str, payload: str, response_id: str = "") -> list[dict]:
    """The metadata and the conversion record of one response."""
    source = payload.encode("utf-8", "surrogatepass")
    payload_digest = digest(source)
    response_id = response_id or record_id("response", target, date, payload_digest)
    found = read_page(payload)
    fields = [f"{k}: {found[k]}" for k in ("title", "lang") if found[k]] + [f"outlink: {x}" for x in found["outlinks"]]
    blocks = {
        "metadata": ("application/warc-fields", "\r\n".join(re.sub(r"[\r\n]+", " ", x) for x in fields) + "\r\n"),
        "conversion": ("text/plain; charset=utf-8", found["text"]),
    }
    out = []
    for kind, (content_type, text) in blocks.items():
        block = text.encode("utf-8", "surrogatepass")
        own = record_id(kind, response_id)
        out.append(
            {
                "warc_type": kind,
                "record_id": own,
                "refers_to": response_id,
                "target_uri": target,
                "date": date,
                "content_type": content_type,
                "source_headers": headers,
                "payload_digest": payload_digest,
                "block_digest": digest(block),
                "n_bytes": len(block),
                "block": text,
            }
        )
    # the two know each other
    for a, b in (out, out[::-1]):
        a["concurrent_to"] = b["record_id"]
    return out


def serialise(record: dict) -> bytes:
    """A record in the WARC/1.1 format. The source's HTTP headers travel as one JSON-quoted field."""
    block = record["block"].encode("utf-8", "surrogatepass")
    head = [
        ("WARC-Type", record["warc_type"]),
        ("WARC-Record-ID", record["record_id"]),
        ("WARC-Refers-To", record["refers_to"]),
        ("WARC-Concurrent-To", record["concurrent_to"]),
        ("WARC-Target-URI", record["target_uri"]),
        ("WARC-Date", record["date"]),
        ("WARC-Payload-Digest", record["payload_digest"]),
        ("WARC-Block-Digest", record["block_digest"]),
        ("X-Source-HTTP-Headers", json.dumps(record["source_headers"])),
        ("Content-Type", record["content_type"]),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


FIELDS = ["warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type", "source_headers", "payload_digest", "block_digest"]


def derivatives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    date_col: str | None = None, headers_col: str | None = None, response_col: str | None = None, blocks: bool = True,
) -> DataFrame:
    """Two rows per row of pages: id_col, the fields of a record, n_bytes and, with blocks, the block and
    the serialised record.

    Null payloads, targets and headers are empty, a null or missing date is NO_DATE, headers are not made up;
    without response_col a response's identifier follows from its content, so repeated rows give repeated
    records. One pass without a shuffle; one page is held at a time. Other
    columns are not read; an empty table gives no rows.
    """
    columns = [F.col(id_col).alias("id"), F.coalesce(url_col, F.lit("")).alias("url"), F.coalesce(html_col, F.lit("")).alias("html")]
    columns += [(F.coalesce(c, F.lit("")) if c else F.lit("")).alias(n) for c, n in ((date_col, "date"), (headers_col, "headers"), (response_col, "response"))]
    kind = pages.schema[id_col].dataType.simpleString()
    names = ["id", *FIELDS, "n_bytes", *(["block", "record"] if blocks else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows = batch.slice(at, 500), []
                for key, url, page, date, headers, response in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for r in derive(url, date or NO_DATE, headers, page, response):
                        extra = (r["block"], serialise(r)) if blocks else ()
                        rows.append((key, *(r[k] for k in FIELDS), r["n_bytes"], *extra))
                types = [part.schema.field("id").type, *[pa.string()] * len(FIELDS), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names)

    schema = f"id {kind}, " + ", ".join(f"{k} string" for k in FIELDS) + ", n_bytes long" + (", block string, record binary" if blocks else "")
    return pages.select(columns).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of a WARC file, plain or gzip-compressed. What is not a
    record, and a record cut short, ends it."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            return
        fields: dict[str, str] = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if colon:
                fields.setdefault(name.strip().lower(), value.strip())
        size = fields.get("content-length", "")
        if not size.isdecimal() or end + 4 + int(size) > len(data):
            return
        at = end + 4 + int(size)
        yield fields, data[end + 4 : at]


def split_response(block: bytes) -> tuple[str, str]:
    """HTTP headers (with the blank line) and payload as text, by the charset that the headers name, else
    UTF-8; bytes that are wrong in it give U+FFFD. Chunked and gzip-compressed bodies are opened."""
    end = block.find(b"\r\n\r\n")
    end = len(block) if end < 0 else end + 4
    headers, body = block[:end].decode("latin-1"), block[end:]
    if re.search(r"^transfer-encoding:.*\bchunked\b", headers, re.I | re.M):
        body = _unchunked(body)
    if re.search(r"^content-encoding:\s*(?:x-)?gzip\b", headers, re.I | re.M):
        try:
            body = gzip.decompress(body)
        except (OSError, EOFError):
            body = b""
    found = re.search(r"^content-type:[^\n]*?\bcharset=[\"']?([\w.:-]+)", headers, re.I | re.M)
    try:
        return headers, body.decode(found.group(1) if found else "utf-8", "replace")
    except LookupError:
        return headers, body.decode("utf-8", "replace")


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = re.match(rb"[0-9A-Fa-f]{1,15}", body[at:end])
        n = int(size.group(), 16) if size else 0
        if not n:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


RESPONSE = "url string, date string, headers string, html string, response_id string"


def responses(files: DataFrame, content_col: str = "content") -> DataFrame:
    """(url, date, headers, html, response_id) of every response record in files, a table with the bytes of
    WARC files or of runs of records, as spark.read.format("binaryFile") gives. A file is read in one task;
    null and empty contents, and files without records, give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["url", "date", "headers", "html", "response_id"]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse_warc(content.as_py() or b""):
                    if fields.get("warc-type", "").lower() == "response":
                        headers, payload = split_response(block)
                        rows.append((fields.get("warc-target-uri", ""), fields.get("warc-date", ""), headers, payload, fields.get("warc-record-id", "")))
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)

    return files.select(content_col).mapInArrow(run, RESPONSE)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    return derivatives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def warc_payloads(spark, sf_dir: str) -> DataFrame:
    """Of op8's records what SQL can make too: the payload's digest in hexadecimal, block sizes and links."""
    found = op8_warc(spark, sf_dir)
    hexadecimal = F.pandas_udf(lambda s: s.map(lambda d: base64.b32decode(d[5:]).hex()), "string")
    linked = (F.col("record_id") != F.col("concurrent_to")) & (F.octet_length(F.encode("block", "UTF-8")) == F.col("n_bytes"))
    return found.select("page_id", "warc_type", "target_uri", hexadecimal("payload_digest").alias("payload_sha1"), linked.alias("linked"))


PAYLOADS_SQL = """SELECT page_id, warc_type, coalesce(url, '') AS target_uri, sha1(coalesce(html, '')) AS payload_sha1, true AS linked
    FROM pages, (VALUES ('metadata'), ('conversion')) t(warc_type)"""
