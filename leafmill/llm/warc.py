"""Derivatives of web archive records: metadata and plain-text conversions.

Each response record yields a metadata record, with the page's title, language
and outlinks, and a conversion record with its plain text. Both refer to the
response by WARC-Refers-To and keep its target, date and source headers; block
digests are of the new blocks, payload digests of the response's payload.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Response headers that derivatives keep.
KEPT_HEADERS = ("warc-target-uri", "warc-date", "warc-ip-address", "warc-warcinfo-id", "warc-identified-payload-type", "warc-payload-digest")
DERIVED_SCHEMA = (
    "response_id string, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "content_length long, block_digest string, payload_digest string, block string, record binary"
)
# no pattern looks past the next "<", so pages of broken tags cost no more than their length
_DROPPED = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|head|noscript|template|svg|iframe)\b[^<>]*>.*?(?:</\1\s*>|\Z)")
_BLOCK = re.compile(r"(?i)</?(?:address|article|aside|blockquote|br|caption|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^<>]*>")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<![^<>]*>|<\?[^<>]*>")
_TITLE, _TITLE_END = re.compile(r"(?i)<title\b[^<>]*>"), re.compile(r"(?i)</title")
_LANG = re.compile(r"(?i)<html\b[^<>]*\blang\s*=\s*[\"']?([A-Za-z-]+)")
_LINK = re.compile(r"(?i)<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"<]*)\"|'([^'<]*)'|([^\s\"'<>]+))")


def digest(data: bytes) -> str:
    """A labelled SHA-1 digest in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(*parts: str) -> str:
    """A record id that the same parts always give."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(parts))}>"


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return (CRLF.join(lines) + CRLF * 2).encode("utf-8", "surrogatepass") + block + (CRLF * 2).encode()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split(CRLF)
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = headers.get("content-length", "")
    return headers, rest[: int(size)] if size.isdigit() else rest


def page_text(source: str) -> str:
    """All visible text: a line for each block, white space collapsed, references decoded."""
    flat = " ".join(_DROPPED.sub(" ", source).split())
    plain = html.unescape(_TAG.sub("", _BLOCK.sub("\n", flat)))
    return "\n".join(line for part in plain.split("\n") if (line := " ".join(part.split())))


def page_fields(source: str, target: str) -> list[tuple[str, str]]:
    """Title, language and distinct outlinks in page order."""
    fields = []
    if (opened := _TITLE.search(source)) and (closed := _TITLE_END.search(source, opened.end())):
        fields.append(("title", " ".join(html.unescape(source[opened.end() : closed.start()]).split())))
    if found := _LANG.search(source):
        fields.append(("language", found[1].lower()))
    try:
        root = "{0.scheme}://{0.netloc}".format(urlsplit(target)) if target else ""
    except ValueError:
        root = ""
    links: dict[str, None] = {}
    for m in _LINK.finditer(source):
        link = "".join(html.unescape(m[1] or m[2] or m[3] or "").split())
        try:
            links.setdefault(root + link if root and link[:1] == "/" and link[1:2] != "/" else urljoin(target, link))
        except ValueError:  # a link that is no URL
            continue
    return fields + [("outlink", link) for link in links if link]


def derive(data: bytes) -> list[tuple]:
    """Rows of DERIVED_SCHEMA of one response record; none of other types."""
    headers, block = parse_record(data)
    if headers.get("warc-type") != "response":
        return []
    head, _, payload = block.partition(b"\r\n\r\n")
    charset = re.search(rb"(?i)\r\ncontent-type:[^\r]*charset=[\"']?([\w-]+)", head)
    try:
        source = payload.decode(charset[1].decode() if charset else "utf-8", "replace")
    except LookupError:
        source = payload.decode("utf-8", "replace")
    refers, target = headers.get("warc-record-id", ""), headers.get("warc-target-uri", "")
    payload_digest = headers.get("warc-payload-digest") or digest(payload)
    status = head.split(b"\r\n", 1)[0].decode("latin-1")
    fields = [("http-status", status), ("source-block-digest", headers.get("warc-block-digest") or digest(block)), ("source-payload-digest", payload_digest), ("source-length", str(len(payload))), *page_fields(source, target)]
    metadata, rows = "".join(f"{k}: {v}{CRLF}" for k, v in fields), []
    for kind, content_type, text in (("metadata", "application/warc-fields", metadata), ("conversion", "text/plain; charset=utf-8", page_text(source))):
        body = text.encode("utf-8", "surrogatepass")
        record_id = derived_id(refers, kind)
        kept = [("-".join(w.upper() if w in ("warc", "uri", "ip", "id") else w.title() for w in k.split("-")), headers[k]) for k in KEPT_HEADERS if k in headers]
        kept = kept if "warc-payload-digest" in headers else [*kept, ("WARC-Payload-Digest", payload_digest)]
        names = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Refers-To", refers), *kept, ("WARC-Block-Digest", digest(body)), ("Content-Type", content_type)]
        rows.append((refers, kind, record_id, refers, target, headers.get("warc-date"), content_type, len(body), digest(body), payload_digest, text, serialise(names, body)))
    return rows


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id and the response record of each page; null html is an empty payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = []
            for page_id, url, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (source or "").encode("utf-8", "surrogatepass")
                block = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF}{CRLF}".encode() + payload
                target = [("WARC-Target-URI", "".join(url.split()))] if url else []
                names = [("WARC-Type", "response"), ("WARC-Record-ID", derived_id("page", str(page_id), url or "", digest(payload))), *target, ("WARC-Date", date), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
                records.append(serialise(names, block))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(records, pa.binary())], ["page_id", "record"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, record binary")


def derivatives(records: DataFrame, column: str = "record") -> DataFrame:
    """Two rows per response record in ``column``: its metadata and its conversion.

    Other columns stay in front; those named as the new ones are replaced.
    Records of other types, empty and null ones give no rows; repeated records
    give repeated rows; an empty table gives none. Payloads are read whole; a tag
    without its end before the next "<" is text.
    """
    names = [f.split(" ")[0] for f in DERIVED_SCHEMA.split(", ")]
    carried = [f for f in records.schema.fields if f.name not in names and f.name != column]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried), DERIVED_SCHEMA])
    types = [pa.int64() if n == "content_length" else pa.binary() if n == "record" else pa.string() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, origin = [], []
            for i, data in enumerate(batch.column(len(carried)).to_pylist()):
                new = derive(data) if data else []
                rows += new
                origin += [i] * len(new)
            front = [c.take(pa.array(origin, pa.int64())) for c in batch.columns[: len(carried)]]
            new = [pa.array(list(v), t) for v, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*front, *new], [*batch.schema.names[: len(carried)], *names])

    return records.select(*[F.col(f"`{f.name}`") for f in carried], F.col(f"`{column}`")).mapInArrow(run, schema)
