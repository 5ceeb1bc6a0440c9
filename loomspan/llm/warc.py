"""Derivatives of web archives: metadata and plain-text conversion records that are linked to their responses.

A response record becomes a ``metadata`` record (what the page says about itself and its links) and
a ``conversion`` record (its visible text). Both keep ``WARC-Refers-To`` (the response's record id),
``WARC-Target-URI`` and ``WARC-Date`` of the source, and carry their own ids and digests; the metadata lists the
source's own headers and digests. Ids are name-based, so that a task that is run again makes the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as _html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

DATE = "1970-01-01T00:00:00Z"  # where the source has none
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space of URLs
# Tags end at the next angle bracket, of either kind: every pattern passes over a page once, however it is broken.
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^<>]*>.*?(?:</\1\s*>|\Z)|<!doctype[^<>]*>", re.I | re.S)
#: What no element of the page lies in.
_CODE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_HEAD, _HEAD_END = re.compile(r"<head\b[^<>]*>", re.I), re.compile(r"</head\s*>", re.I)
_BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|article|section|header|footer|nav|aside|main|blockquote|pre|hr|dd|dt|dl|form|figure|figcaption|title)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>?")
_BLANK = re.compile(r"[ \t\r\f\v ]+")
_TITLE, _TITLE_END = re.compile(r"<title\b[^<>]*>", re.I), re.compile(r"</title\s*>", re.I)
_CHARSET = re.compile(r"""charset\s*=\s*["']?([\w.:-]+)""", re.I)
_LINK = re.compile(r"""<a\b[^<>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_LANG = re.compile(r"""<html\b[^<>]*?\blang\s*=\s*["']?([A-Za-z0-9-]+)""", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record: version line, headers, blank line, block, two line ends."""
    clean = [(k, re.sub(r"[\r\n]+", " ", v)) for k, v in headers]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def response_record(url: str, body: str, date: str = DATE) -> tuple[list[tuple[str, str]], bytes]:
    """The response record of a fetched page: an HTTP message with the body as its payload."""
    payload = body.encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    headers = [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", url, digest(payload))), ("WARC-Date", date), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return headers, block


def _between(page: str, first: re.Pattern, last: re.Pattern) -> tuple[int, int, int, int] | None:
    """Places of the first opening tag and of the closing tag behind it; none where it isn't closed."""
    a = first.search(page)
    b = last.search(page, a.end()) if a else None
    return (a.start(), a.end(), b.start(), b.end()) if b else None


def decoded(payload: bytes, http: dict[str, str]) -> str:
    """The page as text: content encodings undone, by the charset of the HTTP head or else UTF-8; what can't be decoded becomes U+FFFD."""
    encoding = http.get("content-encoding", "").strip().lower()
    try:
        payload = gzip.decompress(payload) if encoding in ("gzip", "x-gzip") else zlib.decompress(payload) if encoding == "deflate" else payload
    except (OSError, EOFError, zlib.error):
        pass  # sent as it is, whatever the head says
    named = _CHARSET.search(http.get("content-type", ""))
    try:
        return payload.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def visible_text(page: str) -> str:
    """Text that a reader sees: no head, scripts, styles or comments; blocks on lines of their own; entities resolved."""
    page = _HIDDEN.sub(" ", page)
    if head := _between(page, _HEAD, _HEAD_END):
        page = page[: head[0]] + " " + page[head[3] :]
    text = _TAG.sub("", _BLOCK.sub("\n", page))
    lines = (_BLANK.sub(" ", x).strip() for x in _html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def derive(headers: dict[str, str], block: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """The metadata and the conversion record of a response; ``headers`` with names in lower case.

    Records of other types have none. A block without an HTTP head is taken as the payload.
    """
    if headers.get("warc-type") != "response":
        return []
    head, cut, payload = block.partition(b"\r\n\r\n")
    if not cut or not head.startswith(b"HTTP/"):
        head, payload = b"", block
    http = [(k.strip().lower(), v.strip()) for k, c, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:]) if c]
    page = decoded(payload, dict(http))
    source, uri, date = headers["warc-record-id"], headers.get("warc-target-uri", ""), headers.get("warc-date", DATE)
    marked = _CODE.sub(" ", page)
    title = _between(marked, _TITLE, _TITLE_END)
    lang = _LANG.search(marked)
    fields = [("via-record", source), *((f"source-{k}", v) for k, v in headers.items() if k not in ("warc-record-id",))]
    fields += [("http-" + k, v) for k, v in http]
    fields += [("source-payload-digest-checked", str(headers.get("warc-payload-digest", digest(payload)) == digest(payload)).lower())]
    fields += [("title", " ".join(_html.unescape(_TAG.sub("", marked[title[1] : title[2]])).split()))] if title else []
    fields += [("languages-cld", lang[1].lower())] if lang else []
    fields += [("outlink", _html.unescape(next(x for x in m if x is not None and x != "") if any(m) else "")) for m in _LINK.findall(marked)]
    meta = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    text = visible_text(page).encode("utf-8", "surrogatepass")
    out = []
    for kind, mime, body in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text)):
        out.append(([
            ("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source, digest(body))), ("WARC-Date", date), ("WARC-Refers-To", source), ("WARC-Target-URI", uri),
            *([("WARC-Refers-To-Date", date)] if kind == "conversion" else []), ("WARC-Block-Digest", digest(body)), ("Content-Type", mime), ("Content-Length", str(len(body))),
        ], body))
    return out


_SCHEMA = "record_type string, record_id string, refers_to string, target_uri string, date string, source_payload_digest string, block_digest string, content_length long, headers string, block string"


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page_id, url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            headers, block = response_record(url, page)
            source = {k.lower(): v for k, v in headers}
            for h, body in derive(source, block):
                d = dict(h)
                rows.append((page_id, d["WARC-Type"], d["WARC-Record-ID"], d["WARC-Refers-To"], url, d["WARC-Date"], source["warc-payload-digest"], d["WARC-Block-Digest"], len(body), serialise(h, b"")[:-4].decode("utf-8", "replace"), body.decode("utf-8", "replace")))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 11
        kinds = [batch.column(0).type, *[pa.string()] * 7, pa.int64(), pa.string(), pa.string()]
        names = ["page_id", *(x.split()[0] for x in _SCHEMA.split(", "))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def derivatives(pages: DataFrame) -> DataFrame:
    """Two rows for each page (``page_id, url, html``): its metadata and its conversion record, with headers and block.

    A null page counts as empty (its conversion has no text), a null address as empty; repeated rows give
    repeated records with equal ids; an empty table gives none; other columns are ignored. No shuffle.
    """
    from pyspark.sql import functions as F

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(_derived, f"page_id {kind}, {_SCHEMA}")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(h.split("\r\n\r\n")[0] + "\r\n\r\n").encode("utf-8") + b.encode("utf-8") + b"\r\n\r\n" for h, b in zip(batch.column("headers").to_pylist(), batch.column("block").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("record_id"), pa.array(out, pa.binary())], names=["record_id", "record"])


def records(derived: DataFrame) -> DataFrame:
    """The bytes of each record: ``record_id, record``; concatenated they are an archive."""
    return derived.select("record_id", "headers", "block").mapInArrow(_joined, "record_id string, record binary")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of archive files, plain or gzip-compressed (record by record or whole): ``headers map<string,string>, block binary``; files are spread over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = list(parse(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content))
                yield pa.RecordBatch.from_arrays([pa.array([list(h.items()) for h, _ in rows], pa.map_(pa.string(), pa.string())), pa.array([b for _, b in rows], pa.binary())], names=["headers", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "headers map<string,string>, block binary")
