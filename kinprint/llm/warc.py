"""WARC derivatives: linked metadata and plain-text conversion records of responses.

A response record gives two: ``metadata`` with the source's HTTP status and headers, its
digests, title and links, and ``conversion`` with its plain text. Both refer to the source by its
record id, keep its target and date, and carry digests of their own. Records are whole WARC/1.0
records in bytes, so a row can be written as it is; ``parse`` reads one back.

A record depends on its own source only: there is no shuffle, and a lost executor costs its
own tasks. Record ids derive from the source's id and the kind, so a rerun gives the same ids.

Defined results: a null or empty payload gives an empty text; a null target leaves the header out;
a source that is no response, or whose block has no HTTP header, gives a metadata record with
``error`` and no conversion; bytes that are not UTF-8 are replaced in the text but digests are of
the bytes as they are; repeated rows give repeated records; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of the format.
VERSION = "WARC/1.0"
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"

# Elements whose text is not shown, and those that begin a line.
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>|<(?:script|style)\b.*\Z", re.S | re.I)
_BREAK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|"
    r"main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>",
    re.I,
)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
_SPACE = re.compile(r"[ \t\r\f\v ]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LINK = re.compile(r"<a\b[^>]*?\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LANG = re.compile(r"<html\b[^>]*?\slang\s*=\s*[\"']?([\w-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(parts))}>"


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A whole record; its block digest and length are added, headers without a value left out."""
    own = [*headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    lines = [VERSION, *(f"{k}: {' '.join(v.split())}" for k, v in own if v is not None)]
    return (CRLF.join(lines) + CRLF * 2).encode() + block + (CRLF * 2).encode()


def parse(raw: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of a record; raises ValueError on what is no whole record."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split(CRLF)
    headers = [tuple(x.split(": ", 1)) if ": " in x else (x.rstrip(":"), "") for x in lines[1:]]
    length = next((v for k, v in headers if k.lower() == "content-length"), "")
    if not sep or not lines[0].startswith("WARC/") or not length.isdigit() or len(rest) < int(length):
        raise ValueError("no whole record")
    return headers, rest[: int(length)]


def header(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def response(key: str, url: str | None, payload: bytes, date: str = DATE) -> bytes:
    """A response record of a fetched page."""
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF * 2}".encode()
    headers = [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url or "")), ("WARC-Date", date),
        ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)),
    ]
    return record(headers, http + payload)


def plain_text(source: str) -> str:
    """The text that a page shows: a line for each block, white space collapsed, entities decoded."""
    text = _HIDDEN.sub(" ", source)
    # Line breaks of the source are white space; those of blocks are put in afterwards.
    text = _BREAK.sub("\x00", text.replace("\x00", " ").replace("\n", " "))
    text = html.unescape(_TAG.sub("", text)).replace("\n", " ")
    text = _SPACE.sub(" ", text.replace("\x00", "\n"))
    return _LINES.sub("\n", text).strip(" \n")


def fields(items: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {' '.join(v.split())}{CRLF}" for k, v in items).encode()


def derive(raw: bytes) -> list[tuple[str, bytes]]:
    """(kind, record) of the derivatives of one record."""
    headers, block = parse(raw)
    source = header(headers, "WARC-Record-ID") or record_id("unnamed", digest(raw))
    common = [("WARC-Refers-To", source), ("WARC-Date", header(headers, "WARC-Date")), ("WARC-Target-URI", header(headers, "WARC-Target-URI"))]
    kept = [(f"source-{k.lower()}", v) for k, v in headers if k.lower() in ("warc-payload-digest", "warc-block-digest", "content-type")]

    def made(kind: str, content: str, body: bytes, more=()) -> tuple[str, bytes]:
        return kind, record([("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source)), *common, ("Content-Type", content), *more], body)

    http, sep, payload = block.partition(b"\r\n\r\n")
    status = http.split(b"\r\n", 1)[0].decode("latin-1")
    if header(headers, "WARC-Type") != "response" or not sep or not status.startswith("HTTP/"):
        return [made("metadata", "application/warc-fields", fields([*kept, ("error", "no HTTP response")]))]
    lines = [x.decode("latin-1").partition(":") for x in http.split(b"\r\n")[1:]]
    kept += [("http-status", status), *((f"http-{k.strip().lower()}", v.strip()) for k, _, v in lines)]
    own = digest(payload)
    stated = header(headers, "WARC-Payload-Digest")
    text = payload.decode("utf-8", "replace")
    kept += [("payload-digest", own), ("payload-digest-matches", "yes" if stated == own else "no" if stated else "not stated")]
    if title := _TITLE.search(text):
        kept.append(("title", html.unescape(_TAG.sub("", title[1]))))
    if lang := _LANG.search(text):
        kept.append(("language", lang[1]))
    kept += [("outlink", html.unescape(a or b or c)) for a, b, c in _LINK.findall(text)]
    return [
        made("metadata", "application/warc-fields", fields(kept)),
        made("conversion", "text/plain; charset=UTF-8", plain_text(text).encode(), [("WARC-Source-Payload-Digest", own)]),
    ]


def responses(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """(key, record): a response record for each page."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, urls, bodies = part.column(0), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist()
                made = [response(str(k), u, b or b"") for k, u, b in zip(keys.to_pylist(), urls, bodies, strict=True)]
                yield pa.RecordBatch.from_arrays([keys, pa.array(made, pa.binary())], names=["key", "record"])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("key"), *[F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate((url_col, html_col))])
    return rows.mapInArrow(run, "key long, record binary")


def derivatives(sources: DataFrame, key_col="key", record_col="record") -> DataFrame:
    """(key, kind, record): the derived records of each source record."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [
                    (key, kind, made)
                    for key, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                    if raw is not None
                    for kind, made in derive(raw)
                ]
                cols = list(zip(*rows, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary())], names=["key", "kind", "record"]
                )

    rows = sources.select(F.col(f"`{key_col}`").cast("long").alias("key"), F.col(f"`{record_col}`").alias("record"))
    return rows.mapInArrow(run, "key long, kind string, record binary")


SUMMARY = "record_id refers_to target_uri content_type block_digest source_digest".split()


def summaries(records: DataFrame) -> DataFrame:
    """What derived records say, read back from their bytes; ``intact``: block and digest agree."""
    names = "WARC-Record-ID WARC-Refers-To WARC-Target-URI Content-Type WARC-Block-Digest".split()

    def run(batches):
        for batch in batches:
            rows = []
            for key, kind, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                headers, block = parse(raw)
                source = header(headers, "WARC-Source-Payload-Digest")
                if source is None:
                    lines = dict(x.split(": ", 1) for x in reversed(block.decode().split(CRLF)) if ": " in x)
                    source = lines.get("payload-digest")
                found = [header(headers, n) for n in names]
                rows.append((key, kind, *found, source, len(block), hashlib.sha256(block).hexdigest(), found[-1] == digest(block)))
            cols = list(zip(*rows, strict=True)) or [()] * 11
            kinds = [pa.int64(), *[pa.string()] * 7, pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "kind", *SUMMARY, "n_bytes", "block_sha256", "intact"]
            )

    texts = ", ".join(f"{c} string" for c in ("kind", *SUMMARY))
    return records.mapInArrow(run, f"key long, {texts}, n_bytes long, block_sha256 string, intact boolean")
