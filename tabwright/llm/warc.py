"""Derived archive records: linked metadata and plain-text conversions of responses.

A response record gives two more. The ``metadata`` record holds, as JSON, the source's record headers and HTTP headers as they stand,
its digests, and the page's title, language and links. The ``conversion`` record holds the page's visible text. Both name the response
in ``WARC-Refers-To`` and keep its target and date, and their own ids are derived from it, so a task that runs twice makes
the same records.

Records are rows: their headers in order, and their block. :func:`serialise` gives the bytes of the file format, :func:`parse` reads them
back. Digests are ``sha1:`` and base 32, over the block and, for responses, over the payload after the HTTP headers.

Defined results: a null page is an empty page, a null url an empty target. Repeated rows give repeated records with equal ids. A response
whose HTTP headers don't end has an empty payload; one that isn't HTML is converted to an empty text.
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
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import quoted, whole

VERSION = "WARC/1.1"
#: The archive date of pages that carry none.
DATE = "1970-01-01T00:00:00Z"
END = "\r\n\r\n"
RECORD = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, headers string, block string"
# Each pattern that begins to match a tag also ends, at the latest with the page, so the time is linear in the page.
_BREAKING = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*(?:>|\Z)",
    re.IGNORECASE,
)
_UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title)\b[^>]*(?:>|\Z).*?(?:</\1\s*>|\Z)", re.IGNORECASE | re.DOTALL)
_MARKUP = re.compile(r"<[!/?a-z][^>]*(?:>|\Z)", re.IGNORECASE)
_TITLE = re.compile(r"<title\b[^>]*(?:>|\Z)(.*?)(?:</title\s*>|\Z)", re.IGNORECASE | re.DOTALL)
_ROOT = re.compile(r"<html\b([^>]*)", re.IGNORECASE)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.IGNORECASE)
_LINK = re.compile(r"<(a|area|img|link|script|iframe|source)\b([^>]*)", re.IGNORECASE)
_TARGET = re.compile(r"\b(href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *source: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join([kind, *map(str, source)]))}>"


def header_lines(fields: list[tuple[str, str]]) -> str:
    """Header fields as they are written. Line breaks in a value would end it and become spaces."""
    return "\r\n".join(f"{k}: {' '.join(v.split())}" for k, v in fields)


def header_list(lines: str) -> list[list[str]]:
    """Name and value of every field as they stand, in order and with repeats; folded lines go on."""
    fields = (line.partition(":") for line in re.sub(r"\r?\n[ \t]+", " ", lines).split("\n"))
    return [[name.strip(), value.strip()] for name, colon, value in fields if colon]


def header_fields(lines: str) -> dict[str, str]:
    """Fields to look up by lower-case name; of repeated ones the first."""
    out: dict[str, str] = {}
    for name, value in header_list(lines):
        out.setdefault(name.lower(), value)
    return out


def title_of(page: str) -> str:
    found = _TITLE.search(page)
    return " ".join(html.unescape(found[1]).split()) if found else ""


def links_of(page: str, base: str) -> list[dict[str, str]]:
    out = []
    # Comments go, and what a script or style holds; its own tag stays.
    seen = _UNSEEN.sub(lambda m: m[0][: m[0].find(">") + 1] if m[1] else " ", page)
    for tag, attributes in _LINK.findall(seen):
        for name, a, b, c in _TARGET.findall(attributes):
            target = html.unescape(a or b or c).strip()
            try:
                target = urljoin(base, target)
            except ValueError:
                pass  # kept as it stands
            out.append({"path": f"{tag.lower()}@/{name.lower()}", "url": target})
    return out


def visible_text(page: str) -> str:
    """All text that a reader may see, one line per block."""
    page = _MARKUP.sub(" ", _BREAKING.sub("\n", _UNSEEN.sub(" ", page).replace("\n", " ")))
    lines = (" ".join(html.unescape(line).split()) for line in page.split("\n"))
    return "\n".join(line for line in lines if line)


def response_of(page: str | None, url: str | None, key: object, date: str) -> dict[str, str]:
    """A page as the response record that a crawler would have written."""
    body = page or ""
    size = len(body.encode("utf-8", "surrogatepass"))
    block = header_lines([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size))])
    block = f"HTTP/1.1 200 OK\r\n{block}{END}{body}"
    return finished("response", record_id("response", key, url or ""), "", url or "", date, "application/http; msgtype=response", block, [("WARC-Payload-Digest", sha1(body.encode("utf-8", "surrogatepass")))])


def finished(kind: str, own_id: str, refers_to: str, target: str, date: str, content_type: str, block: str, more: list[tuple[str, str]]) -> dict[str, str]:
    """A record with its headers."""
    raw = block.encode("utf-8", "surrogatepass")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own_id), *([("WARC-Refers-To", refers_to)] if refers_to else []), ("WARC-Target-URI", target), ("WARC-Date", date)]
    fields += [*more, ("WARC-Block-Digest", sha1(raw)), ("Content-Type", content_type), ("Content-Length", str(len(raw)))]
    return {"record_type": kind, "record_id": own_id, "refers_to": refers_to, "target_uri": target, "warc_date": date, "headers": header_lines(fields), "block": block}


def derive_one(response: dict[str, str]) -> list[dict[str, str]]:
    """The metadata and the conversion record of a response."""
    fields = header_fields(response["headers"])
    source, target, date = fields.get("warc-record-id", ""), fields.get("warc-target-uri", ""), fields.get("warc-date", DATE)
    http, end, payload = response["block"].partition(END)
    status, _, lines = http.partition("\r\n")
    http_fields = header_fields(lines)
    if not end:
        payload = ""
    is_html = "html" in http_fields.get("content-type", "text/html").lower()
    page = payload if is_html else ""
    root = _ROOT.search(page)
    lang = root and _LANG.search(root[1])
    digests = {k: fields[k] for k in ("warc-payload-digest", "warc-block-digest") if k in fields}
    envelope = {
        "source": {"warc-headers": header_list(response["headers"]), "http-status": status, "http-headers": header_list(lines), "digests": digests, "payload-verified": fields.get("warc-payload-digest") == sha1(payload.encode("utf-8", "surrogatepass"))},
        "html": {"title": title_of(page), "lang": lang[1].lower() if lang else "", "links": links_of(page, target)},
    }
    linked = [("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date)]
    linked += [(f"WARC-Source-{k}", digests[n]) for k, n in (("Payload-Digest", "warc-payload-digest"), ("Block-Digest", "warc-block-digest")) if n in digests]
    block = json.dumps(envelope, ensure_ascii=False, sort_keys=True)
    return [
        finished("metadata", record_id("metadata", source), source, target, date, "application/json", block, linked),
        finished("conversion", record_id("conversion", source), source, target, date, "text/plain; charset=utf-8", visible_text(page), linked),
    ]


def serialise(record: dict[str, str]) -> bytes:
    return f"{VERSION}\r\n{record['headers']}{END}{record['block']}{END}".encode("utf-8", "surrogatepass")


def parse(data: bytes) -> Iterator[dict[str, str]]:
    """The records in the bytes of a file, by their lengths. Raises ``ValueError`` where the format is broken."""
    at, end = 0, END.encode()
    while at < len(data):
        stop = data.find(end, at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        _, _, headers = data[at:stop].decode("utf-8", "surrogatepass").partition("\r\n")
        fields = header_fields(headers)
        start = stop + len(end)
        at = start + int(fields["content-length"])
        if data[at : at + len(end)] != end:
            raise ValueError(f"the record at byte {start} is not as long as it says")
        block = data[start:at].decode("utf-8", "surrogatepass")
        at += len(end)
        yield {
            "record_type": fields.get("warc-type", ""), "record_id": fields.get("warc-record-id", ""), "refers_to": fields.get("warc-refers-to", ""),
            "target_uri": fields.get("warc-target-uri", ""), "warc_date": fields.get("warc-date", ""), "headers": headers, "block": block,
        }


def _columns() -> list[str]:
    return [c.split()[0] for c in RECORD.split(", ")]


def _batch(keys: list, records: list[dict[str, str]], kind: pa.DataType, key: str) -> pa.RecordBatch:
    names = _columns()
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), *(pa.array([r[n] for r in records], pa.string()) for n in names)], names=[key, *names])


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", date: str = DATE) -> DataFrame:
    """One response record per page: ``page_id`` and the columns of a record."""
    own = pages.select(F.col(quoted(key)).cast("long").alias("page_id"), F.col(quoted(url)).alias("url"), F.col(quoted(page)).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, urls, bodies = (c.to_pylist() for c in batch.columns)
            yield _batch(keys, [response_of(b, u, k, date) for k, u, b in zip(keys, urls, bodies, strict=True)], pa.int64(), "page_id")

    return own.mapInArrow(run, f"page_id long, {RECORD}")


def derive(records: DataFrame, key: str = "page_id") -> DataFrame:
    """The metadata and conversion records of all response records; others give none."""
    names = _columns()
    own = records.filter("record_type = 'response'").select(F.col(quoted(key)).cast("long").alias("page_id"), *[whole(n).alias(n) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A slice at a time: a record gives more than its own size.
            for k in range(0, batch.num_rows, 256):
                rows = batch.slice(k, 256).to_pylist()
                derived = [(r["page_id"], d) for r in rows for d in derive_one(r)]
                yield _batch([i for i, _ in derived], [d for _, d in derived], pa.int64(), "page_id")

    return own.mapInArrow(run, f"page_id long, {RECORD}")


def write_archive(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write records as files of the archive format, one per task, wherever Spark can write."""
    text = F.concat(F.lit(f"{VERSION}\r\n"), F.col("headers"), F.lit(END), F.col("block"))
    records.select(text.alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


def read_archive(spark, path: str) -> DataFrame:
    """Records from files that :func:`write_archive` wrote, compressed or not; one or many compressed members make no difference. A file
    is read whole: files are as large as the tasks that wrote them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _columns()
        for batch in batches:
            for data in batch.column(0).to_pylist():
                found = list(parse(gzip.decompress(data) if data.startswith(b"\x1f\x8b") else data))
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], pa.string()) for n in names], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)
