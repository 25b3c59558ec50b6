"""WARC derivatives: from response records to linked metadata and conversion records.

A response record is the bytes of WARC/1.1: named fields, an empty line, an HTTP message as block. Each one
gives a metadata record (application/warc-fields: title, language, HTTP status and headers, links, digests)
and a conversion record (text/plain, UTF-8). Both name the response by WARC-Refers-To, with its target URI and
date, and carry digests of their own block; the conversion also keeps the source's payload digest. Record ids
are derived from ids and digests, so a rerun gives the same records.

Defined results: a null or empty page is a response with an empty body, converted to an empty text; a null url
becomes an empty target; a record that is not a well-formed response gives no derivatives but one row of type
``invalid``; chunked, gzip and deflate bodies are undone, unsound ones taken as they are; an unknown charset reads as
UTF-8; markup that is never closed hides nothing; repeated rows give repeated records; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.llm.common import map_arrow
from barframe.llm.tokens import as_uri

VERSION = b"WARC/1.1"
SOFTWARE = "barframe"
#: Pages carry no time of their own: the time of the crawl is a parameter.
CRAWLED = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_HIDING = re.compile(r"<!--|<(script|style|noscript|template)\b", re.I)
_BREAK = re.compile(r"<(?:/?(?:p|div|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|title|head|body|blockquote|pre)\b[^>]*|br\s*/?)>", re.I)
_TAG = re.compile(r"<[!/a-zA-Z][^>]*>")
_TITLE, _TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile(r"</title\s*>", re.I)
_HTML, _LANG = re.compile(r"<html\b([^>]*)", re.I), re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I)
_ANCHOR, _HREF = re.compile(r"<a\b([^>]*)", re.I), re.compile(r"\bhref\s*=\s*", re.I)
_VALUE = re.compile(r"\"([^\"]*)\"|'([^']*)'|([^\s>]+)")
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '|'.join(parts))}>"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """The bytes of a record; length and digest of the block are put last."""
    fields = [*fields, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    head = b"\r\n".join([VERSION, *(f"{k}: {_one_line(v)}".encode() for k, v in fields)])
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Named fields (lower-case names) and block of a record, or None if it is not one."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError):
        return None
    return (fields, rest[:length]) if 0 <= length <= len(rest) else None


def response(url: str | None, body: str | None, crawled: str = CRAWLED) -> bytes:
    """A page as response record."""
    payload = (body or "").encode("utf-8", "replace")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    target, sum_ = url or "", digest(payload)
    return record([
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", target, crawled, sum_)), ("WARC-Date", crawled), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", sum_), ("Content-Type", "application/http; msgtype=response")], http + payload)


def visible(page: str) -> str:
    """The page with a blank for each comment, script, style, noscript and template. One pass: what is never closed is looked for once."""
    out, at, unclosed = [], 0, set()
    start = 0
    while m := _HIDING.search(page, start):
        name = (m[1] or "").lower()
        start = m.end()
        if name in unclosed:
            continue
        if name:
            opened = page.find(">", m.end())
            end = re.compile(rf"</{name}\s*>", re.I).search(page, opened + 1) if opened >= 0 else None
            end = end.end() if end else -1
        else:
            end = page.find("-->", m.end())
            end = end + 3 if end >= 0 else -1
        if end < 0:
            unclosed.add(name)
        else:
            out += [page[at : m.start()], " "]
            at = start = end
    return "".join([*out, page[at:]])


def _tagged(page: str) -> tuple[str, str]:
    """The page up to its last tag end, and the rest, where no tag can be."""
    last = page.rfind(">") + 1
    return page[:last], page[last:]


def plain_text(page: str) -> str:
    """Visible text: scripts, styles and comments gone, blocks on lines of their own, entities decoded, blanks collapsed."""
    tagged, rest = _tagged(visible(page))
    lines = (" ".join(x.split()) for x in html.unescape(_TAG.sub("", _BREAK.sub("\n", tagged)) + rest).split("\n"))
    return "\n".join(x for x in lines if x)


def title_of(page: str) -> str:
    begin = _TITLE.search(_tagged(page)[0])
    end = _TITLE_END.search(page, begin.end()) if begin else None
    if not end:
        return ""
    tagged, rest = _tagged(page[begin.end() : end.start()])
    return " ".join(html.unescape(_TAG.sub("", tagged) + rest).split())


def language_of(page: str) -> str:
    return next((found[-1] for m in _HTML.finditer(page) if (found := _LANG.findall(m[1]))), "")


def hrefs(page: str) -> list[str]:
    """The targets of a page's anchors in order; of several in one tag the last that has a value."""
    out, done = [], 0
    for m in _ANCHOR.finditer(page):
        if m.start() < done:  # within the value before
            continue
        for place in reversed(list(_HREF.finditer(m[1]))):
            if value := _VALUE.match(page, m.start(1) + place.end()):
                out.append(html.unescape(next(g for g in value.groups() if g is not None)))
                done = value.end()
                break
    return out


def _whole(data: bytes) -> bytes:
    """The body behind a chunked transfer; as it is where its chunks do not add up."""
    out, at = [], 0
    while True:
        line = data.find(b"\r\n", at)
        try:
            size = int(data[at:line].split(b";")[0], 16) if line >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or line + 2 + size > len(data):
            return data
        if not size:
            return b"".join(out)
        out.append(data[line + 2 : line + 2 + size])
        at = line + 4 + size


def _unpacked(payload: bytes, headers: dict[str, str]) -> bytes:
    """The body of an HTTP message, its transfer and content encodings undone where they are known and sound."""
    if "chunked" in headers.get("transfer-encoding", "").lower():
        payload = _whole(payload)
    for coding in reversed(headers.get("content-encoding", "").lower().replace(" ", "").split(",")):
        if coding in ("gzip", "x-gzip", "deflate"):
            for wbits in (47, -15):
                try:
                    payload = zlib.decompress(payload, wbits)
                    break
                except zlib.error:
                    continue
    return payload


def derive(data: bytes | None) -> list[dict]:
    """Metadata and conversion of a response; each a row with the record's bytes and its main fields."""
    parsed = parse(data or b"")
    if parsed is None or parsed[0].get("warc-type") != "response" or b"\r\n\r\n" not in parsed[1]:
        return [{"record_type": "invalid"}]
    fields, block = parsed
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *headers = head.decode("latin-1").split("\r\n")
    kind = next((v.strip() for k, _, v in (h.partition(":") for h in headers) if k.strip().lower() == "content-type"), "")
    body = _unpacked(payload, {h.partition(":")[0].strip().lower(): h.partition(":")[2] for h in headers})
    charset = (_CHARSET.search(kind.encode()) or _CHARSET.search(body[:2048]) or [b"", b"utf-8"])[1].decode()
    try:
        page = body.decode(charset, "replace")
    except (LookupError, UnicodeError):  # no such charset, or one that is no charset of texts
        page = body.decode("utf-8", "replace")
    source = {k: fields.get(k, "") for k in ("warc-record-id", "warc-target-uri", "warc-date")}
    payload_digest = fields.get("warc-payload-digest") or digest(payload)
    linked = [("WARC-Refers-To", source["warc-record-id"]), ("WARC-Refers-To-Target-URI", source["warc-target-uri"]), ("WARC-Refers-To-Date", source["warc-date"])]
    about = [("software", SOFTWARE), ("title", title_of(page)), ("language", language_of(page)),
             ("http-status", status.split(" ")[1] if " " in status else ""), *((f"http-header-{h.partition(':')[0].strip().lower()}", h.partition(":")[2].strip()) for h in headers if ":" in h),
             ("source-payload-digest", payload_digest), ("source-block-digest", fields.get("warc-block-digest") or digest(block))]
    links = dict.fromkeys(_absolute(source["warc-target-uri"], x) for x in hrefs(page))
    about += [("outlink", x) for x in links]
    out = []
    for record_type, content, body, more in (
        ("metadata", "application/warc-fields", "".join(f"{k}: {_one_line(v)}\r\n" for k, v in about if v).encode(), []),
        ("conversion", "text/plain; charset=utf-8", plain_text(page).encode("utf-8", "replace"), [("WARC-Source-Payload-Digest", payload_digest)]),
    ):
        own = record_id(record_type, source["warc-record-id"], digest(body))
        out.append({
            "record_type": record_type, "record_id": own, "refers_to": source["warc-record-id"], "target_uri": source["warc-target-uri"], "warc_date": source["warc-date"],
            "content_type": content, "content_length": len(body), "block_digest": digest(body), "source_payload_digest": payload_digest, "n_outlinks": len(links),
            "record": record([("WARC-Type", record_type), ("WARC-Record-ID", own), ("WARC-Date", source["warc-date"]), ("WARC-Target-URI", source["warc-target-uri"]), *linked,
                              *more, ("Content-Type", content)], body)})
    return out


def _absolute(base: str, link: str) -> str:
    try:
        return urljoin(base, link)
    except ValueError:
        return link


_ROW = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()),
                  ("content_type", pa.string()), ("content_length", pa.int64()), ("block_digest", pa.string()), ("source_payload_digest", pa.string()), ("n_outlinks", pa.int64()), ("record", pa.binary())])
_DDL = ("page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, "
        "block_digest string, source_payload_digest string, n_outlinks long, record binary")


def responses(pages: DataFrame, crawled: str = CRAWLED) -> DataFrame:
    """(page_id, record) of response records."""

    def run(batches):
        for batch in batches:
            rows = [response(u, h, crawled) for u, h in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)]
            yield pa.record_batch([batch.column("page_id"), pa.array(rows, pa.binary())], names=["page_id", "record"])

    return map_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), run, "page_id long, record binary")


def derivatives(records: DataFrame) -> DataFrame:
    """The derived records of (page_id, record); row by row, so nothing is shuffled."""

    def run(batches):
        for batch in batches:
            rows = [{"page_id": i} | d for i, r in zip(batch.column("page_id").to_pylist(), batch.column("record").to_pylist(), strict=True) for d in derive(r)]
            yield pa.RecordBatch.from_pylist(rows, schema=_ROW)

    return map_arrow(records.select("page_id", "record"), run, _DDL)


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write the ``record`` column as .warc.gz files, a member a record and a file a task. Returns (file, records, bytes).

    A file gets its name when it is whole, so a repeated task leaves one file.
    """
    target = as_uri(folder)

    def run(batches) -> Iterator[pa.RecordBatch]:
        system, path = pafs.FileSystem.from_uri(target)
        system.create_dir(path, recursive=True)
        own, name, n, size = f"{path}/_{uuid.uuid4().hex}", f"{path}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0, 0
        with system.open_output_stream(own) as out:
            for batch in batches:
                for r in batch.column("record").to_pylist():
                    if r is not None:
                        member = gzip.compress(r, 6, mtime=0)
                        out.write(member)
                        n, size = n + 1, size + len(member)
        system.move(own, name)
        yield pa.record_batch([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

    return map_arrow(records.select("record"), run, "file string, records long, bytes long")


def read(data: bytes) -> Iterator[bytes]:
    """The records of a .warc.gz file's bytes, uncompressed."""
    import zlib

    while data:
        member = zlib.decompressobj(31)
        yield member.decompress(data)
        data = member.unused_data
