"""WARC derivatives (operator 6): from each response a metadata record and a plain-text conversion record.

Records are rows: record_id, type, target_uri, date, refers_to, content_type, headers (all WARC fields), block (bytes). Both
derivatives point to their response by WARC-Refers-To, keep its target and date, and carry digests of their own blocks.
The metadata record holds what the response said of itself (its WARC fields' digests, its HTTP status and headers) and what
its page links to; the conversion record holds the page's text. Ids follow from what a record is made of, so a task that
runs again makes the same records.

Each response is worked on by itself, without a shuffle. A response without an HTTP head counts as a page without
headers; a null block or page is empty and still has both derivatives, null fields are left out of the headers. Repeated
responses give repeated derivatives. Records of other types pass by without derivatives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "record_id string, type string, target_uri string, date string, refers_to string, content_type string, headers map<string,string>, block binary"
DATE = "2024-01-01T00:00:00Z"
_SCHEMA = pa.schema([(c, pa.string()) for c in ("record_id", "type", "target_uri", "date", "refers_to", "content_type")] + [("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
_BREAKS = {"p", "br", "div", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "header", "footer", "nav", "title", "blockquote", "pre", "hr"}
_START = re.compile(r"<!--|</?([a-zA-Z][^\s/>]*+)|<[!?/]")
_STOP = re.compile(r"[<>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=<>"'/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
_ENDS = {name: re.compile(rf"</{name}\b", re.I) for name in ("script", "style", "title")}


def tags(page: str) -> Iterator[tuple[str, int, int, int, bool]]:
    """Comments, declarations, scripts and tags in turn: name (with a slash if it ends an element; "" if it has none), where it
    begins, where its attributes begin, where it ends, and whether it is closed.

    Quotes after an equals sign hold what they hold, `>` too. A tag that isn't closed ends before the next `<`. A script or style
    goes on to its end tag. What has been passed is not looked at again, so a broken page takes no longer than another.
    """
    at, no_more = 0, {'"': len(page), "'": len(page)}  # from where on a quote has no second one
    while found := _START.search(page, at):
        begin, p = found.start(), found.end()
        if page[p : p + 1] == ">" and found[1] and (name := found[1].lower()) not in ("script", "style"):  # most tags
            at = p + 1
            yield ("/" + name if page[begin + 1] == "/" else name), begin, p, at, True
            continue
        if found[0] == "<!--":
            end = page.find("-->", p)
            at = end + 3 if end >= 0 else len(page)
            yield "", begin, p, at, True
            continue
        closed = False
        while stop := _STOP.search(page, p):
            p = stop.start()
            if page[p] in "<>":
                closed = page[p] == ">"
                break
            before = p - 1
            while before > begin and page[before].isspace():
                before -= 1
            other = page.find(page[p], p + 1) if page[before] == "=" and p < no_more[page[p]] else -1
            if other < 0 and page[before] == "=":
                no_more[page[p]] = min(no_more[page[p]], p)
            p = other + 1 if other >= 0 else p + 1
        else:
            p = len(page)
        at = p + 1 if closed else p
        name = ("/" if page[begin + 1] == "/" else "") + (found[1] or "").lower()
        start = found.end()
        if closed and name in ("script", "style"):
            end = _ENDS[name].search(page, at)
            at = end.start() if end else len(page)
        yield name, begin, start, at, closed


def scanned(page: str) -> tuple[str | None, list[str], str]:
    """A page's title, links and text, from one pass.

    Title: what stands between the first title tag and the next one that ends it. Links: the targets of all anchors outside
    comments and scripts; an anchor that isn't closed ends where the next tag begins. Text: what a reader sees, without scripts,
    styles, comments or tags, one line for each block of text; what only looks like a tag stays.
    """
    title, links, bare, at, seen = None, [], [], 0, False
    for name, begin, start, end, closed in tags(page):
        if name == "a":
            target = next((next((g for g in m.groups()[1:] if g is not None), None) for m in _ATTRIBUTE.finditer(page, start, end) if m[1].lower() == "href"), None)
            if target is not None:
                links.append(html.unescape(target))
        elif name == "title" and closed and not seen:
            seen, last = True, _ENDS["title"].search(page, end)
            title = " ".join(html.unescape(page[end : last.start()]).split()) if last else None
        if closed:
            bare.append(page[at:begin])
            if name and (name[1:] if name[0] == "/" else name) in _BREAKS:
                bare.append("\n")
            at = end
    bare.append(page[at:])
    lines = (" ".join(line.split()) for line in html.unescape("".join(bare)).split("\n"))
    return title, links, "\n".join(line for line in lines if line)


def title_of(page: str) -> str | None:
    return scanned(page)[0]


def links_of(page: str) -> list[str]:
    return scanned(page)[1]


def page_text(page: str) -> str:
    return scanned(page)[2]


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*of: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(of))}>"


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response; without a head, all is payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines) if k], payload


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records from page_id, url and html; page_id is kept as a column."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, url, body in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                payload = (body or "").encode()
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                name = record_id("response", str(page), url or "", date, digest(payload))
                rows.append((page, *_record(name, "response", url, date, None, "application/http; msgtype=response", {"WARC-Payload-Digest": digest(payload)}, block)))
            yield _batch(rows, pa.schema([("page_id", pa.int64()), *_SCHEMA]))

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(build, f"page_id long, {RECORD}")


def _record(name: str, kind: str, uri: str | None, date: str | None, refers_to: str | None, content_type: str, more: dict[str, str], block: bytes) -> tuple:
    fields = {"WARC-Type": kind, "WARC-Record-ID": name, "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Refers-To": refers_to, "Content-Type": content_type}
    fields |= more | {"WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
    return name, kind, uri, date, refers_to, content_type, [(k, v) for k, v in fields.items() if v is not None], block


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def derived(source_id: str, uri: str | None, date: str | None, headers: dict[str, str], block: bytes) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    status, http, payload = split_http(block)
    charset = next((m[1] for k, v in http if k.lower() == "content-type" and (m := re.search(r"charset=([\w-]+)", v))), "utf-8")
    try:
        page = payload.decode(charset, "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    title, links, text = scanned(page)
    about = [("source-status", status)] if status else []
    about += [(f"source-http-{k.lower()}", v) for k, v in http]
    about += [(f"source-{k.lower()}", v) for k, v in headers.items() ]
    if title is not None:
        about.append(("title", title))
    about += [("outlink", x) for x in links]
    fields = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in about).encode()
    same = {"WARC-Source-Payload-Digest": headers.get("WARC-Payload-Digest") or digest(payload)}
    meta = record_id("metadata", source_id)
    return [
        _record(meta, "metadata", uri, date, source_id, "application/warc-fields", {}, fields),
        _record(record_id("conversion", source_id), "conversion", uri, date, source_id, "text/plain; charset=utf-8", same | {"WARC-Concurrent-To": meta}, text.encode()),
    ]


def derivatives(records: DataFrame, keep: str | None = None) -> DataFrame:
    """Two records for each response; `keep` names a long column to copy from the response."""
    kept = [keep] if keep else []

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*kept, "record_id", "target_uri", "date", "headers", "block")]
            rows = []
            for *own, name, uri, date, headers, block in zip(*columns, strict=True):
                rows += [(*own, *r) for r in derived(name or "", uri, date, dict(headers or []), block or b"")]
            yield _batch(rows, pa.schema([*((c, pa.int64()) for c in kept), *_SCHEMA]))

    source = records.where("type = 'response'").select(*kept, "record_id", "target_uri", "date", "headers", "block")
    return source.mapInArrow(build, f"{keep} long, {RECORD}" if keep else RECORD)


def write_warc(records: DataFrame, path: str, gzipped: bool = True) -> None:
    """WARC/1.1 files, one for each task, of records whose blocks are UTF-8, as derivatives' are."""
    lines = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e.key, F.lit(": "), e.value)), "\r\n")
    rows = records.select(F.concat(F.lit("WARC/1.1\r\n"), lines, F.lit("\r\n\r\n"), F.col("block").cast("string")).alias("value"))
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip" if gzipped else "none").text(path)


def parse(data: bytes) -> Iterator[tuple]:
    """The records of a WARC file, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", start)
        fields = [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in data[start:end].decode().split("\r\n")[1:])]
        by = {k.lower(): v for k, v in fields}
        at = end + 4 + int(by.get("content-length", 0))
        yield by.get("warc-record-id"), by.get("warc-type"), by.get("warc-target-uri"), by.get("warc-date"), by.get("warc-refers-to"), by.get("content-type"), fields, data[end + 4 : at]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files below path; a file is read by one task."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                yield _batch(list(parse(content)), _SCHEMA)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(build, RECORD)
