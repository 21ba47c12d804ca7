"""WARC derivatives: metadata and plain-text conversion records made from response records.

Every response gives two records that refer to it by its identifier: ``metadata`` (application/warc-fields: title,
language, outlinks, the source's headers and digests) and ``conversion`` (text/plain). Both carry WARC-Refers-To,
WARC-Refers-To-Target-URI, WARC-Refers-To-Date, WARC-Concurrent-To of one another and digests of their own blocks.
``record`` is the whole record as it would stand in a file.

Pages are read by a tokenizer in the manner of the HTML standard: comments, tags with quoted attributes, raw text.
``head`` needs no rule of its own, since what it may hold shows nothing and anything else ends it.

Record identifiers are names made from page id, url, payload and the row's place in the table (its partition and number
there), so they are unique for null ids and repeated pages too, and the same whenever the same partitions are read again.

Edge cases: a null url or body counts as empty; malformed or empty html gives the text that is left, maybe none; a
response without headers keeps an empty list; equal pages get different identifiers and equal digests; columns besides
the named ones aren't read; an empty table gives no records. A very long page is one row and must fit its task; it is
tokenized in linear time. Files are streamed record by record, so they may have any size; a record must fit its task.
Records that are cut off or have no valid length are left out, and ``problems`` lists them (not those lost where a gzip
stream ends early: Spark's reader logs such files and keeps the records before).
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:loomtext:warc")
DATE = "2024-01-01T00:00:00Z"

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</(?![a-zA-Z])[^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|[^>])*+)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"'][^\s=/>]*+)\s*+(?:=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]*+)))?")
#: Elements whose content isn't markup, elements whose content isn't shown, elements that stand on lines of their own.
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
HIDDEN = frozenset("script style title noscript iframe noembed noframes template svg".split())
BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul".split())
_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, '|'.join(map(str, parts)))}>"


@dataclass
class Page:
    title: str
    lang: str
    links: list[str]
    text: str


def _attribute(tag: str, name: str) -> str | None:
    for m in _ATTRIBUTE.finditer(tag):
        if m[1].lower() == name:
            return html.unescape(m[2] or m[3] or m[4] or "")
    return None


def _one_line(s: str) -> str:
    return " ".join(s.split())


def read_page(page: str) -> Page:
    """Title, language, targets of links, and the visible text: one line per block, white space as one space, no empty lines.

    Lines of ``pre`` are lines of the text.
    """
    lines: list[str] = []
    line: list[str] = []
    title = lang = None
    links: list[str] = []
    hidden, depth, pre = "", 0, 0  # the element being skipped, with its depth of nesting

    def end_line() -> None:
        if line:
            if shown := _one_line("".join(line)):
                lines.append(shown)
            line.clear()

    def show(s: str) -> None:
        s = html.unescape(s)
        if pre and "\n" in s:
            for part in s.split("\n"):
                line.append(part)
                end_line()
        else:
            line.append(s)

    at, find = 0, _TOKEN.search
    while m := find(page, at):
        if m.start() > at and not hidden:
            show(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if hidden:  # template and svg may nest
            if name == hidden:
                depth += -1 if closing else not m[3].endswith("/")
                hidden = hidden if depth else ""
            if not closing and name in RAW:
                stop = _END[name].search(page, at)
                at = stop.start() if stop else len(page)
            continue
        if name in BLOCK:
            end_line()
            if name == "pre":
                pre = max(0, pre + (-1 if closing else 1))
        if closing:
            continue
        if name == "a":
            if (href := _attribute(m[3], "href")) is not None:
                links.append(_one_line(href))
        elif name == "html" and lang is None:
            lang = _one_line(_attribute(m[3], "lang") or "")
        elif name in RAW:
            stop = _END[name].search(page, at)
            inner = page[at : stop.start() if stop else len(page)]
            at = stop.start() if stop else len(page)
            if name == "title" and title is None:
                title = _one_line(html.unescape(inner))
            if name not in HIDDEN:
                show(inner)
        elif name in HIDDEN and not m[3].endswith("/"):
            hidden, depth = name, 1
    if not hidden:
        show(page[at:])
    end_line()
    return Page(title or "", (lang or "").lower(), links, "\n".join(lines))


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


RESPONSES = T.StructType(
    [T.StructField("page_id", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("record_id", "target_uri", "date")]
    + [T.StructField("http_headers", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.StringType()) for n in ("body", "payload_digest", "block_digest")]
)
DERIVED = T.StructType(
    [T.StructField("page_id", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type")]
    + [T.StructField("content_length", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("block_digest", "source_payload_digest", "source_block_digest")]
    + [T.StructField("source_headers", T.ArrayType(T.StringType())), T.StructField("block", T.StringType()), T.StructField("record", T.BinaryType())]
)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(schema)
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind, strict=True)], schema=kind)


def _flow(rows: Iterator[tuple], schema: T.StructType, size: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records from a table of pages (page_id, url, html), as a crawler would have written them."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), F.monotonically_increasing_id().alias("place"))

    def rows(batches):
        for b in batches:
            for page, url, body, place in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                url, raw = url or "", (body or "").encode()
                headers = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(raw)}"]
                block = "\r\n".join([*headers, "", ""]).encode() + raw
                payload = _digest(raw)
                yield page, _id("response", page, url, payload, place), url, date, headers, body or "", payload, _digest(block)

    return pages.mapInArrow(lambda it: _flow(rows(it), RESPONSES), RESPONSES)


def derive(source: DataFrame) -> DataFrame:
    """The metadata and the conversion record of every response."""

    def rows(batches):
        for b in batches:
            for page, rid, url, date, headers, body, payload, block in zip(*(b.column(n).to_pylist() for n in RESPONSES.names), strict=True):
                url, date, headers, body = url or "", date or "", headers or [], body or ""
                meta, conv = _id("metadata", rid), _id("conversion", rid)
                seen = read_page(body)
                fields = [("title", seen.title), ("lang", seen.lang)]
                fields += [("source-header", " ".join(h.split())) for h in headers] + [("source-payload-digest", payload or ""), ("source-block-digest", block or "")]
                fields += [("outlink", f"{link} L a/@href") for link in seen.links]
                made = (("metadata", meta, conv, "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields)), ("conversion", conv, meta, "text/plain; charset=utf-8", seen.text))
                for kind, own, other, content, text in made:
                    raw = text.encode("utf-8", "replace")
                    head = [("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Refers-To", rid or ""), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date)]
                    head += [("WARC-Concurrent-To", other), ("WARC-Block-Digest", _digest(raw)), ("Content-Type", content)]
                    yield page, kind, own, rid, other, url, date, content, len(raw), _digest(raw), payload, block, headers, text, _record(kind, head, raw)

    return source.select(*RESPONSES.names).mapInArrow(lambda it: _flow(rows(it), DERIVED), DERIVED)


#: What ends a record and begins the next one, and the longest block that may hold this itself.
BETWEEN, LARGEST = b"\r\n\r\nWARC/", 1 << 30


def _head(piece: bytes) -> tuple[dict[str, str], int, int] | str:
    """Fields (names in lower case) of a record, where its block begins, and its length; or what is wrong."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return "the header has no end"
    lines = piece[:end].decode("utf-8", "replace").split("\r\n")[1:]
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = head.get("content-length", "")
    if not (size.isascii() and size.isdigit()) or int(size) > LARGEST:
        return f"no valid length: {size[:40]!r}"
    return head, end + 4, int(size)


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes] | str]:
    """Records (fields, block) of one file, given as what stands between ``BETWEEN``; a text where a record isn't whole.

    A block may hold ``BETWEEN`` itself: pieces are joined as long as the record's length asks for it. If that ends within
    a later piece, the length is wrong, and the next record is looked for in the next piece.
    """
    source, waiting = iter(pieces), deque()
    while True:
        piece = waiting.popleft() if waiting else next(source, None)
        if piece is None:
            return
        if not piece.strip():
            continue
        found = _head(piece)
        if isinstance(found, str):
            yield found
            continue
        head, at, size = found
        have, taken, more = len(piece) - at, [], None
        while have < size:
            i = len(taken)
            more = waiting[i] if i < len(waiting) else next(source, None)
            if more is None:
                break
            if i >= len(waiting):
                waiting.append(more)
            taken.append(more)
            have += len(BETWEEN) + len(more)
        # The last record of a file still has the line ends that follow it.
        if have < size or (taken and have > size and taken[-1][size - have :].strip()):
            yield f"cut off: {len(piece) - at} of {size} bytes"
            continue
        for _ in taken:
            waiting.popleft()
        yield head, (BETWEEN.join([piece[at:], *taken]) if taken else piece[at:])[:size]


def split(data: bytes) -> list[bytes]:
    """The pieces of a whole file in memory."""
    return data.split(BETWEEN)


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """``path, piece``: files (plain or gzip) by Spark's text reader, plain ones in several tasks."""
    lines = spark.read.option("lineSep", BETWEEN.decode()).option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("piece"))


def _by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
    rows = ((p, x) for b in batches for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    for path, group in groupby(rows, key=itemgetter(0)):
        yield path, (x for _, x in group)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Source: the whole response records of WARC files (plain or gzip), as ``responses`` makes them."""

    def rows(batches):
        task = TaskContext.get().partitionId()
        for file, pieces in _by_file(batches):
            for n, found in enumerate(parse(pieces)):
                if isinstance(found, str) or found[0].get("warc-type") != "response":
                    continue
                head, block = found
                http, _, body = block.partition(b"\r\n\r\n")
                digests = head.get("warc-payload-digest", _digest(body)), head.get("warc-block-digest", _digest(block))
                yield None, head.get("warc-record-id") or _id("response", file, task, n, digests[1]), head.get("warc-target-uri"), head.get("warc-date"), http.decode("utf-8", "replace").split("\r\n"), body.decode("utf-8", "replace"), *digests

    return _scan(spark, path).mapInArrow(lambda it: _flow(rows(it), RESPONSES), RESPONSES)


def problems(spark: SparkSession, path: str) -> DataFrame:
    """``path, problem``: records of WARC files that aren't whole."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("problem", T.StringType())])

    def rows(batches):
        for file, pieces in _by_file(batches):
            yield from ((file, found) for found in parse(pieces) if isinstance(found, str))

    return _scan(spark, path).mapInArrow(lambda it: _flow(rows(it), schema), schema)
