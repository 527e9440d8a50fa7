"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

A response table has one row per captured response. For each, the builder makes a
metadata record (source headers, digests, outlinks) and a conversion record (plain text),
both of which refer to the response by its record id, target and date, as the WARC 1.1
format asks. Records can be written as WARC files by Spark's text sink and read back.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlens.llm.common import text_slices

#: Date of captures whose source has none.
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
CRLF = "\r\n"

RESPONSE_SCHEMA = "page_id long, record_id string, url string, warc_date string, http_headers string, payload string, payload_digest string, block_digest string"
RECORD_SCHEMA = (
    "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, "
    "content_type string, content_length long, block_digest string, payload_digest string, headers array<struct<name:string,value:string>>, block string"
)

#: Elements of which a reader sees nothing, and those that stand on lines of their own.
HIDDEN = frozenset({"script", "style", "noscript", "template"})
BLOCKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 title article section nav header footer head body blockquote pre".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_BLANK = re.compile(r"[ \t\f\v\xa0]+")
_BETWEEN = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"=?[^\s=/>]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_ENDS = {name: re.compile(rf"(?i)</{name}\s*>") for name in (*HIDDEN, "title")}


@dataclass
class Reading:
    """What one pass over a page gives."""

    text: str
    title: str | None
    lang: str | None
    links: list[str]


def sha1_digest(data: bytes) -> str:
    """A labelled digest as WARC headers have it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_id(*parts: object) -> str:
    """The same urn:uuid for the same parts, so that a rerun makes the same records."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(map(str, parts)))}>"


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


class _Page:
    """A page and where the last of each quote in it stands, so that no search for one is made in vain."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.last = {q: text.rfind(q) for q in "\"'"}

    def attributes(self, at: int) -> tuple[dict[str, str], int]:
        """The attributes from behind a tag's name on, the first of each name, and where the tag ends; -1: it doesn't.

        A quoted value ends with its quote, whatever is inside. A quote that is never closed
        is an ordinary character.
        """
        found: dict[str, str] = {}
        text, size = self.text, len(self.text)
        while True:
            at = _BETWEEN.match(text, at).end()
            if at >= size:
                return found, -1
            if text[at] == ">":
                return found, at + 1
            named = _ATTRIBUTE.match(text, at)
            equals = _EQUALS.match(text, named.end())
            value, at = "", named.end()
            if equals:
                at = equals.end()
                quote = text[at : at + 1]
                if quote in self.last and self.last[quote] > at:
                    end = text.find(quote, at + 1)
                    value, at = text[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(text, at)
                    value, at = bare[0], bare.end()
            found.setdefault(named[0].lower(), value)


def read_page(page: str) -> Reading:
    """Plain text, title, language and links of a page, in one pass from tag to tag.

    A tag begins at < with a letter, /, ! or ? behind it and reaches to the next > outside of
    quoted values; any other < is text, as is a last tag that never ends. Attributes are read
    by their names, quoted or not. Comments and hidden elements reach to their end, or to that
    of the page if they have none. Every search goes on from where the last one ended, and none
    is made again that found nothing, so broken pages take time in proportion to their length.
    """
    held = _Page(page)
    parts: list[str] = []
    titles: list[str] = []
    links: list[str] = []
    lang, at, title_ends = None, 0, True
    while (start := page.find("<", at)) >= 0:
        parts.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            parts.append(" ")
            at = len(page) if end < 0 else end + 3
            continue
        opens = page[start + 1 : start + 2] != "/"
        named = _NAME.match(page, start + 1 if opens else start + 2)
        if named is None:
            if page[start + 1 : start + 2] not in ("/", "!", "?"):
                parts.append("<")
                at = start + 1
                continue
            close, name, found = page.find(">", start), "", {}
            at = close + 1 if close >= 0 else -1
        else:
            name = named[0].lower()
            found, at = held.attributes(named.end())
        if at < 0:
            parts.append(page[start:])
            at = len(page)
            break
        if opens and name in HIDDEN:
            end = _ENDS[name].search(page, at)
            parts.append(" ")
            at = end.end() if end else len(page)
        elif name in BLOCKS:
            parts.append("\n")
        if opens and name == "title" and not titles and title_ends:
            end = _ENDS["title"].search(page, at)
            title_ends = end is not None
            titles += [page[at : end.start()]] if end else []
        elif opens and name == "a" and "href" in found:
            links.append(found["href"])
        elif opens and name == "html" and lang is None:
            lang = found.get("lang", "").strip() or None
    parts.append(page[at:])
    lines = (_BLANK.sub(" ", line).strip() for line in re.split(r"[\r\n]+", html.unescape("".join(parts))))
    return Reading("\n".join(line for line in lines if line), titles[0] if titles else None, lang, links)


def plain_text(page: str) -> str:
    """The text a reader sees: without markup, scripts, styles and comments, one line per block."""
    return read_page(page).text


def _one_line(text: str) -> str:
    return " ".join(html.unescape(text).split())


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """A response table from crawled pages: ids, http headers and digests are derived from the row.

    A null url or page counts as empty. Repeated rows give the same record id.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in chain.from_iterable(text_slices(b, "html") for b in batches):
            rows = []
            for page, url, body in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                url, body = url or "", body or ""
                data = _utf8(body)
                headers = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(data)}"])
                digest = sha1_digest(data)
                rows.append((page, record_id("response", page, url, digest), url, date, headers, body, digest, sha1_digest(_utf8(headers + CRLF * 2) + data)))
            yield _frame(rows, RESPONSE_SCHEMA)

    return pages.selectExpr(f"cast(`{id_col}` as long) as page_id", f"`{url_col}` as url", f"`{html_col}` as html").mapInPandas(run, RESPONSE_SCHEMA)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = re.findall(r"(?:^|, )(\w+) ", schema)
    out = pd.DataFrame(rows, columns=names)
    out["page_id"] = out["page_id"].astype("Int64")
    return out


def _record(row, kind: str, content_type: str, block: str, extra: list[tuple[str, str]]) -> tuple:
    data = _utf8(block)
    own, digest = record_id(kind, row.record_id), sha1_digest(data)
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", own),
        ("WARC-Date", row.warc_date),
        ("WARC-Target-URI", row.url),
        ("WARC-Refers-To", row.record_id),
        *extra,
        ("WARC-Block-Digest", digest),
        ("Content-Type", content_type),
        ("Content-Length", str(len(data))),
    ]
    return row.page_id, kind, own, row.record_id, row.url, row.warc_date, content_type, len(data), digest, row.payload_digest, [{"name": n, "value": v} for n, v in headers], block


def derive(response_table: DataFrame) -> DataFrame:
    """Two records per response, metadata and conversion, in the columns of RECORD_SCHEMA.

    The metadata block is in application/warc-fields: source status and headers, source
    digests, title, language and outlinks in order of appearance. The conversion block is
    the page's plain text; both headers name the response's id, and the conversion also
    its target and date. Pages of any length are read whole, in one pass (see read_page). Null payloads, headers or urls count as empty and still give both
    records; an empty table gives none. Repeated responses give repeated records. Other
    columns are not read, so their names can't clash.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in chain.from_iterable(text_slices(b, "payload") for b in batches):
            rows = []
            for row in batch.itertuples(index=False):
                page, head = read_page(row.payload), row.http_headers.split(CRLF)
                fields = [("source-status", head[0])] + [(f"source-header-{n.strip().lower()}", v.strip()) for n, _, v in (h.partition(":") for h in head[1:]) if n.strip()]
                fields += [("source-payload-digest", row.payload_digest), ("source-block-digest", row.block_digest)]
                if page.title is not None:
                    fields.append(("title", _one_line(page.title)))
                if page.lang:
                    fields.append(("language", page.lang))
                fields += [("outlink", _one_line(link)) for link in page.links]
                block = "".join(f"{n}: {v}{CRLF}" for n, v in fields)
                rows.append(_record(row, "metadata", "application/warc-fields", block, [("WARC-Concurrent-To", record_id("conversion", row.record_id))]))
                refers = [("WARC-Refers-To-Target-URI", row.url), ("WARC-Refers-To-Date", row.warc_date), ("WARC-Source-Payload-Digest", row.payload_digest)]
                rows.append(_record(row, "conversion", "text/plain; charset=utf-8", page.text, refers))
            yield _frame(rows, RECORD_SCHEMA)

    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("record_id", "url", "warc_date", "http_headers", "payload", "payload_digest", "block_digest")]
    return response_table.select("page_id", *texts).mapInPandas(run, RECORD_SCHEMA)


def record_text() -> Column:
    """One record as WARC text, without the two line ends that close it."""
    head = F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), F.regexp_replace(h["value"], r"[\r\n]+", " "), F.lit(CRLF)))
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), F.array_join(head, ""), F.lit(CRLF), F.col("block"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files, one per partition, in any file system Spark writes to."""
    records.select(record_text().alias("value")).write.option("lineSep", CRLF * 2).option("compression", compression).text(path)


_HEADER = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.S)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, headers map, block binary) of the records of WARC files, cut by Content-Length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                while data[:2] == b"\x1f\x8b":  # members follow each other
                    data, rest = b"", data
                    while rest:
                        member = zlib.decompressobj(31)
                        data += member.decompress(rest) + member.flush()
                        rest = member.unused_data
                rows, at = [], 0
                while found := _HEADER.search(data, at):
                    lines = [h.partition(b":") for h in found[1].split(b"\r\n")]
                    headers = {n.strip().decode(): v.strip().decode("utf-8", "replace") for n, _, v in lines}
                    at = found.end() + int(headers.get("Content-Length", 0))
                    rows.append((name, found.start(), headers, data[found.end() : at]))
                yield pd.DataFrame(rows, columns=["file", "offset", "headers", "block"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInPandas(run, "file string, offset long, headers map<string,string>, block binary")


def digest_records(records: DataFrame) -> DataFrame:
    """The records with their block as a SHA-256 digest and their headers as one, for reports."""
    return records.select(
        "page_id",
        "warc_type",
        "record_id",
        "refers_to",
        "target_uri",
        "content_length",
        "block_digest",
        F.sha2("block", 256).alias("block_sha256"),
        F.sha2(record_text(), 256).alias("record_sha256"),
    )
