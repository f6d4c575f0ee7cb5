"""WARC derivatives: metadata and plain-text conversion records for response records.

Each response gives two records that refer to it: ``metadata`` (application/warc-fields: title, language, charset,
status, source headers and links) and ``conversion`` (text/plain).  Both keep the response's target URI and date,
name it in WARC-Refers-To with its target and date, and carry its payload digest; every block has a SHA-1 digest
of its own.  Identifiers are made from the source identifier and the kind, so a task that runs twice writes the
same records.  ``write_records`` stores a gzip member per record with an index, ``read_records`` reads them back.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import table
from leadloom.llm.elias_fano import _filesystem
from leadloom.scratch import Scratch

VERSION, DATE = "WARC/1.1", "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
_DROP = re.compile(r"(?i)<!--|<(script|style|noscript|template|head)\b|<!doctype[^>]*>")
_CLOSE = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "noscript", "template", "head")}
_BLOCK = re.compile(r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>")
_TAG = re.compile(r"<[^>]*>")
_OPEN = {name: re.compile(rf"(?i)<{name}\b([^>]*)>") for name in ("a", "html", "meta", "title")}
_TITLE_END = re.compile(r"(?i)</title")
_LANG = re.compile(r"""(?i)\blang\s*=\s*["']?([A-Za-z-]+)""")
_CHARSET = re.compile(r"""(?i)\bcharset\s*=\s*["']?([A-Za-z0-9_-]+)""")
_HREF = re.compile(r"""(?i)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324 the format's usual digest


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '|'.join(map(str, parts)))}>"


def build(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    """One record; digest and length are added, and line breaks in values become blanks."""
    lines = [VERSION, f"WARC-Type: {kind}"] + [f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in headers.items() if v is not None]
    lines += [f"WARC-Block-Digest: {digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at a position; header names are lower-cased."""
    stop = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:stop].decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = int(headers["content-length"])
    block = data[stop + 4 : stop + 4 + size]
    if len(block) < size:
        raise ValueError("the record is cut off")
    return headers, block, stop + 4 + size + 4


def http_parts(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers (names lower-cased) and body of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, body


def response(page_id: object, url: str | None, html: str | None, date: str = DATE) -> bytes:
    """A response record for a page; a null page is an empty body, a null URL is written as ``unknown:``."""
    body = (html or "").encode("utf-8", "surrogatepass")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    headers = {"WARC-Record-ID": record_id("response", page_id, url, digest(body)), "WARC-Target-URI": url or "unknown:", "WARC-Date": date, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": digest(body)}
    return build("response", headers, block)


def _tagged(html: str) -> tuple[str, str]:
    """The part up to the last ``>``, in which every ``<`` has an end, so that patterns of tags take linear time, and the rest."""
    at = html.rfind(">") + 1
    return html[:at], html[at:]


def _visible(html: str) -> str:
    """Without comments, scripts, styles, templates, the head and the document type; what is never closed goes to the end.

    Only a head that is closed goes, as its end tag may be left out.
    """
    tagged, rest = _tagged(html)
    out, at, open_head = [], 0, False
    while m := _DROP.search(tagged, at):
        name = (m[1] or "").lower()
        if not name and not m[0].startswith("<!--"):
            end = m.end()
        elif name == "head" and open_head:
            end = -1
        else:
            close = _CLOSE[name].search(tagged, m.end()) if name else None
            end = close.end() if close else tagged.find("-->", m.end()) + 3 if not name else 2
            if end == 2:  # never closed
                if name != "head":
                    return "".join(out) + tagged[at : m.start()] + " "
                open_head, end = True, -1
        out += [tagged[at : m.start()], " "] if end >= 0 else [tagged[at : m.end()]]
        at = end if end >= 0 else m.end()
    return "".join(out) + tagged[at:] + rest


def plain_text(html: str) -> str:
    """Visible text: scripts, styles, comments and the head go, blocks end lines, blanks collapse."""
    return _lines(_visible(html))


def _lines(visible: str) -> str:
    tagged, rest = _tagged(visible)
    text = _TAG.sub("", _BLOCK.sub("\n", tagged)) + rest
    lines = (" ".join(line.split()) for line in entities.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def _attribute(tagged: str, tag: str, pattern: re.Pattern) -> str:
    """What the pattern finds in the first tag of a name that holds it, or an empty text."""
    return next((m[1] for t in _OPEN[tag].finditer(tagged) if (m := pattern.search(t[1]))), "")


def title_of(html: str) -> str:
    """The first title in one line, or an empty text."""
    tagged, _ = _tagged(html)
    begin = _OPEN["title"].search(tagged)
    end = _TITLE_END.search(html, begin.end()) if begin else None
    return _one_line(html[begin.end() : end.start()]) if end else ""


def _one_line(text: str) -> str:
    tagged, rest = _tagged(text)
    return " ".join(entities.unescape(_TAG.sub("", tagged) + rest).split())


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while (eol := body.find(b"\r\n", at)) >= 0:
        size = int(body[at:eol].split(b";")[0].strip() or b"0", 16)
        if size == 0:
            break
        out.append(body[eol + 2 : eol + 2 + size])
        at = eol + 2 + size + 2
    return b"".join(out)


def decoded(http: dict[str, str], body: bytes) -> str:
    """A response's body as text: chunks joined, gzip and deflate undone, read in the charset of its header or first meta.

    A body that does not have the form its headers name is taken as it is; an unknown charset is read as UTF-8.
    """
    try:
        if "chunked" in http.get("transfer-encoding", "").lower():
            body = _dechunked(body)
        for code in reversed([c.strip() for c in http.get("content-encoding", "").lower().split(",")]):
            if code in ("gzip", "x-gzip"):
                body = zlib.decompress(body, 47)
            elif code == "deflate":
                body = zlib.decompress(body, 15 if body[:1] == b"\x78" else -15)
    except (ValueError, zlib.error):
        pass
    named = _CHARSET.search(http.get("content-type", ""))
    charset = named[1] if named else _attribute(_tagged(body[:4096].decode("latin-1"))[0], "meta", _CHARSET) or "utf-8"  # a charset stands early
    try:
        return body.decode(charset, "replace")
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace")


def derive(record: bytes) -> list[tuple[str, str, bytes]]:
    """(kind, record id, record) of the metadata and the conversion of a response; other records give none."""
    source, block, _ = parse(record)
    if source.get("warc-type") != "response":
        return []
    status, http, body = http_parts(block)
    html = decoded(http, body)
    origin = source.get("warc-record-id") or record_id("unnamed", digest(record))
    common = {"WARC-Target-URI": source.get("warc-target-uri"), "WARC-Date": source.get("warc-date"), "WARC-Refers-To": origin, "WARC-Refers-To-Target-URI": source.get("warc-target-uri"), "WARC-Refers-To-Date": source.get("warc-date")}
    source_digest = source.get("warc-payload-digest") or digest(body)
    tagged, visible = _tagged(html)[0], _visible(html)
    fields = [("title", title_of(html)), ("languages", _attribute(tagged, "html", _LANG).lower()), ("charset", _attribute(tagged, "meta", _CHARSET).lower()), ("status", status), ("source-payload-digest", source_digest)]
    fields += [(f"source-{k}", v) for k, v in sorted(http.items())]
    hrefs = (m for t in _OPEN["a"].finditer(_tagged(visible)[0]) if (m := _HREF.search(t[1])))
    fields += [("outlink", " ".join(entities.unescape(m[1] or m[2] or m[3] or "").split())) for m in hrefs]
    meta_id, text_id = record_id("metadata", origin), record_id("conversion", origin)
    meta = build("metadata", {"WARC-Record-ID": meta_id, **common, "WARC-Concurrent-To": text_id, "Content-Type": "application/warc-fields"}, "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass"))
    text = _lines(visible).encode("utf-8", "surrogatepass")
    converted = build("conversion", {"WARC-Record-ID": text_id, **common, "WARC-Source-Payload-Digest": source_digest, "WARC-Source-Content-Type": http.get("content-type"), "Content-Type": "text/plain; charset=utf-8"}, text)
    return [("metadata", meta_id, meta), ("conversion", text_id, converted)]


def try_derive(record: bytes | None) -> list[tuple[str, str | None, bytes | None]]:
    """As ``derive``; a null, cut or malformed record gives one row of kind ``unreadable`` that holds its own bytes."""
    try:
        return derive(record) if record else [("unreadable", None, record)]
    except (ValueError, KeyError, IndexError):
        return [("unreadable", None, record)]


def responses(pages: DataFrame) -> DataFrame:
    """(key, record): a response record for each row of ``pages(page_id, url, html)``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [response(*r) for r in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.record_batch({"key": batch.column(0), "record": pa.array(rows, pa.binary())})

    return pages.select("page_id", "url", "html").mapInArrow(make, f"key {pages.schema['page_id'].dataType.simpleString()}, record binary")


def derivatives(records: DataFrame) -> DataFrame:
    """(key, kind, record_id, record): the two derived records of every response in ``records(key, record)``.

    Records of other types give none.  A null, cut or malformed record gives one row of kind ``unreadable`` with a
    null record_id and its own bytes, so that nothing is lost and no job fails; ``write_records`` leaves those out.
    Repeated rows are derived as often as they come.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *d) for k, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for d in try_derive(r)]
            kinds = (batch.schema.field(0).type, pa.string(), pa.string(), pa.binary())
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["key", "kind", "record_id", "record"])

    return records.select("key", "record").mapInArrow(make, f"key {records.schema['key'].dataType.simpleString()}, kind string, record_id string, record binary")


def read_archives(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(key, record) for every record of existing .warc and .warc.gz files, key being path and number.

    A file is one row of the binary reader, which takes files up to 2 GB; archives are usually of 1 GB.  What follows
    a record that can't be read is one last record as it is, which ``derivatives`` calls unreadable.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for lo, rows in _grouped(records_in(data)):
                    yield pa.record_batch({"key": pa.array([f"{path}#{lo + i}" for i in range(len(rows))]), "record": pa.array(rows, pa.binary())})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(split, "key string, record binary")


def records_in(data: bytes) -> Iterator[bytes]:
    """The records of a file's bytes, compressed member by member, as a whole, or not at all."""
    if data[:2] == b"\x1f\x8b":
        rest = data
        while rest[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            try:
                plain = member.decompress(rest)
            except zlib.error:
                yield rest
                return
            yield from records_in(plain) if plain[:2] != b"\x1f\x8b" else [plain]
            rest = member.unused_data
        return
    at = 0
    while at < len(data):
        try:
            end = parse(data, at)[2]
        except (ValueError, KeyError):
            if data[at:].strip():
                yield data[at:]
            return
        yield data[at:end]
        at = end


def _grouped(records: Iterator[bytes], limit: int = 8 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Records in groups of about limit bytes, with the number of the first."""
    lo, held, size = 0, [], 0
    for record in records:
        held.append(record)
        size += len(record)
        if size >= limit:
            yield lo, held
            lo, held, size = lo + len(held), [], 0
    if held:
        yield lo, held


def write_records(derived: DataFrame, root: str, scratch: Scratch, file_bytes: int = 64 << 20) -> DataFrame:
    """Write ``derived(key, kind, record_id, record)`` as .warc.gz files; the index (key, kind, record_id, path, offset, size)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = _filesystem(root)
        fs.create_dir(base, recursive=True)
        out, name, k, at = None, "", 0, 0
        for batch in batches:
            rows = []
            for record in batch.column("record").to_pylist():
                if out is None or at >= file_bytes:
                    if out:
                        out.close()
                    name, k, at = f"{base}/{task.partitionId():06d}-{k:05d}-{task.taskAttemptId()}.warc.gz", k + 1, 0
                    out = fs.open_output_stream(name, compression=None)
                data = gzip.compress(record, 6, mtime=0)
                out.write(data)
                rows.append((name, at, len(data)))
                at += len(data)
            columns = [batch.column(c) for c in ("key", "kind", "record_id")]
            yield pa.record_batch([*columns, *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64())))], names=["key", "kind", "record_id", "path", "offset", "size"])
        if out:
            out.close()

    derived = derived.where("kind <> 'unreadable'")
    index = f"key {derived.schema['key'].dataType.simpleString()}, kind string, record_id string, path string, offset long, size long"
    return scratch.save(derived.mapInArrow(write, index), "index")


def read_records(index: DataFrame, root: str) -> DataFrame:
    """index and ``record``, from the files' own bytes, for whole or partial indexes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(root)
        held, name = None, None
        for batch in batches:
            records = []
            for path, at, size in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "size")), strict=True):
                if path != name:
                    held, name = fs.open_input_file(path), path
                records.append(zlib.decompress(held.read_at(size, at), 31))
            yield pa.record_batch([*(batch.column(i) for i in range(batch.num_columns)), pa.array(records, pa.binary())], names=[*batch.schema.names, "record"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema) + ", record binary"
    return index.mapInArrow(read, schema)


def summaries(read: DataFrame) -> DataFrame:
    """A row per derived record of ``read(key, record)``: identifiers, digests and sizes as its headers and block have them.

    Keys may be null or repeated; no rows give none; a title that the page lacks is empty.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, record in zip(batch.column("key").to_pylist(), batch.column("record").to_pylist(), strict=True):
                h, block, _ = parse(record)
                lines = block.decode("utf-8", "surrogatepass").split("\r\n") if h["warc-type"] == "metadata" else []
                fields = [line.partition(": ")[::2] for line in lines if line]
                title = next((v for k, v in fields if k == "title"), None)
                source = h.get("warc-source-payload-digest") or next((v for k, v in fields if k == "source-payload-digest"), None)
                rows.append((key, h["warc-type"], h["warc-record-id"], h["warc-refers-to"], h["warc-target-uri"], source, h["warc-block-digest"], digest(block) == h["warc-block-digest"], len(block), title, sum(k == "outlink" for k, _ in fields)))
            kinds = (batch.schema.field("key").type, *(pa.string(),) * 6, pa.bool_(), pa.int64(), pa.string(), pa.int64())
            names = ["page_id", "kind", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "digest_ok", "n_bytes", "title", "n_links"]
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return read.mapInArrow(make, f"page_id {read.schema['key'].dataType.simpleString()}, kind string, record_id string, refers_to string, target_uri string, source_digest string, block_digest string, digest_ok boolean, n_bytes long, title string, n_links long")


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows a page, from the files written: a page with a null url or html is an empty response to ``unknown:``."""
    scratch = Scratch(spark, "op8")
    root = scratch.path("warc")
    index = write_records(derivatives(responses(table(spark, sf_dir, "pages"))), root, scratch)
    rows = summaries(read_records(index, root))
    return rows.select(*(F.col(c) for c in rows.columns))
