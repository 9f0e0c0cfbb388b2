"""WARC derivatives: from each response a metadata record and a plain-text conversion record that refer to it.

Records are linked as WARC 1.1 asks: a derivative carries its own id, the response's id in WARC-Refers-To, the target
URI, the date and the digests. Responses come from WARC files, with their own ids, dates and digests, or from a table of
pages. Ids are name-based UUIDs of what a record holds, so a repeated run gives the same files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

SCHEMA = ("page_id long, warc_type string, record_id string, refers_to string, target_uri string, date string, "
          "content_type string, content_length long, block_digest string, payload_digest string, title string, "
          "lang string, n_links long, source_headers string, block string")
FIELDS = [part.split()[0] for part in SCHEMA.split(", ")]
KNOWN = ["date", "record_id", "payload_digest", "block_digest"]
RESPONSE = ["record_id", "url", "date", "headers", "html", "payload_digest", "block_digest"]
CHARSET = re.compile(r"^content-type:[^\r\n]*?\bcharset=[\"']?([\w-]+)", re.I | re.M)
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:plyframe:warc")
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
BREAKS = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|main|aside|blockquote|"
                    r"pre|dl|dt|dd|form|hr|body|head|html|option|figure|figcaption)\b[^<>]*>", re.I)
CELLS = re.compile(r"</?t[dh]\b[^<>]*>", re.I)
TAGS = re.compile(r"<[!/?a-z][^<>]*>", re.I)
TITLE = re.compile(r"<title\b[^<>]*>", re.I)
TITLE_END = re.compile(r"</title\s*>", re.I)
LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)
LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=", re.I)
BLANKS = re.compile(r"[ \t\r\f\v ]+")
LINES = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_text(page: str) -> str:
    """The visible text: hidden elements go, block elements end lines, entities are decoded, blanks are squeezed."""
    text = TAGS.sub("", CELLS.sub(" ", BREAKS.sub("\n", HIDDEN.sub(" ", page.replace("\n", " ")))))
    return LINES.sub("\n", BLANKS.sub(" ", entities.unescape(text))).strip()


def title(page: str) -> str | None:
    """What stands between the first title tag and the first end of one after it."""
    start = TITLE.search(page)
    end = TITLE_END.search(page, start.end()) if start else None
    return BLANKS.sub(" ", entities.unescape(page[start.end() : end.start()]).replace("\n", " ")).strip() if end else None


def _id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(parts))}>"


def derived(page_id: int | None, url: str | None, page: str | None, date: str, headers: str | None, record: str | None = None,
            payload: str | None = None, response: str | None = None) -> list[tuple]:
    """The metadata and the conversion record of one response, as tuples in the order of FIELDS. Id and digests of the
    response are computed where they are not given."""
    uri, body = url or "", (page or "").encode("utf-8", "replace")
    if headers is None:
        headers = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n"
    payload, response = payload or digest(body), response or digest(headers.encode() + b"\r\n" + body)
    source = record or _id("response", uri, date, response)
    name = title(page or "")
    lang = LANG.search(page or "")
    links = len(LINK.findall(page or ""))
    fields = [("source-record-id", source), ("source-payload-digest", payload), ("source-block-digest", response)]
    fields += [(f"source-{k.strip().lower()}", v.strip()) for k, _, v in (x.partition(":") for x in headers.split("\r\n")[1:] if x)]
    fields += [("title", name)] * bool(name) + [("language", lang[1] if lang else "")] * bool(lang) + [("links", str(links))]
    about = "".join(f"{k}: {v}\r\n" for k, v in fields)
    out = []
    for kind, mime, block in (("metadata", "application/warc-fields", about), ("conversion", "text/plain; charset=utf-8", plain_text(page or ""))):
        data = block.encode("utf-8", "replace")
        own = digest(data)
        out.append((page_id, kind, _id(kind, source, own), source, url, date, mime, len(data), own,
                    payload if kind == "metadata" else own, name, lang[1] if lang else None, links, headers, block))
    return out


def serialised(record: dict) -> bytes:
    """One record as the bytes of a WARC file."""
    named = [("WARC-Type", record["warc_type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Date", record["date"]),
             ("WARC-Target-URI", record["target_uri"]), ("WARC-Refers-To", record["refers_to"]),
             ("WARC-Block-Digest", record["block_digest"]), ("Content-Type", record["content_type"]),
             ("Content-Length", str(record["content_length"]))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named if v is not None)
    return head.encode() + b"\r\n" + record["block"].encode("utf-8", "replace") + b"\r\n\r\n"


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an open WARC file, one after the other, as (headers by lower-case name, block)."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head.get("content-length", 0))
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a WARC record ends before its length")
        yield head, block


def _response(head: dict[str, str], block: bytes) -> tuple:
    top, _, body = block.partition(b"\r\n\r\n")
    headers = top.decode("utf-8", "replace") + "\r\n"
    named = CHARSET.search(headers)
    try:
        text = body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    return (head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), headers, text,
            head.get("warc-payload-digest") or digest(body), head.get("warc-block-digest") or digest(block))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """record_id, url, date, headers, html, payload_digest, block_digest of each HTTP response in WARC files, plain or
    gzipped record by record, as `derivatives` takes them.

    Each file is read by one task, which holds one record at a time; crawls write files of about a gigabyte. A file cut
    short fails; a missing header is null, a missing digest is computed. A body is decoded by the charset that its
    headers name, else as UTF-8.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    schema = pa.schema([(c, pa.string()) for c in RESPONSE])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name in batch["path"].to_pylist():
                system, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                with system.open_input_stream(at, compression=None) as raw:
                    start = raw.read(2)
                with system.open_input_stream(at, compression=None) as raw:
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if start == b"\x1f\x8b" else raw, 1 << 20)
                    rows: list[tuple] = []
                    held = 0
                    for head, block in records(stream):
                        if head.get("warc-type") == "response" and head.get("content-type", "").startswith("application/http"):
                            rows.append(_response(head, block))
                            held += len(block)
                            if held > 8_000_000:
                                yield _rows(rows, schema)
                                rows, held = [], 0
                    yield _rows(rows, schema)

    count = max(1, files.count())
    return files.repartition(count).mapInArrow(work, ", ".join(f"{c} string" for c in RESPONSE))


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def derivatives(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html",
                date: str = "1970-01-01T00:00:00Z", headers: str | None = None, of: dict[str, str] | None = None) -> DataFrame:
    """Two rows for each response, one record each; `headers` names a column with the response's HTTP headers, and `of`
    the columns of what else is known of the response: its date, record_id, payload_digest, block_digest.

    A null page is an empty one, a null URL gives records without a target; without a headers column, or where it is
    null, the headers are those of a plain 200 answer, and likewise `date` is the date and ids and digests are computed. Repeated rows give records with equal ids and content. An empty
    table gives no rows; columns of other names are not read. Every page is a task's own work: nothing is shuffled.
    """
    source = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                          F.col(html).cast("string").alias("html"),
                          (F.col(headers) if headers else F.lit(None)).cast("string").alias("headers"),
                          *((F.col(of[c]) if of and c in of else F.lit(None)).cast("string").alias(c) for c in KNOWN))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                rows = batch.slice(at, 200).to_pylist()
                made = [x for r in rows for x in derived(r["page_id"], r["url"], r["html"], r["date"] or date, r["headers"], *(r[c] for c in KNOWN[1:]))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in made], pa.int64() if f in ("page_id", "content_length", "n_links") else pa.string())
                     for i, f in enumerate(FIELDS)], FIELDS)

    return source.mapInArrow(work, SCHEMA)


def _register(spark: SparkSession) -> None:
    # Classes are made here so that they travel to the workers by value.
    class Draft(WriterCommitMessage):
        def __init__(self, name):
            self.name = name

    class Writer(DataSourceArrowWriter):
        def __init__(self, options):
            self.folder = options["path"].rstrip("/")

        def place(self):
            from pyarrow import fs

            return fs.FileSystem.from_uri(self.folder) if ":/" in self.folder else (fs.LocalFileSystem(), self.folder)

        def write(self, iterator):
            import gzip
            import uuid

            filesystem, base = self.place()
            filesystem.create_dir(f"{base}/_drafts", recursive=True)
            name, rows = uuid.uuid4().hex, 0
            with filesystem.open_output_stream(f"{base}/_drafts/{name}", compression=None) as out:
                for batch in iterator:
                    for record in batch["warc"].to_pylist():
                        out.write(gzip.compress(record, mtime=0))  # a member for each record, as readers expect
                        rows += 1
            if not rows:
                filesystem.delete_file(f"{base}/_drafts/{name}")
            return Draft(name if rows else None)

        def commit(self, messages):
            filesystem, base = self.place()
            for number, name in enumerate(m.name for m in messages if m and m.name):
                filesystem.move(f"{base}/_drafts/{name}", f"{base}/part-{number:05d}.warc.gz")

        def abort(self, messages):
            filesystem, base = self.place()
            for name in (m.name for m in messages if m and m.name):
                filesystem.delete_file(f"{base}/_drafts/{name}")

    class WarcFiles(DataSource):
        @classmethod
        def name(cls):
            return "warc_files"

        def schema(self):
            return "warc BINARY"

        def writer(self, schema, overwrite):
            return Writer(self.options)

    spark.dataSource.register(WarcFiles)


def write_warc(made: DataFrame, folder: str) -> None:
    """Write the records of `derivatives` as .warc.gz files of `folder`, one for each task, a gzip member for each record.

    Files get their names when the whole job commits: a failed or repeated task leaves none.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"warc": [serialised(r) for r in batch["record"].to_pylist()]}, pa.schema([("warc", pa.binary())]))

    _register(made.sparkSession)
    lines = made.select(F.struct(*FIELDS).alias("record")).mapInArrow(work, "warc binary")
    lines.write.format("warc_files").mode("append").save(folder)
