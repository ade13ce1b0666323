"""WARC archives: one gzip member a record, written from rows and read back as a byte stream."""

from __future__ import annotations

import base64
import hashlib
import itertools
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import free_names, saved, ship, trimmed

DATE = "2020-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def write_record(page: str, url: str | None, payload: bytes, refers_to: str | None = None, level: int = 6) -> bytes:
    """One gzip member: a response with its payload, or a revisit that keeps the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url or '')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass")
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def members(chunks: Iterable[bytes], step: int = 1 << 16) -> Iterator[Iterator[bytes]]:
    """For each gzip member of a byte stream, its content in pieces of at most ``step`` bytes.

    Chunks may cut members anywhere.  A member must be used up before the next is asked for.
    """
    source, rest = iter(chunks), b""

    def content() -> Iterator[bytes]:
        nonlocal rest
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            data = unpack.unconsumed_tail or rest
            if not unpack.unconsumed_tail:
                rest = b""
                if not data:
                    data = next(source, b"")
            piece = unpack.decompress(data, step)
            if not data and not piece and not unpack.eof:
                raise ValueError("the archive ends within a member")
            if piece:
                yield piece
        rest = unpack.unused_data

    while True:
        while not rest:
            rest = next(source, None)
            if rest is None:
                return
        yield content()


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _text(head: bytes) -> str:
    try:
        return head.decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return head.decode("latin-1")


class _Digest:
    """A stated digest (``algorithm:value``, base32 or hexadecimal) and what the bytes give; SHA-1 if none is stated."""

    def __init__(self, stated: str | None):
        algorithm, _, self.value = (stated or "sha1:").partition(":")
        name = algorithm.lower().replace("-", "")
        self.known = name in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")
        self.state = hashlib.new(name if self.known else "sha1", usedforsecurity=False)

    def differs(self) -> bool:
        raw = self.state.digest()
        base32 = base64.b32encode(raw).decode().rstrip("=")
        return self.known and self.value != "" and self.value.upper().rstrip("=") not in (base32, raw.hex().upper())


class _Dechunked:
    """Takes a chunked body in pieces and hands on its content; stops where it is malformed."""

    def __init__(self, into):
        self.into, self.rest, self.left, self.ended = into, b"", 0, False

    def update(self, data: bytes) -> None:
        self.rest += data
        while self.rest and not self.ended:
            if self.left > 2:
                content = self.rest[: self.left - 2]
                self.into.update(content)
                self.rest, self.left = self.rest[len(content) :], self.left - len(content)
            elif self.left:
                cut = min(self.left, len(self.rest))
                self.rest, self.left = self.rest[cut:], self.left - cut
            else:
                line, found, after = self.rest.partition(b"\r\n")
                if not found:
                    return
                try:
                    size = int(line.partition(b";")[0].strip(), 16)
                except ValueError:
                    size = 0
                # the content and the line end after it
                self.rest, self.left, self.ended = after, size + 2, size <= 0


def read_records(chunks: Iterable[bytes], keep_payload: bool = True) -> Iterator[dict]:
    """Records of an archive of any type, read in order: framing, and digests where stated, verified.

    Records are framed by their own Content-Length alone.  Only responses and revisits of HTTP
    have an HTTP head, which may be missing; the block of all others is their payload.  A payload
    digest is that of the body as it is stored or, if it is chunked, of its content.

    Gives dicts with ``headers`` (names in lower case), ``payload`` (None for revisits, or when
    not kept), ``payload_bytes`` (for revisits the length the HTTP head states, if any) and
    ``payload_digest`` (as stated, else computed; None for revisits without one).  Raises
    ValueError where the framing or a digest is wrong.  Payloads are digested piece by piece.
    """
    for member in members(chunks):
        buffer = b""
        for piece in member:
            buffer += piece
            if b"\r\n\r\n" in buffer:
                break
        head, found, buffer = buffer.partition(b"\r\n\r\n")
        lines = _text(head).split("\r\n")
        if not found or not lines[0].startswith("WARC/"):
            raise ValueError("a member is no WARC record")
        headers = _fields(lines[1:])
        left, kind = int(headers["content-length"]), headers["warc-type"]
        revisit = kind == "revisit"
        has_http = kind in ("response", "revisit") and headers.get("content-type", "application/http").lower().startswith("application/http")
        block_digest, payload_digest = _Digest(headers.get("warc-block-digest")), _Digest(headers.get("warc-payload-digest"))
        content_digest = _Digest(headers.get("warc-payload-digest"))
        dechunked = _Dechunked(content_digest.state)
        kept, http, body, stated = [], b"", None if has_http else 0, {}

        def take(data: bytes) -> None:
            nonlocal http, body, stated
            block_digest.state.update(data)
            if body is None:
                http += data
                if b"\r\n\r\n" not in http:
                    return
                http, _, data = http.partition(b"\r\n\r\n")
                body, stated = 0, _fields(_text(http).split("\r\n")[1:])
            body += len(data)
            payload_digest.state.update(data)
            if "chunked" in stated.get("transfer-encoding", "").lower():
                dechunked.update(data)
            if keep_payload and data:
                kept.append(data)

        trailer = b""
        while True:
            take(buffer[:left])
            trailer += buffer[left:]
            left -= min(left, len(buffer))
            buffer = next(member, b"")
            if not buffer:
                break
        if left or trailer != b"\r\n\r\n":
            raise ValueError("content length and record differ")
        if block_digest.differs():
            raise ValueError("block digest differs")
        chunked = "chunked" in stated.get("transfer-encoding", "").lower()
        if not revisit and payload_digest.differs() and not (chunked and not content_digest.differs()):
            raise ValueError("payload digest differs")
        size, digest = body or 0, headers.get("warc-payload-digest")
        if revisit:
            length = stated.get("content-length", "")
            size = int(length) if length.isdecimal() else None
        elif digest is None:
            digest = "sha1:" + base64.b32encode(payload_digest.state.digest()).decode()
        payload = None if revisit or not keep_payload else b"".join(kept)
        yield {"headers": headers, "payload": payload, "payload_bytes": size, "payload_digest": digest}


ARCHIVE_DDL = "archive string, bytes binary"


def write_archives(pages: DataFrame, *, archive_bytes: int = 1 << 22, level: int = 6) -> DataFrame:
    """Archives as a table (archive, bytes) in the shared folder: each row is a ``.warc.gz`` file.

    Takes page_id, url, html and refers_to (null for responses).  A task streams its rows into
    records and begins another archive once one has ``archive_bytes``, so a row is at most a
    record longer than that.  Spark's committer writes the table, so a lost executor leaves no
    half archive behind.  A null page_id is written as an empty name, null html as an empty
    payload; other columns are ignored, and an empty table gives no archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def archive() -> pa.RecordBatch:
            name = f"{task:06d}-{number:06d}.warc.gz"
            return pa.RecordBatch.from_pydict({"archive": [name], "bytes": pa.array([b"".join(held)], pa.binary())})

        for batch in batches:
            for page, url, html, to in zip(*(batch.column(i) for i in range(4)), strict=True):
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                held.append(write_record(page.as_py(), url.as_py(), payload, to.as_py(), level))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield archive()
                    number, held, size = number + 1, [], 0
        if held:
            yield archive()

    ship(pages.sparkSession)
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page"),
        "url",
        "html",
        F.col("refers_to").cast("string"),
    )
    return saved(rows.mapInArrow(trimmed(run), ARCHIVE_DDL), "warc")


RECORD_DDL = "page_id bigint, record_type string, url string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary, record_id string"


def read_archives(archives: DataFrame, *, keep_payload: bool = True, step: int = 1 << 16) -> DataFrame:
    """Read archives (archive, bytes) back into records, each from front to back in steps of ``step`` bytes.

    Archives are whole in themselves, so none needs another and no row is shuffled.  Framing
    and digests are verified; an archive that fails ends the job with its name and the reason.
    ``page_id`` and ``refers_to`` are null where the record was not written by ``write_archives``.
    Other columns are ignored, and no archive gives no record.
    """
    ship(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from keystrata.llm.warc import _rows_of

        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                view = data.as_buffer()
                yield from _rows_of(name.as_py(), (view[i : i + step].to_pybytes() for i in range(0, view.size, step)), keep_payload)

    return archives.select("archive", "bytes").mapInArrow(trimmed(run), RECORD_DDL)


def _page(name: str) -> int | None:
    inner = name.removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if name == f"<urn:page:{inner}>" and inner.removeprefix("-").isdecimal() else None


def _rows_of(name: str, pieces: Iterable[bytes], keep_payload: bool) -> Iterator[pa.RecordBatch]:
    """The records of one archive in batches of some megabytes."""
    found: list[tuple] = []
    size = 0
    try:
        for record in read_records(pieces, keep_payload):
            h = record["headers"]
            found.append(
                (
                    _page(h.get("warc-record-id", "")),
                    h["warc-type"],
                    h.get("warc-target-uri"),
                    record["payload_bytes"],
                    (record["payload_digest"] or "").removeprefix("sha1:") or None,
                    _page(h.get("warc-refers-to", "")),
                    record["payload"],
                    h.get("warc-record-id"),
                )
            )
            size += len(record["payload"] or b"") + 200
            if size > 1 << 22:
                yield _records(found)
                found, size = [], 0
    except (ValueError, KeyError, zlib.error) as e:
        raise ValueError(f"{name}: {e}") from e
    yield _records(found)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {
        "page_id": pa.int64(),
        "record_type": pa.string(),
        "url": pa.string(),
        "payload_bytes": pa.int64(),
        "payload_digest": pa.string(),
        "refers_to": pa.int64(),
        "payload": pa.binary(),
        "record_id": pa.string(),
    }
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


FILES_DDL = "archive string, n_bytes bigint, n_records bigint"


def _shared(folder: str):
    """A folder as a file system and a path in it: ``file:``, or what else pyarrow knows."""
    from pyarrow import fs

    place, path = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
    return place, path.rstrip("/")


def _put(place, path: str, pieces: Iterable[bytes]) -> int:
    """Write a file aside and give it its name when it is whole, so that a task that is lost or runs
    twice leaves no half file."""
    import uuid

    folder, _, name = path.rpartition("/")
    aside, size = f"{folder}/.{name}.{uuid.uuid4().hex}", 0
    with place.open_output_stream(aside) as out:
        for piece in pieces:
            out.write(piece)
            size += len(piece)
    place.move(aside, path)
    return size


def write_warc_files(pages: DataFrame, folder: str, *, archive_bytes: int = 1 << 26, level: int = 6) -> DataFrame:
    """Write pages as ``.warc.gz`` files into a folder that every executor sees; gives them as a table
    (archive, n_bytes, n_records) in the shared folder.

    Takes page_id, url, html and refers_to (null for responses).  A task streams its rows into
    one file after the other, of ``archive_bytes`` or a record more; it holds one record at a
    time.  Files bear an attempt's name, and the table, which Spark's committer writes, lists those
    of the attempts that counted.  Nulls are as in ``write_archives``; no page gives no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        from keystrata.llm.warc import _put, _shared, write_record

        place, base = _shared(folder)
        attempt = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        rows = (row for batch in batches for row in zip(*(batch.column(i) for i in range(4)), strict=True))
        made: list[tuple] = []

        def records() -> Iterator[bytes]:
            size = n = 0
            for page, url, html, to in rows:
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                record = write_record(page.as_py(), url.as_py(), payload, to.as_py(), level)
                size, n = size + len(record), n + 1
                counts[0] = n
                yield record
                if size >= archive_bytes:
                    return

        for number in range(1 << 62):
            first = next(rows, None)
            if first is None:
                break
            rows = itertools.chain([first], rows)
            counts, name = [0], f"{base}/{attempt}-{number:06d}.warc.gz"
            size = _put(place, name, records())
            made.append((f"{folder.rstrip('/')}/{attempt}-{number:06d}.warc.gz", size, counts[0]))
        names, sizes, numbers = zip(*made, strict=True) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(numbers, pa.int64())], ["archive", "n_bytes", "n_records"])

    ship(pages.sparkSession)
    _shared(folder)[0].create_dir(_shared(folder)[1], recursive=True)
    rows = pages.select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page"), "url", "html", F.col("refers_to").cast("string"))
    return saved(rows.mapInArrow(trimmed(run), FILES_DDL), "warc-files")


def read_warc_files(archives: DataFrame, *, keep_payload: bool = True, step: int = 1 << 16) -> DataFrame:
    """Read the ``.warc.gz`` files named in column ``archive``, each as one stream in steps of ``step`` bytes.

    Of a file no more is held than a record.  Files are dealt to tasks by their place in the
    table; an archive that fails ends the job with its name and the reason.
    """
    ship(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from keystrata.llm.warc import _rows_of, _shared

        def pieces(name: str) -> Iterator[bytes]:
            folder, _, file = name.rpartition("/")
            place, base = _shared(folder)
            with place.open_input_stream(f"{base}/{file}", compression=None) as stream:
                while data := stream.read(step):
                    yield data

        for batch in batches:
            for name in batch.column(0).to_pylist():
                yield from _rows_of(name, pieces(name), keep_payload)

    tasks = archives.sparkSession.sparkContext.defaultParallelism
    return archives.select("archive").repartition(max(tasks, 1), F.xxhash64("archive")).mapInArrow(trimmed(run), RECORD_DDL)


def write_files(archives: DataFrame, folder: str) -> int:
    """Write archives (archive, bytes) as ``.warc.gz`` files into a folder every executor sees; gives their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from keystrata.llm.warc import _put, _shared

        place, base = _shared(folder)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _put(place, f"{base}/{name}", [data])
            yield pa.RecordBatch.from_pydict({"written": pa.array([batch.num_rows], pa.int64())})

    ship(archives.sparkSession)
    return archives.select("archive", "bytes").mapInArrow(run, "written bigint").agg(F.coalesce(F.sum("written"), F.lit(0))).first()[0]


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """The ``.warc.gz`` files under a path as archives (archive, bytes); a file must fit a row (2 GB)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return files.select(F.col("path").alias("archive"), F.col("content").alias("bytes"))


def with_revisits(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Add ``refers_to``: of pages with equal payloads of at least ``min_bytes``, the largest page_id
    answers and the others refer to it.

    Payloads are told apart by SHA-256 and length.  Groups are found on (page_id, digest) rows
    without the html, combined map-side; only rows that do refer are joined back, by page_id
    and digest, so a payload held by a third of all pages meets in no single task.  Rows that
    repeat one page are all responses; a null page_id never answers unless nothing else does.
    All columns are kept but one named ``refers_to``, which is replaced.  An empty table gives
    an empty result.
    """
    own, page, same = free_names(pages, 3)
    digest = F.unhex(F.sha2(F.coalesce(F.col("html"), F.lit("")), 256))
    size = F.octet_length(F.coalesce(F.col("html"), F.lit("")))
    keys = pages.select("page_id", digest.alias("digest"), size.alias("size")).where(F.col("size") >= min_bytes)
    thin = saved(keys, "warc-keys")
    best = thin.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    refer = (
        thin.join(best.where("n > 1"), ["digest", "size"])
        .where("page_id < refers_to")
        .select(F.col("page_id").alias(page), F.col("digest").alias(same), "refers_to")
        .distinct()
    )
    rows = pages.drop("refers_to").withColumn(own, digest)
    return rows.join(refer, (rows["page_id"] == refer[page]) & (rows[own] == refer[same]), "left").drop(own, page, same)
