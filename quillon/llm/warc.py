"""WARC archives: records written by tasks, and a chunked record table read back from them.

Writing: equal payloads are found by their hashes, with partial aggregation, so that a payload with a third of all rows reaches the reducers as one row a
task; only rows that revisit another record are kept as a (narrow) table, which then meets the pages by id and hash. Spark broadcasts that table where its
file size allows, else it splits what is skewed. Each task streams its records into archives of its own, a gzip member a record, in pieces
of the payload, and renames an archive when it is whole; what finished tasks report is the list of archives, so one left by a
lost or repeated task is never read.

Reading: a task takes an archive and unpacks it piece by piece. A payload leaves as rows (record, chunk number, bytes) of a bounded size, each with the SHA-1 of
the payload up to there, carried on from chunk to chunk: the last chunk has that of the whole payload, and no record is ever held
as a whole or gathered again.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from uuid import UUID, uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, text_of

#: Bytes of a chunk; packed bytes after which a task begins another archive; bytes of rows sent at once; bytes of a header at most; bytes read at once.
CHUNK, ROLL, AT_ONCE, HEADER, PIECE = 1 << 20, 1 << 30, 8 << 20, 1 << 16, 1 << 16
#: Bytes from which an equal payload is written once only.
LEAST_BYTES = 0
#: Tasks that read archives at most; a task reads its archives one after the other.
MOST_TASKS = 100_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_ID = "X-Page-Id"

RECORD = "archive string, record long, chunk long, record_type string, record_id string, refers_to string, page_id {id}, url string, declared_bytes long, declared_digest string, bytes_so_far long, digest_so_far string, last boolean, content binary"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, as Spark names it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _urn(identity: bytes) -> str:
    return f"<urn:uuid:{UUID(bytes=identity[:16], version=5)}>"


def _identity(page_id: str | None, sha256: str) -> bytes:
    return hashlib.sha256(f"{page_id}\n{sha256}".encode()).digest()


def _line(text: str) -> str:
    """A header's value: what could end it is percent-coded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


# ---- writing


def revisits(pages: DataFrame, id_col: str, payload: Column, least: int = LEAST_BYTES) -> DataFrame:
    """(id, sha1, sha256, keep) of rows whose payload, of ``least`` bytes or more, also belongs to a larger id: ``keep`` is the largest. Null ids are
    the smallest. Both hashes must agree, so a collision of SHA-1 makes no revisit."""
    narrow = pages.select(F.col(id_col).alias("id"), payload.alias("__p")).filter(F.octet_length("__p") >= least).select("id", F.sha1("__p").alias("sha1"), F.sha2("__p", 256).alias("sha256"))
    groups = narrow.groupBy("sha1", "sha256").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return narrow.join(groups, ["sha1", "sha256"]).filter(~F.col("id").eqNullSafe(F.col("keep"))).distinct()


class _Archive:
    """One archive under way: gzip members into a file that gets its name once it is whole."""

    def __init__(self, folder: str) -> None:
        self.store, base = _store(folder)
        self.name = f"{uuid4().hex}.warc.gz"
        self.path, self.records, self.bytes = f"{base}/{self.name}", 0, 0
        self.out = self.store.open_output_stream(f"{self.path}.open", compression=None)

    def begin(self, head: str) -> None:
        self.packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.add(head.encode())

    def add(self, piece: bytes | memoryview) -> None:
        self._put(self.packer.compress(piece))

    def end(self) -> None:
        self.add(b"\r\n\r\n")
        self._put(self.packer.flush())
        self.records += 1

    def _put(self, packed: bytes) -> None:
        self.out.write(packed)
        self.bytes += len(packed)

    def closed(self) -> _Archive:
        self.out.close()
        self.store.move(f"{self.path}.open", self.path)
        return self


def _head(kind: str, identity: bytes, date: str, fields: dict[str, str | None], http: str, payload: int, of_type: str) -> str:
    lines = {"WARC-Type": kind, "WARC-Record-ID": _urn(identity), "WARC-Date": date, **fields, "Content-Type": of_type, "Content-Length": str(len(http) + payload)}
    return "WARC/1.1\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in lines.items() if v is not None) + "\r\n" + http


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_BYTES, date: str = DATE, chunk: int = CHUNK, roll: int = ROLL) -> DataFrame:
    """Write a record for each row into archives below ``folder`` and return the list of them (archive, records, bytes), as kept in ``folder/list``.

    ``folder`` must be new, and shared by all executors. Of rows with equal payloads of at least ``least`` bytes the one with the largest id is a response,
    the others are revisits without payload; rows that repeat that id too are responses each. A null payload counts as empty, a null
    id is the smallest, a null URL has no header. Payloads of any length are passed on in pieces of ``chunk`` bytes. Rows may repeat; other
    columns are not written. An empty table gives an empty list.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    payload = F.encode(text_of(payload_col), "utf-8") if pages.schema[payload_col].dataType.simpleString() == "string" else F.coalesce(payload_col, F.lit(b""))
    revisits(pages, id_col, payload, least).write.parquet(f"{folder}/revisits")
    again = spark.read.schema(f"id {kind}, sha1 string, sha256 string, keep {kind}").parquet(f"{folder}/revisits").withColumnsRenamed({"sha1": "__sha1", "sha256": "__sha256"})
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("__url"), payload.alias("__p")).withColumns({"__h1": F.sha1("__p"), "__h2": F.sha2("__p", 256)})
    met = rows.join(again, rows["__id"].eqNullSafe(again["id"]) & (rows["__h1"] == again["__sha1"]) & (rows["__h2"] == again["__sha256"]), "left")
    revisit = F.col("__sha1").isNotNull()
    body, n = F.when(~revisit, F.col("__p")).otherwise(F.lit(b"")), F.octet_length("__p")
    # A row a chunk: a payload is never sent to a task's Python as a whole. The chunks of a record stay together and in order.
    spread = met.withColumns({"__n": n, "__at": F.explode(F.sequence(F.lit(0), F.when(~revisit, F.greatest(n - 1, F.lit(0))).otherwise(0), F.lit(chunk)))})
    last = revisit | (F.col("__at") + chunk >= F.col("__n"))
    ready = spread.select(F.col("__id").cast("string"), "__url", "__h1", "__h2", F.col("__n").cast("long"), revisit, F.col("keep").cast("string"), F.col("__at") == 0, last, F.substring(body, F.col("__at") + 1, F.lit(chunk)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for i, (page_id, url, sha1, sha256, size, again, keep, first, last) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:9]), strict=True)):
                if archive is None:
                    archive = _Archive(folder)
                    archive.begin(_head("warcinfo", uuid4().bytes, date, {"WARC-Filename": archive.name}, "", 0, "application/warc-fields"))
                    archive.end()
                if first:
                    fields = {"WARC-Target-URI": url, "WARC-Payload-Digest": "sha1:" + _base32(bytes.fromhex(sha1)), PAGE_ID: page_id}
                    if again:
                        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _urn(_identity(keep, sha256))}
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
                    archive.begin(_head("revisit" if again else "response", _identity(page_id, sha256), date, fields, http, 0 if again else size, "application/http; msgtype=response"))
                archive.add(batch.column(9)[i].as_buffer())
                if last:
                    archive.end()
                    if archive.bytes >= roll:
                        done.append(archive.closed())
                        archive = None
        if archive is not None:
            done.append(archive.closed())
        yield pa.RecordBatch.from_arrays([pa.array([a.name for a in done], pa.string()), pa.array([a.records for a in done], pa.int64()), pa.array([a.bytes for a in done], pa.int64())], names=["archive", "records", "bytes"])

    ready.mapInArrow(run, "archive string, records long, bytes long").write.parquet(f"{folder}/list")
    return spark.read.parquet(f"{folder}/list")


# ---- reading


class _Pieces:
    """The unpacked bytes of an archive, taken in pieces: what is asked for is held, not more. Members of gzip follow each other; a plain archive passes as it is."""

    def __init__(self, source, piece: int) -> None:
        self.source, self.piece, self.packed, self.ready = source, piece, b"", b""
        self.unpacker = None
        self.packed = source.read(piece)
        self.plain = self.packed[:2] != b"\x1f\x8b"

    def more(self) -> bool:
        """Unpack up to one piece more; false at the end of the archive."""
        if not self.packed and not (self.unpacker and self.unpacker.unconsumed_tail):
            self.packed = self.source.read(self.piece)
        if self.plain:
            self.ready, self.packed, found = self.ready + self.packed, b"", bool(self.packed)
            return found
        while True:
            if self.unpacker is None:
                if not self.packed and not (found := self.source.read(self.piece)):
                    return False
                self.packed = self.packed or found
                self.unpacker = zlib.decompressobj(31)
            out = self.unpacker.decompress(self.packed, self.piece)
            self.packed = self.unpacker.unconsumed_tail
            if self.unpacker.eof:
                self.packed, self.unpacker = self.unpacker.unused_data, None
            if out:
                self.ready += out
                return True
            if self.unpacker is not None and not self.packed:
                self.packed = self.source.read(self.piece)
                if not self.packed:
                    raise ValueError("the archive ends within a record")

    def head(self) -> tuple[list[str], int] | None:
        """The lines up to the next empty one, and their bytes with it; none at the end."""
        while (at := self.ready.find(b"\r\n\r\n")) < 0:
            if len(self.ready) > HEADER + self.piece:
                raise ValueError(f"a header has over {HEADER} bytes")
            if not self.more():
                if self.ready.strip():
                    raise ValueError("the archive ends within a header")
                return None
        lines = self.ready[:at].decode("utf-8", "replace").split("\r\n")
        self.ready = self.ready[at + 4 :]
        return lines, at + 4

    def take(self, n: int, most: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces of ``most``."""
        while n:
            while len(self.ready) < min(n, most):
                if not self.more():
                    raise ValueError("the archive ends within a record")
            out, self.ready = self.ready[: min(n, most)], self.ready[min(n, most) :]
            n -= len(out)
            yield out


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields by their lower-case names; a line that begins with white space goes on with the last field."""
    out: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def chunks(source, chunk: int = CHUNK) -> Iterator[tuple]:
    """Rows of the chunked record table of one open archive: record (its number), chunk, type, ids, page id, URL, declared bytes and digest, and for each
    chunk the bytes and SHA-1 of the payload so far, whether it is the last, and its content. An empty payload has one empty chunk."""
    pieces, number = _Pieces(source, PIECE), -1
    while (head := pieces.head()) is not None:
        lines, number = head[0], number + 1
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins where record {number} should")
        warc = _fields(lines)
        rest = int(warc.get("content-length", "0"))
        declared = None
        if warc.get("content-type", "").startswith("application/http") and rest:
            http, size = pieces.head() or ([""], 0)
            rest -= size
            declared = _fields(http).get("content-length")
            if not size or rest < 0:
                raise ValueError(f"record {number} ends within its HTTP header")
        of_record = (warc.get("warc-type"), warc.get("warc-record-id"), warc.get("warc-refers-to"), warc.get(PAGE_ID.lower()), warc.get("warc-target-uri"), int(declared) if declared else rest, warc.get("warc-payload-digest", "").removeprefix("sha1:") or None)
        sha1, done, place = hashlib.sha1(), 0, 0
        for content in pieces.take(rest, chunk) if rest else [b""]:
            sha1.update(content)
            done += len(content)
            yield (number, place, *of_record, done, _base32(sha1.digest()), done == rest, content)
            place += 1
        for end in pieces.take(4, 4):
            if end != b"\r\n\r\n":
                raise ValueError(f"record {number} is longer than it says")


def read(archives: DataFrame, folder: str, id_type: str = "long", chunk: int = CHUNK, types: tuple[str, ...] = ("response", "revisit")) -> DataFrame:
    """The chunked record table of the archives (archive) below ``folder``: one row a chunk of at most ``chunk`` bytes of a record's payload.

    ``record`` numbers the records of an archive; ``bytes_so_far`` and ``digest_so_far`` are of the payload up to and with the chunk. A revisit
    has one empty chunk. A damaged archive raises; a null page id comes back null. An empty list gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([pa.field(n, t) for n, t in _COLUMNS])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, base = _store(folder)
                held, size = [], 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as source:
                    for row in chunks(source, chunk):
                        if row[2] in types:
                            held.append((name, *row))
                            size += len(row[-1]) + 500
                        if size >= AT_ONCE:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), _COLUMNS, strict=True)], schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), _COLUMNS, strict=True)], schema=schema)

    # A fixed number of partitions, since adaptive execution would put these small rows into one task.
    spread = archives.select("archive").repartition(max(1, min(archives.count(), MOST_TASKS)), "archive")
    return spread.mapInArrow(run, RECORD.format(id="string")).withColumn("page_id", F.col("page_id").cast(id_type))


_COLUMNS = [(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[t]) for n, t in (f.split(" ") for f in RECORD.format(id="string").split(", "))]


def records(table: DataFrame) -> DataFrame:
    """One row a record of a chunked record table: archive, record, page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Responses have the bytes and the digest that their chunks add up to, and an error is raised where these are not what the record declares. Revisits have what
    they declare, and the page id of the response they refer to (none where no archive has it).
    """
    last = cut(table.filter("last").drop("content", "chunk", "last"))
    differs = (F.col("bytes_so_far") != F.col("declared_bytes")) | (F.col("digest_so_far") != F.col("declared_digest"))
    checked = F.when((F.col("record_type") == "response") & differs, F.raise_error(F.concat(F.lit("damaged record "), "record_id"))).otherwise(F.col("declared_bytes"))
    one = last.select("archive", "record", "page_id", "url", "record_id", F.col("refers_to").alias("__to"), "record_type", checked.alias("payload_bytes"), F.when(F.col("record_type") == "response", F.col("digest_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"))
    response = one.filter("record_type = 'response'").groupBy(F.col("record_id").alias("__id")).agg(F.max("page_id").alias("refers_to"))
    # What is read from Python has no size that a plan knows, so it is never broadcast; rows that refer to one response may be split.
    revisit = one.filter("record_type = 'revisit'").join(response.hint("merge"), F.col("__to") == response["__id"], "left")
    columns = ("archive", "record", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
    others = one.filter("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast(table.schema["page_id"].dataType))
    return others.select(*columns).unionByName(revisit.select(*columns))
