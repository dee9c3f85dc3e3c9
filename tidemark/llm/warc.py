"""WARC archives as a Python data source of Spark.

Reading plans a partition for each file, and several for a large file whose
records are gzip members with a length field (as this writer makes them; any
gzip reader still opens them).  There a record is passed over by a seek, after
its headers alone were decompressed; in a plain file by ``Content-Length``; in
other gzip streams, however their members divide the records, what is skipped
has to be decompressed, but is not kept.  Record types and header values asked
for by equality or ``IN`` are pushed down and tested on the headers; the
payload is decoded only for records that pass, and not at all with the option
``payload=false``.

Header names are read without regard to case.  A file that ends within a
record, a record without a length and bytes that are no record are errors, not
ends of the table.

Writing makes a file for each task under a name of its own and moves it into
place when the job commits, so a repeated or lost task leaves no half archive.

Columns: record_type, record_id, target_uri, payload_digest, payload_length,
refers_to, headers (map) and payload (binary, null where it isn't decoded).

Defined results: a null or empty page is a record without payload; a url that
is null is written as an empty one, line ends in it are left out; repeated rows
are written each; a null page_id is written as ``null`` and read as null; extra
columns are ignored; an empty table gives an archive without records.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from tidemark.llm.common import checkpoint, join_by_key, shared_folder

SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, payload_length long, refers_to string, headers map<string,string>, payload binary"
#: Column -> header (fixed names of the format; the length header is an extension field).
HEADER = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length", "refers_to": "WARC-Refers-To"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES = 4 << 20
EXTRA = b"TL"  # subfield that holds a member's length
#: Bytes of a large file that one partition reads.
SPLIT_BYTES = 128 << 20
#: Names that readers ask for, by their lower-case form.
NAMES = {n.lower(): n for n in (*HEADER.values(), "Content-Length", "Content-Type", "WARC-Date", "WARC-Profile")}
#: How each member of this writer begins: no time, and a subfield of four bytes for the length.
SIGNATURE = struct.pack("<BBBBIBB", 31, 139, 8, 4, 0, 0, 255) + struct.pack("<H2sH", 8, EXTRA, 4)


def filesystem(path: str):
    """A pyarrow file system (local, HDFS, object stores) and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose header tells its own length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    whole = 10 + 2 + 8 + len(body) + 8
    head = SIGNATURE + struct.pack("<I", whole)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, headers: dict[str, str], payload: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_headers(block: bytes) -> dict[str, str]:
    """Headers of a record; names that readers ask for in their usual case."""
    out: dict[str, str] = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[NAMES.get(name.strip().lower(), name.strip())] = value.strip()
    return out


class _Plain:
    """Bytes of an uncompressed file from ``at`` on, as far as they are asked for."""

    def __init__(self, source, size: int, at: int):
        self.source, self.size, self.at, self.held = source, size, at, bytearray()

    def fill(self) -> bool:
        self.source.seek(self.at)
        raw = self.source.read(1 << 16) if self.at < self.size else b""
        self.at += len(raw)
        self.held += raw
        return bool(raw)

    def until(self, mark: bytes) -> bytes:
        """What comes before ``mark``, which is passed over."""
        seen = 0
        while (i := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self.fill():
                raise ValueError(f"WARC file ends within the headers of a record, at byte {self.at}")
        found = bytes(self.held[:i])
        del self.held[: i + len(mark)]
        return found

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.fill():
                raise ValueError(f"WARC file ends within a record, at byte {self.at}")
        found = bytes(self.held[:n])
        del self.held[:n]
        return found

    def skip(self, n: int) -> None:
        if n > len(self.held):
            self.at += n - len(self.held)
            n = len(self.held)
            if self.at > self.size:
                raise ValueError(f"WARC file ends within a record, at byte {self.size}")
        del self.held[:n]

    def ended(self) -> bool:
        """Passes over line ends between records; whether nothing is left."""
        while True:
            n = len(self.held) - len(self.held.lstrip(b"\r\n"))
            del self.held[:n]
            if self.held or not self.fill():
                return not self.held

    def starts_after(self, stop: int) -> bool:
        return False


class _Zipped(_Plain):
    """The same of a file of gzip members, whatever members and records have to do with each other."""

    def __init__(self, source, size: int, at: int):
        super().__init__(source, size, at)
        self.unpack, self.start, self.end = None, at, None

    def fill(self) -> bool:
        self.source.seek(self.at)
        raw = self.source.read(1 << 14 if self.unpack is None else 1 << 16) if self.at < self.size else b""
        if self.unpack is None:
            padding = len(raw) - len(raw.lstrip(b"\0"))
            if raw and padding == len(raw):
                self.at += padding
                return self.fill()
            raw = raw[padding:]
            self.at += padding
            if not raw:
                return False
            self.unpack, self.start = zlib.decompressobj(31), self.at
            self.end = self.at + struct.unpack("<I", raw[16:20])[0] if raw[:16] == SIGNATURE and len(raw) >= 20 else None
        elif not raw:
            raise ValueError(f"WARC file ends within a gzip member, at byte {self.at}")
        self.held += self.unpack.decompress(raw)
        self.at += len(raw) - len(self.unpack.unused_data)
        if self.unpack.eof:
            self.unpack = None
        return True

    def skip(self, n: int) -> None:
        if self.end is not None and self.unpack is not None:  # one record a member: the rest of it goes
            self.held.clear()
            self.unpack, self.at = None, self.end
            if self.at > self.size:
                raise ValueError(f"WARC file ends within a gzip member, at byte {self.size}")
            return
        while n > len(self.held):
            n -= len(self.held)
            self.held.clear()
            if not self.fill():
                raise ValueError(f"WARC file ends within a record, at byte {self.at}")
        del self.held[:n]

    def starts_after(self, stop: int) -> bool:
        return self.start >= stop


def records(source, size: int, wanted, start: int = 0, stop: int | None = None) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the records that start in a file's bytes [start, stop); ``wanted(headers)`` is 0: skip, 1: headers only, 2: all."""
    source.seek(0)
    stream = (_Zipped if source.read(2) == b"\x1f\x8b" else _Plain)(source, size, start)
    while not stream.ended():
        if stop is not None and stream.starts_after(stop):
            return
        head = stream.until(b"\r\n\r\n")
        headers = parse_headers(head)
        length = headers.get("Content-Length", "")
        if not head.startswith(b"WARC/") or not length.isdigit():
            raise ValueError(f"no WARC record with a length before byte {stream.at}")
        want, payload = wanted(headers), None
        if want == 2:
            payload = stream.take(int(length))
        else:
            stream.skip(int(length))
        if want:
            yield headers, payload


def next_member(source, size: int, at: int) -> int:
    """Where the first member of this writer at or after ``at`` begins; its length must lead to another or to the end."""
    held, base = b"", at
    while True:
        source.seek(base + len(held))
        raw = source.read(1 << 20) if base + len(held) < size else b""
        held += raw
        i = held.find(SIGNATURE)
        while i >= 0 and i + 20 <= len(held):
            after = base + i + struct.unpack("<I", held[i + 16 : i + 20])[0]
            source.seek(after)
            if after == size or after < size and source.read(16) == SIGNATURE:
                return base + i
            i = held.find(SIGNATURE, i + 1)
        if not raw:
            return size
        cut = max(0, i if i >= 0 else len(held) - 19)
        held, base = held[cut:], base + cut


class FilePartition(InputPartition):
    def __init__(self, path: str | None, start: int = 0, stop: int | None = None):
        self.path, self.start, self.stop = path, start, stop


class WarcReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.payload, self.tests = options["path"], options.get("payload", "true").lower() != "false", []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and (name := self._header(f.attribute)):
                self.tests.append((name, {str(f.value)} if isinstance(f, EqualTo) else {str(v) for v in f.value}))
            else:
                yield f

    @staticmethod
    def _header(attribute) -> str | None:
        if len(attribute) == 1 and attribute[0] != "payload_length":
            return HEADER.get(attribute[0])
        return attribute[1] if len(attribute) == 2 and attribute[0] == "headers" else None

    def partitions(self):
        from pyarrow import fs

        system, path = filesystem(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
        base = self.path.rstrip("/").removesuffix(path.rstrip("/")) if "://" in self.path else ""
        parts = []
        for f in sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            size, cuts = f.size, [0]
            if size > SPLIT_BYTES:
                with system.open_input_file(f.path) as raw:
                    if raw.read(16) == SIGNATURE:
                        cuts = list(range(0, size, SPLIT_BYTES))
            parts += [FilePartition(f"{base}{f.path}", a, b) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]
        return parts or [FilePartition(None)]  # a source has one partition at least

    def _wanted(self, headers: dict[str, str]) -> int:
        if any(headers.get(name) not in values for name, values in self.tests):
            return 0
        return 2 if self.payload else 1

    def read(self, partition):
        if partition.path is None:
            return
        system, path = filesystem(partition.path)
        rows, held = [], 0
        with system.open_input_file(path) as raw:
            size = raw.size()
            source = io.BufferedReader(raw, 1 << 18) if isinstance(raw, io.RawIOBase) else raw
            start = next_member(source, size, partition.start) if partition.start else 0
            for headers, payload in records(source, size, self._wanted, start, partition.stop):
                rows.append((headers, payload))
                held += 1000 + len(payload or b"")
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        get = lambda c: [h.get(HEADER[c]) for h, _ in rows]
        lengths = [int(x) if x is not None and x.isdigit() else None for x in get("payload_length")]
        columns = [pa.array(get(c), pa.string()) for c in ("record_type", "record_id", "target_uri", "payload_digest")]
        columns += [pa.array(lengths, pa.int64()), pa.array(get("refers_to"), pa.string()), pa.array([list(h.items()) for h, _ in rows], pa.map_(pa.string(), pa.string())), pa.array([p for _, p in rows], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


class Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class WarcWriter(DataSourceArrowWriter):
    """Expects the columns record_type, record_id, target_uri, payload_digest, payload_length, refers_to, payload."""

    def __init__(self, options, overwrite):
        self.path, self.level, self.overwrite = options["path"], int(options.get("level", "1")), overwrite
        self.date = options.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        if overwrite:
            system, path = filesystem(self.path)
            from pyarrow import fs

            if system.get_file_info(path).type == fs.FileType.Directory:
                system.delete_dir_contents(path)

    def write(self, iterator):
        system, path = filesystem(self.path)
        system.create_dir(f"{path}/_pending", recursive=True)
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        for batch in iterator:
            if out is None:
                out = system.open_output_stream(f"{path}/_pending/{name}", compression=None)
            columns = {c: batch.column(c).to_pylist() for c in HEADER}
            for i, payload in enumerate(batch.column("payload")):
                headers = {"WARC-Date": self.date, **{HEADER[c]: columns[c][i] for c in HEADER if c != "record_type"}, "Content-Type": "text/html"}
                if columns["record_type"][i] == "revisit":
                    headers["WARC-Profile"] = REVISIT_PROFILE
                out.write(member(record(columns["record_type"][i], headers, payload.as_py() or b""), self.level))
        if out is not None:
            out.close()
        return Written(name if out is not None else None)

    def commit(self, messages):
        system, path = filesystem(self.path)
        system.create_dir(path, recursive=True)
        for m in messages:
            if m is not None and m.name:
                system.move(f"{path}/_pending/{m.name}", f"{path}/{m.name}")
        self._sweep(system, path)

    def abort(self, messages):
        self._sweep(*filesystem(self.path))

    @staticmethod
    def _sweep(system, path):
        from pyarrow import fs

        if system.get_file_info(f"{path}/_pending").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/_pending")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known; filters are pushed down where the session allows it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive_records(pages: DataFrame, least: int = 100, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The records to write, one for each page: of equal payloads of ``least`` bytes or more, one response."""
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    large = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    large = checkpoint(large)  # digests that repeat, one row each
    total = large.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # the payload travels with its row: the record is written where the join has dealt it
    rows = _revisits(rows, large, total, least)
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "")
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return rows.select(
        F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"), name(F.coalesce(F.col("page_id").cast("string"), F.lit("null"))).alias("record_id"), uri.alias("target_uri"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.col("size").cast("string").alias("payload_length"), F.when(F.col("revisit"), name(F.col("first_id"))).alias("refers_to"),
        F.when(~F.col("revisit"), F.col("payload")).alias("payload"),
    )


def _revisits(rows: DataFrame, large: DataFrame, total: int, least: int) -> DataFrame:
    found = join_by_key(rows, large, ["digest"], "n", total, F.xxhash64("page_id"))
    revisit = F.col("n").isNotNull() & (F.col("size") >= least) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return found.withColumn("revisit", revisit)


def archived(pages: DataFrame, path: str | None = None, least: int = 100, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` as WARC files to ``path`` (below the checkpoint folder, if not given) and read them back."""
    spark = pages.sparkSession
    register(spark)
    path = path or shared_folder(spark, "warc")
    archive_records(pages, least, page_id, url, html).write.format("warc").mode("append").option("path", path).save()
    return spark.read.format("warc").option("path", path).load()


def page_archive(pages: DataFrame, least: int = 100, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """What the archive says of each page: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest of a response are taken from the payload that was read
    back, those of a revisit from its headers.  A null or empty page is a
    response of no bytes; a page_id given twice with one payload is one page, so
    both its records are responses; a null page_id revisits the smallest other.
    """
    spark = pages.sparkSession
    path = shared_folder(spark, "warc")
    responses = archived(pages, path, least, page_id, url, html).where("record_type = 'response'")
    # of revisits the headers alone are read
    revisits = spark.read.format("warc").option("path", path).option("payload", "false").load().where("record_type = 'revisit'")
    number = lambda c: F.regexp_extract(c, r":(-?\d+)>?$", 1).try_cast("long")
    rows = responses.select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("string").alias("refers_to"))
    rows = rows.unionByName(revisits.select("record_id", F.col("payload_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", "refers_to"))
    return rows.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))
