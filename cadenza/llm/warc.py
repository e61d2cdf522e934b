"""WARC archives: written as monolithic gzip files, normalised to a gzip member a record with an offset index, read by it."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import local_path, new_folder, stored

#: Fixed values of the format.
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BLOCK = 1 << 18
GZIP, MEMBER_LEVEL = 31, 6
MANIFEST = "path string, records long, bytes long"
INDEX = "path string, offset long, length long, record_type string, record_id string, target_uri string, payload_digest string, damage string"
RECORDS = "record_type string, record_id string, target_uri string, refers_to string, date string, payload binary, payload_bytes long, payload_digest string, damage string"


class DamagedArchive(ValueError):
    """An archive that ends early or isn't as the format has it."""


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    at = local_path(path)
    return (pa.fs.LocalFileSystem(), at) if at else pa.fs.FileSystem.from_uri(path)


def base32_digest(data: Column) -> Column:
    """The SHA-1 of binary data in base32, as archives write it: 32 characters of five bits."""
    hexed = F.sha1(data)
    part = lambda k: F.conv(F.substring(hexed, k * 5 + 1, 5), 16, 10).cast("int")
    char = lambda n, down: F.substring(F.lit(ALPHABET), F.shiftright(n, down).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*(char(part(k), down) for k in range(8) for down in (15, 10, 5, 0)))


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """pages with payload (binary; null: empty), payload_digest, record_type and refers_to.

    Of the rows of equal payloads of at least least_bytes bytes, those with the largest id are responses and all others revisits that
    refer to it; smaller payloads are responses. Rows that repeat the largest id are all responses. A null id is less than all others.

    What payloads repeat is counted by digest first; only those are joined back, as a table, so that the join can split one with very many copies.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    key = F.sha2(payload, 256)
    judged = F.when(F.octet_length(payload) >= least_bytes, key)
    many = pages.groupBy(judged.alias("_key")).agg(F.count("*").alias("_n"), F.max(id_col).alias("_top")).where("_key is not null and _n > 1 and _top is not null")
    many = stored(many.select("_key", "_top"), "warc-copies")
    rows = pages.select("*", payload.alias("payload")).join(many, judged == F.col("_key"), "left")
    revisit = F.col("_top").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_top"))
    return rows.select(*pages.columns, "payload", base32_digest(F.col("payload")).alias("payload_digest"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_top")).alias("refers_to"))


def _one_line(value: str | None) -> str:
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value or "").strip()


def record_bytes(kind: str, record_id: str, uri: str | None, date: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A record with its HTTP head as block; a revisit has the head alone, with the length of the payload it stands for."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if kind == "revisit" else head + payload
    names = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {_one_line(uri)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"]
    if kind == "revisit":
        names += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    names += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(names).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Sink:
    """A new file of a folder, whole under its name only once it is closed."""

    def __init__(self, folder: str, suffix: str):
        self.path = f"{folder}/{uuid.uuid4().hex}{suffix}"
        self.fs, self.inner = filesystem(self.path)
        self.fs.create_dir(self.inner.rpartition("/")[0], recursive=True)
        self.out, self.at = self.fs.open_output_stream(f"{self.inner}.part"), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(f"{self.inner}.part", self.inner)


def write_archives(records: DataFrame, folder: str | None = None, file_bytes: int = 256 << 20) -> DataFrame:
    """Write records as monolithic gzip archives (one gzip stream a file) and return their manifest: path, records, bytes.

    records has record_type, record_id, target_uri, date, payload, payload_digest and refers_to. Each task streams its rows to files of about file_bytes
    before compression. Only files in the (stored) manifest count: what a lost or repeated attempt of a task has written is in no manifest.
    """
    folder = folder or new_folder(records.sparkSession, "warc-monolithic")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = packer = None
        done, count, raw = [], 0, 0

        def finish() -> None:
            sink.write(packer.flush())
            sink.close()
            done.append((sink.path, count, raw))

        for batch in batches:
            for row in (r for k in range(0, len(batch), 64) for r in batch.slice(k, 64).to_pylist()):
                if sink is None:
                    sink, packer, count, raw = _Sink(folder, ".warc.gz"), zlib.compressobj(1, zlib.DEFLATED, GZIP), 0, 0
                data = record_bytes(row["record_type"], row["record_id"], row["target_uri"], row["date"], row["payload"] or b"", row["payload_digest"], row["refers_to"])
                sink.write(packer.compress(data))
                count, raw = count + 1, raw + len(data)
                if raw >= file_bytes:
                    finish()
                    sink = None
        if sink is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["path", "records", "bytes"])

    columns = ["record_type", "record_id", "target_uri", "date", "payload", "payload_digest", "refers_to"]
    return stored(records.select(*columns).mapInArrow(work, MANIFEST), "warc-manifest")


@dataclass
class _Inflated:
    """The bytes of a gzip file in one pass, member after member, block by block."""

    source: object
    held: bytearray = field(default_factory=bytearray)
    unpacker: object = None
    raw: bytes = b""

    def more(self) -> bool:
        """Hold further bytes; False at the end of the file."""
        while True:
            self.raw = self.raw or self.source.read(BLOCK)
            if not self.raw:
                if self.unpacker is not None:
                    raise DamagedArchive("the file ends within a gzip member")
                return False
            self.unpacker = self.unpacker or zlib.decompressobj(GZIP)
            try:
                data = self.unpacker.decompress(self.raw, BLOCK)
            except zlib.error as e:
                raise DamagedArchive(str(e)) from None
            self.raw = self.unpacker.unused_data if self.unpacker.eof else self.unpacker.unconsumed_tail
            if self.unpacker.eof:
                self.unpacker, self.raw = None, self.raw.lstrip(b"\0")
            if data:
                self.held += data
                return True

    def until(self, mark: bytes, most: int) -> bytes | None:
        """What comes before and with mark; None at the end of the file."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if seen > most:
                raise DamagedArchive(f"a head of over {most} bytes")
            if not self.more():
                if self.held.strip(b"\r\n"):
                    raise DamagedArchive("the file ends within a head")
                return None
        out = bytes(self.held[: at + len(mark)])
        del self.held[: at + len(mark)]
        return out

    def exactly(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.held and not self.more():
                raise DamagedArchive("the file ends within a record")
            part = bytes(self.held[:size])
            del self.held[: len(part)]
            size -= len(part)
            yield part


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise DamagedArchive(f"no record begins with {lines[0][:40]!r}")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, mark, value = line.partition(":")
        if mark:
            out[name.strip().lower()] = value.strip()
    if not re.fullmatch("[0-9]+", out.get("content-length", "")):
        raise DamagedArchive("a record without a length")
    return out


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value is not None else None


def normalised_file(path: str, folder: str, most_head: int = 16 << 20) -> list[tuple]:
    """Inflate an archive once, write each record as its own gzip member to a new file of folder and the sidecar index beside it; the rows of INDEX.

    Records pass through in blocks, so their size doesn't matter. If the archive is damaged, its whole records before that are kept and a last row says what is wrong.
    """
    fs, inner = filesystem(path)
    rows, out = [], _Sink(folder, ".warc.gz")
    damage = None
    with fs.open_input_stream(inner, compression=None) as source:
        archive = _Inflated(source)
        try:
            while (head := archive.until(b"\r\n\r\n", most_head)) is not None:
                start = out.at
                names = parse_head(head.lstrip(b"\r\n"))
                packer = zlib.compressobj(MEMBER_LEVEL, zlib.DEFLATED, GZIP)
                out.write(packer.compress(head.lstrip(b"\r\n")))
                for part in archive.exactly(int(names["content-length"])):
                    out.write(packer.compress(part))
                if b"".join(archive.exactly(4)) != b"\r\n\r\n":
                    raise DamagedArchive("a record doesn't end where its length says")
                out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                digest = names.get("warc-payload-digest", "").removeprefix("sha1:") or None
                rows.append((out.path, start, out.at - start, names.get("warc-type"), _bare(names.get("warc-record-id")), names.get("warc-target-uri"), digest, None))
        except DamagedArchive as e:
            damage = str(e)
    out.close()
    if damage is not None:
        rows.append((path, None, None, None, None, None, None, damage))
    lines = "".join(f"{r[1]} {r[2]} {r[3]} {r[4]} {r[6]} {r[5]}\n" for r in rows if r[1] is not None)
    with out.fs.open_output_stream(f"{out.inner}.idx") as f:
        f.write(b"offset length type id digest uri\n" + lines.encode("utf-8", "surrogatepass"))
    return rows


def normalise(manifest: DataFrame, folder: str | None = None) -> DataFrame:
    """The offset index of the archives of a manifest (column path), each rewritten with a gzip member a record.

    Each archive is inflated once, by one task and in one pass, as a gzip stream can't be entered in its middle; many archives go to many tasks.
    The index is stored; a file counts only by its rows there. Beside each file lies the same index as text (.idx). An archive that is damaged gives
    its whole records and a row with damage set and no offset.
    """
    spark = manifest.sparkSession
    folder = folder or new_folder(spark, "warc-members")
    names = [f.split(" ")[0] for f in INDEX.split(", ")]
    types = [pa.int64() if k in (1, 2) else pa.string() for k in range(len(names))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = normalised_file(path, folder)
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 10_000], strict=True), types, strict=True)], names)

    paths = manifest.select("path")
    return stored(paths.repartition(min(max(1, paths.count()), 20_000)).mapInArrow(work, INDEX), "warc-index")


def read_member(source, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Head and block of the record at an offset."""
    source.seek(offset)
    data = zlib.decompress(source.read(length), GZIP)
    head, _, rest = data.partition(b"\r\n\r\n")
    names = parse_head(head)
    size = int(names["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise DamagedArchive("a record doesn't end where its length says")
    return names, rest[:size]


def _read(names: dict[str, str], block: bytes) -> tuple:
    """A row of RECORDS. Of responses the payload's bytes and digest are measured; a revisit has those of the payload that it stands for, by its heads."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    stated = names.get("warc-payload-digest", "").removeprefix("sha1:") or None
    kind, damage = names.get("warc-type"), None
    if kind == "revisit":
        found = re.search(rb"(?im)^Content-Length: *([0-9]+) *\r?$", head + mark)
        payload, size, digest = None, int(found[1]) if found else None, stated
    else:
        payload = payload if mark else block
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        damage = None if stated in (None, digest) else "the payload isn't that of its digest"
    return kind, _bare(names.get("warc-record-id")), names.get("warc-target-uri"), _bare(names.get("warc-refers-to")), names.get("warc-date"), payload, size, digest, damage


def read_records(index: DataFrame, span_bytes: int = 4 << 20, payloads: bool = True) -> DataFrame:
    """The records of an offset index, each read by its offset from its file; payload is null for revisits, and for all without payloads.

    Index rows are dealt out by file and span of the file, so a large file is read by many tasks, each from its own offset on. Rows of a damaged archive
    come as they are in the index, with damage set.
    """
    schema = RECORDS if payloads else RECORDS.replace("payload binary, ", "")
    names = [f.split(" ")[0] for f in schema.split(", ")]
    types = [{"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[f.split(" ")[1]] for f in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for batch in batches:
            rows, held = [], 0
            for path, offset, length, damage in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if offset is None:
                    row = (*(None,) * 8, damage)
                else:
                    if path != opened:
                        if source is not None:
                            source.close()
                        fs, inner = filesystem(path)
                        opened, source = path, fs.open_input_file(inner)
                    row = _read(*read_member(source, offset, length))
                held += len(row[5] or b"") if payloads else 0
                rows.append(row if payloads else row[:5] + row[6:])
                if held >= 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    asked = index.select("path", "offset", "length", "damage")
    # As many parts as the files' bytes ask for: the index itself is small, and its size says little.
    parts = min(max(1, -(-(asked.agg(F.sum("length")).first()[0] or 0) // span_bytes)), 20_000)
    dealt = asked.repartition(parts, "path", F.floor(F.col("offset") / span_bytes)).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(work, schema)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 256 << 20) -> DataFrame:
    """The offset index of archives that hold a record a page: written monolithic, then normalised. See with_revisits, write_archives and normalise.

    The id stands in the record's id (urn:page:ID, without one urn:page:none). Null payloads are empty, null addresses too; controls in addresses
    become blanks. Rows that repeat have a record each. An empty table has an empty index.
    """
    rows = with_revisits(pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("target_uri"), F.col(payload_col).alias("body")), "id", "body", least_bytes)
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    records = rows.select("record_type", urn(F.col("id")).alias("record_id"), "target_uri", F.lit(date).alias("date"), "payload", "payload_digest", F.when(F.col("record_type") == "revisit", urn(F.col("refers_to"))).alias("refers_to"))
    return normalise(write_archives(records, file_bytes=file_bytes))


def page_of(record_id: Column) -> Column:
    """The id in a record's id; null for none."""
    return F.substring_index(record_id, ":", -1).try_cast("long")
