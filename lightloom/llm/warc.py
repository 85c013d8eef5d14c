"""WARC archives of pages: a deterministic sharded writer and its reader.

1. Facts of a page (id, SHA-1 and length of its payload) are small; on them alone it is settled which records are revisits,
   and, by prefix sums of payload lengths in the order of (page_id, digest), where a shard begins. A shard is a range of that
   order with about ``shard_bytes`` of payload, more where that would make over ``MOST_SHARDS``: at most so many limits go to
   the tasks. Shards depend on the pages only, not on how Spark cuts its partitions.
2. Pages go to their shard, are sorted there and written as one gzip member a record. A file is closed when it has
   ``file_bytes`` compressed bytes. Headers, digests and record ids are made anew from the page, without clock or chance, so
   a second run gives the same bytes.
3. A task writes under temporary names that no other attempt uses and tells what it wrote; only what finished tasks told is
   in the list of files. A second job gives those files their names (doing it again changes nothing), then the manifest is
   written: an archive without one is not complete, and readers start from it. Files of lost attempts go with the folder.

Paths may be in any store that pyarrow has a file system for; a folder of the local disk must be one that the cluster shares.

Defined results: a null html is the empty payload; a null page_id comes first, has no id header and counts below every
other id, so it revisits the largest one of its group (a group of null ids only is all response); rows that share the largest
id and the payload are all response; payloads of fewer than ``least`` bytes are always response; line ends and other control
characters in a url are percent-encoded; an empty table gives a manifest without files; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import gives_back, salted_join, scratch_root, stored

SHARD_BYTES = 16 << 20
MOST_SHARDS = 20_000
FILE_BYTES = 256 << 20
LEAST = 1000
#: What a record has besides its payload, about.
HEADERS = 600
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
MANIFEST = "file string, shard int, roll int, records long, bytes long, sha256 string, first_page long, last_page long"
REPORT = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def page_facts(pages: DataFrame) -> DataFrame:
    """page_id, digest and payload_bytes of every row."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))


def revisits(facts: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, digest, refers_to) of the records that are revisits."""
    long = facts.filter(F.col("payload_bytes") >= least)
    groups = long.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to")).filter("n > 1 and refers_to is not null")
    met = salted_join(long.select("page_id", "digest"), stored(groups, "warc-copies"), "digest", "page_id")
    return met.filter("page_id is null or page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def shard_starts(facts: DataFrame, shard_bytes: int) -> list[tuple]:
    """The first (page_id, digest) of every shard, in order, for at most about ``MOST_SHARDS`` shards."""
    weight = F.sum(F.col("payload_bytes") + HEADERS).alias("w")
    ranged = facts.groupBy("page_id", "digest").agg(weight).repartitionByRange(F.col("page_id").asc_nulls_first(), "digest")
    ranged = stored(ranged.withColumn("range", F.spark_partition_id()), "warc-ranges")
    sums = ranged.groupBy("range").agg(F.sum("w").alias("s"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sums.select("range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("range").orderBy(F.col("page_id").asc_nulls_first(), "digest").rowsBetween(Window.unboundedPreceding, -1)
    total = sums.agg(F.sum("s")).first()[0] or 0
    size = max(shard_bytes, -(-total // MOST_SHARDS))
    placed = ranged.withColumn("inside", F.coalesce(F.sum("w").over(inside), F.lit(0))).join(starts, "range")
    shard = F.floor((F.col("start") + F.col("inside")) / size)
    firsts = placed.groupBy(shard.alias("shard")).agg(F.min(F.struct("page_id", "digest")).alias("first"))
    return sorted(_place(r.first.page_id, r.first.digest) for r in firsts.select("first").collect())


def _place(page_id: int | None, digest: str) -> tuple:
    return (page_id is not None, page_id or 0, digest)


def record_id(page_id: int | None, digest: str, turn: int = 0) -> str:
    return f"<{uuid.uuid5(SPACE, f'{page_id}:{digest}:{turn}').urn}>"


def _labelled(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _head(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{name}: {value}" for name, value in fields if value is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, turn: int = 0, date: str = DATE) -> bytes:
    """A response record, or with ``refers_to`` a revisit without its payload."""
    again = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if again else http + payload
    digest = hashlib.sha1(payload, usedforsecurity=False).hexdigest()
    uri = None if url is None else "".join(c if ord(c) > 31 and ord(c) != 127 else f"%{ord(c):02X}" for c in url)
    fields = [
        ("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", record_id(page_id, digest, turn)), ("WARC-Date", date),
        ("WARC-Target-URI", uri), ("WARC-Payload-Digest", _labelled(payload)), ("WARC-Block-Digest", _labelled(block)),
        ("Content-Type", "application/http;msgtype=response"), ("Page-Id", page_id), ("WARC-Profile", PROFILE if again else None),
        ("WARC-Refers-To", record_id(refers_to, digest) if again else None), ("Refers-To-Page-Id", refers_to),
    ]
    return _head(fields, block)


def _info_record(name: str, date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return _head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid5(SPACE, name).urn}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def _member(record: bytes, level: int) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


class _Shard:
    """The files of one shard, each under a temporary name until the commit."""

    def __init__(self, fs: pyarrow.fs.FileSystem, folder: str, shard: int, file_bytes: int, level: int, date: str):
        self.fs, self.folder, self.shard, self.file_bytes, self.level, self.date = fs, folder, shard, file_bytes, level, date
        self.roll, self.out, self.done = 0, None, []

    def _open(self) -> None:
        self.name = f"pages-{self.shard:06d}-{self.roll:05d}.warc.gz"
        self.temporary = f"{self.folder}/{self.name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.hash, self.bytes, self.records, self.first = hashlib.sha256(), 0, 0, None
        self._write(_info_record(self.name, self.date))

    def _write(self, record: bytes) -> None:
        data = _member(record, self.level)
        self.out.write(data)
        self.hash.update(data)
        self.bytes += len(data)

    def add(self, page_id: int | None, record: bytes) -> None:
        if self.out is None:
            self._open()
        self._write(record)
        self.first = page_id if self.records == 0 else self.first
        self.records, self.last = self.records + 1, page_id
        if self.bytes >= self.file_bytes:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.done.append((self.name, self.shard, self.roll, self.records, self.bytes, self.hash.hexdigest(), self.first, self.last, self.temporary))
        self.out, self.roll = None, self.roll + 1


def _written(rows: DataFrame, folder: str, file_bytes: int, level: int, date: str) -> DataFrame:
    """Rows (shard, page_id, digest, mark, url, payload, refers_to), sorted, to files; a row for each file. A marked row says
    that the pages of its id and digest, which follow it, are revisits."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(folder)
        shard, told, last, turn = None, None, None, 0
        columns = list(zip(*[(f.split()[0], pa.string() if f.endswith("string") else pa.int32() if f.endswith("int") else pa.int64()) for f in f"{MANIFEST}, temporary string".split(", ")], strict=True))

        def finished() -> pa.RecordBatch:
            shard.close()
            cells = zip(*shard.done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, columns[1], strict=True)], list(columns[0]))

        for batch in batches:
            named = [batch.column(n) for n in ("shard", "page_id", "digest", "mark", "url", "payload", "refers_to")]
            for k in range(batch.num_rows):
                number, page_id, digest, mark, url, payload, refers_to = (c[k].as_py() for c in named)
                if shard is None or shard.shard != number:
                    if shard is not None:
                        yield finished()
                    shard = _Shard(fs, at, number, file_bytes, level, date)
                if mark:
                    told = (page_id, digest, refers_to)
                    continue
                same = told is not None and told[:2] == (page_id, digest)
                turn = turn + 1 if last == (page_id, digest) else 0
                last = (page_id, digest)
                shard.add(page_id, page_record(page_id, url, payload, told[2] if same else None, turn, date))
        if shard is not None:
            yield finished()

    return rows.mapInArrow(gives_back(write), f"{MANIFEST}, temporary string")


def _committed(files: DataFrame, n: int, folder: str) -> DataFrame:
    """Files from their temporary names to their own; a file that is there already stays."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(folder)
        for batch in batches:
            for name, temporary, size in zip(*(batch.column(c).to_pylist() for c in ("file", "temporary", "bytes")), strict=True):
                if fs.get_file_info(temporary).type == pyarrow.fs.FileType.File:
                    fs.move(temporary, f"{at}/{name}")
                elif fs.get_file_info(f"{at}/{name}").size != size:
                    raise FileNotFoundError(f"{temporary} is lost")
            yield batch.select([f.split()[0] for f in MANIFEST.split(", ")])

    return files.repartition(max(1, min(n, 4096)), "file").mapInArrow(gives_back(move), MANIFEST)


def write_warc(pages: DataFrame, path: str, least: int = LEAST, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, level: int = 6, date: str = DATE) -> DataFrame:
    """An archive of ``pages`` (page_id, url, html) under ``path``; returns its manifest. Equal payloads of ``least`` bytes or
    more are stored once, with the largest page_id."""
    spark = pages.sparkSession
    facts = stored(page_facts(pages), "warc-facts")
    starts = shard_starts(facts, shard_bytes)

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series, digest: pd.Series) -> pd.Series:
        ids = [None if pd.isna(i) else int(i) for i in page_id]
        return pd.Series([bisect_right(starts, _place(i, d)) - 1 for i, d in zip(ids, digest, strict=True)])

    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    whole = pages.select("page_id", F.sha1(payload).alias("digest"), F.lit(False).alias("mark"), "url", payload.alias("payload"), F.lit(None).cast("long").alias("refers_to"))
    marks = revisits(facts, least).select("page_id", "digest", F.lit(True).alias("mark"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "refers_to")
    placed = lambda rows: rows.withColumn("shard", shard_of(F.col("page_id").cast("string"), "digest"))  # noqa: E731  a long column with nulls would become doubles
    dealt = placed(whole).unionByName(placed(marks)).repartition("shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", F.desc("mark"))
    fs, at = file_system(path)
    fs.create_dir(f"{at}/data/_temporary", recursive=True)
    files = stored(_written(dealt, f"{path}/data/_temporary", file_bytes, level, date), "warc-files")
    moved = _committed(files, files.count(), f"{path}/data")
    moved.repartitionByRange(1, "file").sortWithinPartitions("file").write.parquet(f"{path}/manifest")
    fs.delete_dir(f"{at}/data/_temporary")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _members(stream: pa.NativeFile, hashed: object) -> Iterator[bytes]:
    """The records of a file, one decompressed gzip member each."""
    unpack, parts, data = zlib.decompressobj(31), [], b""
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                break
            hashed.update(data)
        parts.append(unpack.decompress(data))
        data = b""
        if unpack.eof:
            yield b"".join(parts)
            data, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("a record is cut off")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-case name, and block of a record; the block's length and digest are checked."""
    end = record.index(b"\r\n\r\n")
    lines = record[:end].decode().split("\r\n")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    block = record[end + 4 : end + 4 + int(fields["content-length"])]
    if not lines[0].startswith("WARC/") or record[end + 4 + len(block) :] != b"\r\n\r\n" or len(block) != int(fields["content-length"]):
        raise ValueError("not a record")
    if fields.get("warc-block-digest", _labelled(block)) != _labelled(block):
        raise ValueError(f"damaged block of {fields.get('warc-record-id')}")
    return fields, block


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Per page of the archive under ``path``: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked
    for, payload (null for revisits). Files, blocks and payloads are held against their digests."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(f"{path}/data")
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]

        def rows(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for name, told in zip(batch.column("file").to_pylist(), batch.column("sha256").to_pylist(), strict=True):
                held, size, hashed = [], 0, hashlib.sha256()
                with fs.open_input_stream(f"{at}/{name}", compression=None) as stream:
                    for record in _members(stream, hashed):
                        fields, block = parse_record(record)
                        if fields["warc-type"] == "warcinfo":
                            continue
                        held.append(_page(fields, block, with_payload))
                        size += len(block) if with_payload else 100
                        if size > 4 << 20:
                            yield rows(held)
                            held, size = [], 0
                if hashed.hexdigest() != told:
                    raise ValueError(f"{name} is not the file of the manifest")
                if held:
                    yield rows(held)

    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("file", "sha256")
    dealt = files.repartition(max(1, min(files.count(), 4096)), "file")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return dealt.mapInArrow(gives_back(parse), schema + ", payload binary" * with_payload)


def _page(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    end = block.index(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in block[:end].decode().split("\r\n")[1:])
    again, payload = fields["warc-type"] == "revisit", block[end + 4 :]
    if not again and (fields["warc-payload-digest"] != _labelled(payload) or len(payload) != int(http["Content-Length"])):
        raise ValueError(f"damaged payload of {fields['warc-record-id']}")
    number = lambda name: int(fields[name]) if name in fields else None
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    row = (number("page-id"), fields.get("warc-target-uri"), int(http["Content-Length"]), digest, fields["warc-type"], number("refers-to-page-id"))
    return (*row, None if again else payload) if with_payload else row


def warc_report(pages: DataFrame) -> DataFrame:
    """Writes the archive of ``pages`` to the shared folder and reads it back: the columns of ``REPORT``."""
    path = f"{scratch_root(pages.sparkSession)}/lightloom/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path).select(*REPORT)
