"""WARC archives of individually compressed records with a Zstandard dictionary.

The dictionary is built from a bounded sample of the records to be archived and
stands in a skippable frame at the head of every archive; each record follows as
a frame of its own, compressed with it.  A record whose payload another one
already holds is a revisit of that one.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dugout.llm.runtime import Scratch, ship

#: Frame that a reader may skip, and by the archive format the one that holds a dictionary.
_SKIPPABLE = struct.pack("<I", 0x184D2A5D)
_CRLF = b"\r\n"
#: Payloads from this size on are stored once.
LEAST_SHARED = 100
#: The dictionary's sample: records, leading bytes of each, size of the dictionary.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 8192, 65536
_READ = 1 << 20


def _folder(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _header_text(value: str) -> bytes:
    """A value on one line: control characters and blanks are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value).encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """One WARC record.  ``first`` is the page whose response a revisit refers to."""
    fields = [
        (b"WARC-Type", b"response" if first is None else b"revisit"),
        (b"WARC-Record-ID", b"<urn:page:%s>" % str(page_id).encode()),
        (b"WARC-Date", date.encode()),
        (b"WARC-Payload-Digest", b"sha256:" + digest.encode()),
        (b"WARC-Payload-Length", str(len(payload)).encode()),
    ]
    if page_id is not None:
        fields.append((b"WARC-Page", str(page_id).encode()))
    if url is not None:
        fields.append((b"WARC-Target-URI", _header_text(url)))
    if first is not None:
        fields += [
            (b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            (b"WARC-Refers-To", b"<urn:page:%s>" % str(first).encode()),
        ]
        payload = b""
    fields += [(b"Content-Type", b"text/html"), (b"Content-Length", str(len(payload)).encode())]
    return b"WARC/1.1\r\n" + b"".join(name + b": " + value + _CRLF for name, value in fields) + _CRLF + payload + _CRLF + _CRLF


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = raw.partition(_CRLF + _CRLF)
    version, *lines = head.split(_CRLF)
    if version != b"WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.decode().split(": ", 1) for line in lines)
    length = int(headers["Content-Length"])
    if rest[length:] != _CRLF + _CRLF:
        raise ValueError("a record's length is wrong")
    return headers, rest[:length]


def with_first(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, and ``first``: the page a revisit refers to, null for a response.

    Digests are combined before they are shuffled; only those of several pages are joined back.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.filter(F.octet_length("payload") >= LEAST_SHARED)
    shared = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    joined = rows.join(shared.select("digest", "first"), "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("first"))


def dictionary(pages: DataFrame, date: str) -> bytes:
    """A dictionary built from the sampled records, empty if there are too few to build one."""
    import zstandard

    # Ids first: what each task sends for the choice is then small.
    ids = pages.select("page_id").filter("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_ROWS)
    chosen = [row["page_id"] for row in ids.collect()]
    picked = (
        pages.filter(F.col("page_id").isin(chosen))
        .select("page_id", "url", F.substring(F.coalesce(F.col("html").cast("string"), F.lit("")), 1, SAMPLE_BYTES).alias("html"))
        .dropDuplicates(["page_id"])
        .collect()
    )
    picked.sort(key=lambda row: row["page_id"])
    samples = []
    for row in picked:
        payload = row["html"].encode()
        samples.append(record(row["page_id"], row["url"], payload, hashlib.sha256(payload).hexdigest(), None, date))
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


def _write(uri: str, shared, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        system, folder = _folder(uri)
        task = TaskContext.get()
        name = f"pages-{task.partitionId():06d}.warc.zst"
        # A task that runs again writes the same bytes; the last one to finish moves them into place.
        draft = f"{folder}/_{name}-{task.taskAttemptId()}"
        known = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        compressor = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=True)
        records = written = 0
        out = None
        for batch in batches:
            if out is None and batch.num_rows:
                system.create_dir(folder, recursive=True)
                out = system.open_output_stream(draft, compression=None)
                if known:
                    packed = zstandard.ZstdCompressor().compress(shared.value)
                    out.write(_SKIPPABLE + struct.pack("<I", len(packed)) + packed)
            for page_id, url, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                frame = compressor.compress(record(page_id, url, payload, digest, first, date))
                out.write(frame)
                records += 1
                written += len(frame)
        if out is not None:
            out.close()
            system.move(draft, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([written], pa.int64())], names=["name", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, uri: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``uri``; gives name, records, bytes of each archive.

    ``uri`` is a folder that all executors reach: a local path mounted everywhere
    or any file system pyarrow opens by uri.  A null html is an empty payload; a
    null url leaves out the target.  Of rows that repeat the smallest page_id of
    a payload, all are responses.  Payloads below ``LEAST_SHARED`` bytes are
    always responses.  An empty table writes nothing.
    """
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(dictionary(pages, date))
    done = with_first(pages).mapInArrow(_write(uri, shared, date), "name string, records long, bytes long")
    # Stored at once, so that the archives are written once.
    return Scratch(spark, "warc-list").store(done, "archives")


def frames(stream, limit: int = _READ) -> Iterator[bytes]:
    """The decompressed records of an archive, one at a time."""
    import zstandard

    known, held = None, b""

    def filled(n: int) -> bool:
        nonlocal held
        while len(held) < n and (more := stream.read(limit)):
            held += more
        return len(held) >= n

    while filled(8):
        if held[:4] == _SKIPPABLE:
            size = struct.unpack("<I", held[4:8])[0]
            if not filled(8 + size):
                raise ValueError("an archive's dictionary is cut off")
            known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(held[8 : 8 + size]))
            held = held[8 + size :]
            continue
        reader = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
        parts = [reader.decompress(held)]
        while not reader.eof:
            more = stream.read(limit)
            if not more:
                raise ValueError("an archive's last record is cut off")
            parts.append(reader.decompress(more))
        held = reader.unused_data
        yield b"".join(parts)
    if held:
        raise ValueError("an archive ends within a frame")


def _read(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        system, folder = _folder(uri)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with system.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for raw in frames(stream):
                        headers, block = parsed(raw)
                        response = headers["WARC-Type"] == "response"
                        digest = hashlib.sha256(block).hexdigest() if response else headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        length = len(block) if response else int(headers["WARC-Payload-Length"])
                        page, target = headers.get("WARC-Page"), headers.get("WARC-Refers-To")
                        rows.append(
                            (int(page) if page else None, headers.get("WARC-Target-URI"), block if response else None, length, digest, headers["WARC-Type"], int(target[10:-1]) if target else None)
                        )
                        size += len(block)
                        if size > 4 << 20 or len(rows) >= 4096:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def read_archives(spark: SparkSession, uri: str, archives: DataFrame) -> DataFrame:
    """The records of the named archives: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are those of what was read; a revisit's are
    what its record tells of the payload it refers to, and its payload is null.
    """
    ship(spark)
    named = archives.select("name")
    return named.repartition(max(1, named.count())).mapInArrow(
        _read(uri),
        "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long",
    )


def new_folder(spark: SparkSession) -> str:
    """A folder for archives below the shared one."""
    from dugout.sources.store import shared_folder

    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
