"""WARC archives in Zstandard: a writer, and a reader that needs nothing but the file.

An archive begins with a skippable frame that holds the dictionary, itself compressed; then comes one frame a record.
The reader loads the dictionary from that frame, decodes frame by frame and checks version lines, headers, lengths,
digests and what follows the block.  Of records with equal payloads of at least REVISIT_BYTES bytes the one with the
least id is a response and the others are revisits that refer to it and carry no payload.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import Scratch, hash_share, hot_keys, parts_of, quoted, salted_join, scratch_path, ship, small_enough, stored

REVISIT_BYTES = 100
#: Bytes at which an archive is closed and the next one begun.
ARCHIVE_BYTES = 16 << 20
#: Pages (the least by a hash of the id), and characters of the beginning of each, of the dictionary's training sample, and
#: the size of the dictionary.  It changes the archives' bytes and no record.
DICT_PAGES, DICT_CHARS, DICT_BYTES = 400, 20_000, 32 << 10
SKIPPABLE = 0x184D2A5D
DATE = "2020-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArchiveError(ValueError):
    pass


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page/{page_id}')}>"


def _line(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response, or a revisit of page refers_to (None: a response), as a WARC/1.1 record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url) if url else f'urn:page:{page_id}'}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
        head.append("WARC-Truncated: length")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record; ArchiveError if anything is out of order."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise ArchiveError("no end of the WARC header")
    version, *lines = raw[:end].decode("utf-8").split("\r\n")
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError(f"not a WARC version: {version[:20]!r}")
    head: dict[str, str] = {}
    for x in lines:
        name, colon, value = x.partition(":")
        if not colon or name.lower() in head:
            raise ArchiveError(f"bad or repeated header {name!r}")
        head[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in head:
            raise ArchiveError(f"no header {name}")
    if not head["content-length"].isdigit():
        raise ArchiveError("Content-Length is no number")
    n = int(head["content-length"])
    block, rest = raw[end + 4 : end + 4 + n], raw[end + 4 + n :]
    if len(block) != n or rest != b"\r\n\r\n":
        raise ArchiveError("the block's length is not Content-Length")
    want = head.get("warc-block-digest", "")
    if want.startswith("sha256:") and want[7:] != hashlib.sha256(block).hexdigest():
        raise ArchiveError("the block's digest is wrong")
    return head, block


def page_of(head: dict[str, str], block: bytes) -> tuple[int, str]:
    """The length of the whole payload and its digest: of the bytes for a response, as recorded for a revisit."""
    end = block.find(b"\r\n\r\n")
    http = block[:end].decode("latin-1").split("\r\n") if end >= 0 else [""]
    if not http[0].startswith("HTTP/"):
        raise ArchiveError("no HTTP header in the block")
    sizes = [x.split(":", 1)[1].strip() for x in http[1:] if x.lower().startswith("content-length:")]
    if len(sizes) != 1 or not sizes[0].isdigit():
        raise ArchiveError("no HTTP Content-Length")
    n, digest, payload = int(sizes[0]), head.get("warc-payload-digest", "").removeprefix("sha256:"), block[end + 4 :]
    if head["warc-type"] == "response":
        if len(payload) != n or hashlib.sha256(payload).hexdigest() != digest:
            raise ArchiveError("the payload is not what its header says")
    elif head["warc-type"] != "revisit" or payload or "warc-refers-to" not in head:
        raise ArchiveError("neither a response nor a revisit without payload")
    return n, digest


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A Zstandard dictionary; empty where the samples are too few for one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b""


class Writer:
    def __init__(self, dictionary: bytes):
        import zstandard

        self.buffer = io.BytesIO()
        self.records = 0
        if dictionary:
            frame = zstandard.ZstdCompressor(level=19).compress(dictionary)
            self.buffer.write(struct.pack("<II", SKIPPABLE, len(frame)) + frame)
        made = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True, **made)

    def add(self, raw: bytes) -> None:
        self.buffer.write(self.zstd.compress(raw))
        self.records += 1

    def size(self) -> int:
        return self.buffer.tell()


def read(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, frame by frame; stream has read(n).  Memory: the largest record."""
    import zstandard

    data = stream.read(8)
    made = {}
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        n = struct.unpack("<I", data[4:])[0]
        frame = stream.read(n)
        if len(frame) != n:
            raise ArchiveError("the dictionary is cut short")
        if frame[:4] == b"\x28\xb5\x2f\xfd":
            frame = zstandard.ZstdDecompressor().decompressobj().decompress(frame)
        if frame[:4] != b"\x37\xa4\x30\xec":
            raise ArchiveError("no dictionary in the leading frame")
        made["dict_data"] = zstandard.ZstdCompressionDict(frame)
        data = b""
    zstd = zstandard.ZstdDecompressor(**made)
    while True:
        data = data or stream.read(chunk)
        if not data:
            return
        one, parts = zstd.decompressobj(), []
        while True:
            try:
                parts.append(one.decompress(data))
            except zstandard.ZstdError as e:
                raise ArchiveError(f"a frame can't be decoded: {e}") from e
            if one.eof:
                data = one.unused_data
                break
            data = stream.read(chunk)
            if not data:
                raise ArchiveError("the last frame is cut short")
        yield b"".join(parts)


ARCHIVE = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("records", T.LongType(), False), T.StructField("bytes", T.LongType(), False)])
RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType(), False),
        T.StructField("payload_digest", T.StringType(), False),
        T.StructField("record_type", T.StringType(), False),
        T.StructField("refers_to", T.LongType()),
    ]
)


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages and give (path, records, bytes) of each archive.

    Null html is an empty payload, a null url becomes urn:page:ID.  Rows without id are responses; rows that repeat
    the least id of their payload are responses too.  An empty table writes nothing.  Other columns are ignored.
    A task writes archives under names of its attempt; only those of attempts that ended well are in the result.

    Which pages are revisits is found from ids and digests alone and joined back by id and digest, so no shuffle gathers the
    copies of a common page; the pages' own text is shuffled only if there are too many revisits for a broadcast.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = (folder or scratch_path(spark, "warc")).rstrip("/")
    rows = pages.select(quoted(id_col).cast("long").alias("id"), quoted(url_col).alias("url"), F.coalesce(quoted(html_col), F.lit("")).alias("html"))
    with Scratch(spark) as keep:
        sized = rows.select("id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("size"))
        sized = keep(sized, "digests")
        few = sized.where(hash_share(F.xxhash64("id"), 2 * DICT_PAGES + 1000, sized.count())).select(F.xxhash64("id").alias("k"), "id").distinct()
        few = few.orderBy("k", "id").limit(DICT_PAGES).select(F.col("id").alias("wanted"))
        sample = rows.join(F.broadcast(few), F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("id", F.substring("html", 1, DICT_CHARS).alias("h"))
        sample = sample.groupBy("id").agg(F.min("h").alias("h")).collect()  # DICT_PAGES rows
        dictionary = train_dictionary([r["h"].encode() for r in sorted(sample, key=lambda r: (r["id"] is None, r["id"]))])

        long = sized.where((F.col("size") >= REVISIT_BYTES) & F.col("id").isNotNull()).select("id", "digest")
        copied = keep(long.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "copied")
        found = salted_join(long, copied.select("digest", "first"), ["digest"], F.col("id"), hot_keys(copied, ["digest"]))
        revisits = found.where("id <> first").select(F.col("id").alias("id2"), F.col("digest").alias("digest2"), "first").distinct()
        revisits = keep(revisits, "revisits")
        whole = rows.withColumn("digest", F.sha2("html", 256))
        same = (F.col("id") == F.col("id2")) & (F.col("digest") == F.col("digest2"))
        if small_enough(revisits, F.lit(64)):
            whole = whole.join(F.broadcast(revisits), same, "left").drop("id2", "digest2")
        else:  # rows without id can't be revisits, and would all meet in one task
            found = whole.where("id is not null").join(revisits, same, "left").drop("id2", "digest2")
            whole = found.unionByName(whole.where("id is null").withColumn("first", F.lit(None).cast("long")))
        return _written(whole.select("id", "url", "html", "digest", F.col("first").alias("refers_to")), folder, dictionary)


def _written(rows: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Write records (id, url, html, digest, refers_to) to archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        out, n = Writer(dictionary), 0

        def close() -> pa.RecordBatch:
            nonlocal out, n
            store.create_dir(root, recursive=True)
            name = f"part-{context.partitionId():06d}-{n:04d}-{context.taskAttemptId()}.warc.zst"
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(out.buffer.getbuffer())
            row = [[f"{folder}/{name}"], [out.records], [out.size()]]
            out, n = Writer(dictionary), n + 1
            return pa.RecordBatch.from_arrays([pa.array(row[0]), pa.array(row[1], pa.int64()), pa.array(row[2], pa.int64())], ARCHIVE.names)

        for b in batches:
            for start, end, texts in parts_of(b.column(2)):
                rest = [b.column(i).slice(start, end - start).to_pylist() for i in (0, 1, 3, 4)]
                for page, page_id, url, digest, to in zip(texts, *rest):
                    out.add(record(page_id, url, page.encode("utf-8", "surrogatepass"), digest, to))
                    if out.size() >= ARCHIVE_BYTES:
                        yield close()
        if out.records:
            yield close()

    return stored(rows.mapInArrow(run, ARCHIVE), "archives")


def read_archives(archives: DataFrame, path_col: str = "path") -> DataFrame:
    """A row per record of the archives at these paths: page_id, payload_bytes, payload_digest, record_type, refers_to.

    An archive that a frame, a header, a length or a digest shows to be damaged ends the job with an error.  Paths that
    repeat are read each for itself; an empty table gives no rows.
    """
    ship(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], RECORD.names)

        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                with store.open_input_stream(at) as f:
                    for raw in read(f):
                        head, block = parse(raw)
                        size, digest = page_of(head, block)
                        own, to = head.get("x-page-id"), head.get("x-refers-to-page-id")
                        rows.append((int(own) if own else None, size, digest, head["warc-type"], int(to) if to else None))
                        if len(rows) >= 2048:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    n = max(1, archives.sparkSession.sparkContext.defaultParallelism * 4)
    return archives.select(quoted(path_col)).repartition(n).mapInArrow(run, RECORD)
