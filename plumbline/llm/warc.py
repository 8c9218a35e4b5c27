"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: each task writes one archive, a dictionary frame and then a frame per record. The frames are rows of
Spark's text writer, which puts raw bytes to any store that Spark writes to and commits them as a whole; its
line separator is an empty skippable frame, which every reader of Zstandard skips. Of records with equal
payloads of at least `least` bytes, that with the smallest page_id is a response and the others revisit it.

Reading: an archive is streamed a chunk at a time, where Arrow reads its file system (local, HDFS, S3, GCS, Azure), so that
a reader holds one frame and one chunk, however long the archive. Frames are found by walking their block headers, so that
each is decoded alone with the archive's dictionary. A record's version line, headers, Content-Length, end, payload length and, for responses, its
digest are checked; a fault raises ValueError with the archive and the offset.

Defined results: null html is an empty payload; a null url is written as the record's own id; control characters
and blanks in a url are percent-encoded. Rows without a page_id are written and read as null and are a response
only where no equal payload has an id. Repeated rows of the response's page_id are responses too. Extra columns
are ignored. An empty table gives no records. An archive is as large as what its task wrote: of one split of the input, or,
where more than BROADCAST_ROWS payloads repeat, of one shuffled partition.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import provenance, stable
from . import common

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed values of the formats: frame magics (little-endian) and the empty skippable frame between records.
FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
BETWEEN = struct.pack("<II", SKIPPABLE, 0)
LEVEL, DICT_BYTES, SAMPLES, SAMPLE_BYTES = 6, 65_536, 256, 32_768
#: Rows of the table of repeated payloads up to which it is broadcast (about 80 bytes each).
BROADCAST_ROWS = 100_000
#: Bytes that are read at once, and the file systems that are read so; of others Spark reads archives whole, up to 2 GB each.
CHUNK, STREAMED = 1 << 20, ("file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")


def train(samples: list[bytes]) -> bytes:
    """A dictionary from sample records; empty where there are too few to train one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY, len(dictionary)) + dictionary


def uri(url: str | None, own: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else own


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    own = f"urn:x-page:{'' if page_id is None else page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{own}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri(url, own)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _frames(dictionary: bytes):
    @common.tidy
    def run(batches):
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        codec = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
        began = False
        for batch in batches:
            out = [] if began else [dictionary_frame(dictionary)]
            began = True
            for page, url, html, sha, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "first_id")), strict=True):
                revisit = first is not None and page != first
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                out.append(codec.compress(record(page, url, (html or "").encode(), digest, first, revisit)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    return run


def with_first(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages with sha1 and first_id: the smallest page_id of the same payload where others hold it too, else null."""
    spark = pages.sparkSession
    hashed = pages.withColumn("payload", F.encode(F.coalesce("html", F.lit("")), "UTF-8")).withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload")).drop("payload")
    counts = hashed.where(F.col("size") >= least).groupBy("sha1", "size").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    again = common.stored(counts, "warc-repeated")
    if again.count() <= BROADCAST_ROWS:
        return hashed.join(F.broadcast(again.drop("rows")), ["sha1", "size"], "left")
    return common.hot_split(hashed, again, ["sha1", "size"], ["first_id"], pages.count())


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> str:
    """Writes pages as *.warc.zst below path, an archive per task. The dictionary is trained on a bounded sample by hash of the id."""
    spark = pages.sparkSession
    common.arrow_batches(spark)
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    chosen = [r["page_id"] for r in own.where("page_id is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLES).collect()]  # ids alone: every task sends its own smallest
    some = own.where(F.col("page_id").isin(chosen)).select(F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_BYTES).alias("html"), "url").limit(SAMPLES).collect() if chosen else []
    dictionary = train([record(0, r["url"], r["html"].encode(), "", None, False) for r in some])
    frames = with_first(own, least).mapInArrow(_frames(dictionary), "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("lineSep", BETWEEN.decode("ascii")).text(path)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = jvm.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in store.listStatus(folder):  # a name per archive
        name = found.getPath().getName()
        if name.endswith(".txt"):
            store.rename(found.getPath(), jvm.Path(folder, name[:-4] + ".warc.zst"))
    return path


class Truncated(ValueError):
    """A frame whose end isn't there."""


def frame_end(data: memoryview, at: int) -> int:
    """The end of the frame that begins at `at`, by its header and block headers."""
    if at + 4 > len(data):
        raise Truncated("truncated frame")
    (magic,) = struct.unpack_from("<I", data, at)
    if SKIPPABLE <= magic <= SKIPPABLE + 15:
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0] if at + 8 <= len(data) else len(data) + 1
    elif magic == FRAME:
        checked, end, last = data[at + 4] >> 2 & 1, at + zstandard.frame_header_size(bytes(data[at : at + 18])), 0
        while not last:
            if end + 3 > len(data):
                raise Truncated("truncated frame")
            head = int.from_bytes(data[end : end + 3], "little")
            last, kind = head & 1, head >> 1 & 3
            if kind == 3:
                raise ValueError("reserved block type")
            end += 3 + (1 if kind == 1 else head >> 3)
        end += 4 * checked
    else:
        raise ValueError(f"no frame: magic {magic:#x}")
    if end > len(data):
        raise Truncated("truncated frame")
    return end


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of the one record in raw."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"malformed header {line!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"header {name} is missing")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("Content-Length and block differ")
    return fields, rest[:-4]


def _page(value: str) -> int | None:
    tail = value.strip("<>").removeprefix("urn:x-page:")
    return int(tail) if tail else None


def unpacked(raw: bytes) -> dict:
    """One checked record: page_id, url, payload (None of a revisit), payload_bytes, payload_digest, record_type, refers_to."""
    fields, block = parse(raw)
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    http, gap, payload = block.partition(b"\r\n\r\n")
    sizes = [v for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.lower() == b"content-length"]
    if kind not in ("response", "revisit") or not gap or len(sizes) != 1:
        raise ValueError(f"unexpected {kind} record")
    if kind == "response" and (len(payload) != int(sizes[0]) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("payload differs from its length or digest")
    if kind == "revisit" and payload:
        raise ValueError("a revisit with a payload")
    refers = _page(fields["warc-refers-to"]) if kind == "revisit" else None
    return {"page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None, "payload_bytes": int(sizes[0]), "payload_digest": digest, "record_type": kind, "refers_to": refers}


def frames(source: bytes | io.IOBase):
    """(offset, frame) of an archive; what is read at once grows with the frame that it is for."""
    stream, held, base, at, ended = io.BytesIO(source) if isinstance(source, bytes) else source, b"", 0, 0, False
    while True:
        if at < len(held):
            try:
                end = frame_end(memoryview(held), at)
            except (ValueError, zstandard.ZstdError) as e:
                short = isinstance(e, Truncated) or len(held) - at < 18  # of a header there may be only a part
                if ended or not short:
                    raise ValueError(f"at byte {base + at}: {e}") from e
            else:
                yield base + at, held[at:end]
                at = end
                continue
        elif ended:
            return
        data = stream.read(max(CHUNK, len(held) - at))
        ended, held, base, at = not data, held[at:] + data, base + at, 0


def records(source: bytes | io.IOBase):
    """The records of one archive."""
    codec, first = zstandard.ZstdDecompressor(), True
    for at, frame in frames(source):
        try:
            (magic,) = struct.unpack_from("<I", frame)
            if magic == FRAME:
                yield unpacked(codec.decompress(frame))
            elif magic == DICTIONARY and first and len(frame) > 8:
                own = frame[8:]
                if own[:4] == struct.pack("<I", FRAME):
                    own = zstandard.ZstdDecompressor().decompress(own)
                codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own))
        except (ValueError, zstandard.ZstdError, UnicodeDecodeError) as e:
            raise ValueError(f"at byte {at}: {e}") from e
        first = False


SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
_TYPES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _read(with_payload: bool, streamed: bool, rows: int = 256):
    @common.tidy
    def run(batches):
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                held, size = [], 0
                try:
                    with provenance.opened(path) if streamed else io.BytesIO(batch.column("content")[i].as_py()) as source:
                        for r in records(source):
                            held.append(r if with_payload else r | {"payload": None})
                            size += len(held[-1]["payload"] or b"")
                            if len(held) == rows or size > 8 * CHUNK:
                                yield pa.RecordBatch.from_pylist(held, _TYPES)
                                held, size = [], 0
                except ValueError as e:
                    raise ValueError(f"{path} {e}") from e
                yield pa.RecordBatch.from_pylist(held, _TYPES)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all *.warc.zst below path."""
    common.arrow_batches(spark)
    streamed = stable.address(path).partition(":")[0] in STREAMED
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return found.select("path", *([] if streamed else ["content"])).mapInArrow(_read(with_payload, streamed), SCHEMA)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archives(common.table(spark, sf_dir, "pages"), common.scratch_path(spark, "warc"))
    return read_archives(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
