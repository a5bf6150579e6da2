"""Operator 6, media columns: content-addressed payloads in tar shards.

A text becomes a payload (its UTF-8 with zero bytes up to a positive multiple of 64) and is stored
losslessly as an 8-bit greyscale PNG, 64 samples wide. Each task packs the different payloads that it
meets into tar shards in the shared folder, named by their SHA-256; the row keeps digest, shard, offset
and length. Rows are written as the manifest, so a lost executor repeats its shards under new names and
the manifest points only to those of finished tasks.

Reading goes two ways. :func:`with_headers` fills metadata columns from range reads of the first
bytes of each member, never touching payloads. :func:`read_back` range-reads whole members, decodes
them, checks the digest and computes features; equal neighbours are read once. A third of all rows may
be one text: each task stores it once, and no text ever travels. Where several tasks have stored a payload, all its rows
point to one of the members (:func:`one_place`), so equal texts have equal places; the other members stay unread.

Shards go through Arrow's file systems: ``file``, ``hdfs``, ``s3``/``s3a``, ``gs`` and ``abfs``/``abfss`` folders; any other kind of shared
folder is refused. A failed task leaves a shard that no row points to.

Defined results: null and empty texts are a payload of 64 zero bytes; repeated rows share a member;
equal texts give equal values. An empty table gives an empty manifest.
"""

from __future__ import annotations

import binascii
import hashlib
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, text_or_empty, work_dir
from tidewatch.llm.tokens import blocks, column_texts

#: Production parameters: samples in a row, bytes of a shard after which the next begins, effort of deflate.
WIDTH = 64
SHARD_BYTES = 256 << 20
DEFLATE_LEVEL = 4
ROWS_AT_A_TIME = 256
#: Payloads whose place a task remembers; one that it has forgotten is stored again.
KNOWN = 200_000
# The PNG signature; bytes before the first sample data: signature and header chunk.
PNG = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
TAR_BLOCK = 512
# How schemes of Hadoop are called by Arrow.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasb": "abfs", "wasbs": "abfs"}


def payload_of(text: str) -> bytes:
    data = text.encode()
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", binascii.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """8-bit greyscale, filter 0 on every row."""
    rows = len(payload) // WIDTH
    squeeze = zlib.compressobj(DEFLATE_LEVEL)
    lines = b"".join(b"\0" + payload[i : i + WIDTH] for i in range(0, len(payload), WIDTH))
    data = squeeze.compress(lines) + squeeze.flush()
    return PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", data) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first bytes of a file."""
    if head[:8] != PNG or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def from_png(data: bytes) -> bytes:
    """The samples of a file of :func:`to_png`, with every checksum verified."""
    width, height, bits = png_header(data)
    at, packed = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != binascii.crc32(kind + body):
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    raw = zlib.decompress(b"".join(packed))
    if bits != 8 or len(raw) != height * (width + 1) or any(raw[:: width + 1]):
        raise ValueError("not stored as 8-bit samples without filters")
    return b"".join(raw[i + 1 : i + 1 + width] for i in range(0, len(raw), width + 1))


def tar_header(name: str, size: int) -> bytes:
    """A ustar header with fixed owner, mode and time, so that equal members are equal bytes."""
    # sizes of 8 GiB and more go in base 256, as GNU tar writes them
    field = b"%011o\0" % size if size < 8 << 30 else b"\x80" + size.to_bytes(11, "big")
    head = struct.pack("100s8s8s8s12s12s8sc100s6s2s32s32s8s8s155s12x", name.encode(), b"0000644\0", b"0000000\0", b"0000000\0", field, b"00000000000\0", b" " * 8, b"0", b"", b"ustar\0", b"00", b"", b"", b"0000000\0", b"0000000\0", b"")
    return head[:148] + b"%06o\0 " % sum(head) + head[156:]


def _store(folder: str):
    """The file system of the shared folder and the folder's path there."""
    from pyarrow import fs

    scheme, found, rest = folder.partition("://")
    if found and scheme in SCHEMES:
        folder = f"{SCHEMES[scheme]}://{rest}"
    elif folder.startswith("file:/") and not found:
        folder = f"file://{folder.removeprefix('file:')}"
    return fs.FileSystem.from_uri(folder)


class ShardWriter:
    """Tar shards of one task; a payload that the task has stored already is not stored again."""

    def __init__(self, folder: str, shard_bytes: int = SHARD_BYTES):
        self.fs, self.root = _store(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.shard_bytes = shard_bytes
        self.known: dict[bytes, tuple[str, int, int]] = {}
        self.out, self.name, self.at = None, "", 0

    def put(self, text: str) -> tuple[str, str, int, int]:
        """(digest, shard, offset, length) of a text's stored form."""
        payload = payload_of(text)
        digest = hashlib.sha256(payload).digest()
        if digest not in self.known:
            data = to_png(payload)
            if self.out is None or self.at >= self.shard_bytes:
                self.close()
                self.name = f"{uuid.uuid4().hex}.tar"
                self.out, self.at = self.fs.open_output_stream(f"{self.root}/{self.name}"), 0
            self.out.write(tar_header(f"{digest.hex()}.png", len(data)))
            self.out.write(data + bytes(-len(data) % TAR_BLOCK))
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[digest] = self.name, self.at + TAR_BLOCK, len(data)
            self.at += TAR_BLOCK + len(data) + -len(data) % TAR_BLOCK
        return (digest.hex(), *self.known[digest])

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * TAR_BLOCK))
            self.out.close()
            self.out = None


def write_shards(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The stored manifest: doc_id, n_bytes, digest, shard, offset, length of each row."""
    source = docs.select(key, text_or_empty(text).alias("__text"))

    def packed(batches):
        writer = ShardWriter(folder, shard_bytes)
        for batch in batches:
            rows: list[tuple] = []
            for block in blocks(column_texts(batch, "__text")):
                rows += [(len(t.encode()), *writer.put(t)) for t in block]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        writer.close()

    kind = source.schema[key].dataType.simpleString()
    return stored(source.mapInArrow(packed, f"doc_id {kind}, n_bytes long, digest string, shard string, offset long, length long"), "manifest")


def one_place(manifest: DataFrame) -> DataFrame:
    """The manifest with one place (shard, offset, length) for each digest: the smallest. Only digests that lie at several
    places are joined; hot ones have few places, at most one a task, and their rows need no shuffle of texts."""
    places = manifest.select("digest", "shard", "offset", "length").distinct()
    least = places.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("__at"), F.count("*").alias("__n")).where("__n > 1")
    least = stored(least.select("digest", "__at"), "places")
    joined = manifest.join(least, "digest", "left")
    at = {c: F.coalesce(F.col(f"__at.{c}"), F.col(c)) for c in ("shard", "offset", "length")}
    return stored(joined.withColumns(at).select(*manifest.columns), "manifest")


class ShardReader:
    """Range reads of members; one shard is open at a time."""

    def __init__(self, folder: str):
        self.fs, self.root = _store(folder)
        self.name, self.file = "", None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            self.close()
            self.name, self.file = shard, self.fs.open_input_file(f"{self.root}/{shard}")
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.name, self.file = "", None


def with_headers(manifest: DataFrame, folder: str) -> DataFrame:
    """The manifest with media_width, media_height and media_bits, from the first bytes of each member."""

    def read(batches):
        reader = ShardReader(folder)
        for batch in batches:
            column = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            found = [png_header(reader.read(s, o, min(HEADER_BYTES, n))) for s, o, n in zip(column["shard"], column["offset"], column["length"], strict=True)]
            columns = zip(*found, strict=True) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(list(c), pa.int32()) for c in columns]], names=[*batch.schema.names, "media_width", "media_height", "media_bits"])
        reader.close()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in manifest.schema)
    return manifest.mapInArrow(read, f"{fields}, media_width int, media_height int, media_bits int")


def feature_of(payload: bytes) -> str:
    """Shape, mean sample and number of different samples: whole-number figures of all samples."""
    return f"{WIDTH}x{len(payload) // WIDTH} mean {sum(payload) * 1000 // len(payload)} kinds {len(set(payload))}"


def read_back(manifest: DataFrame, folder: str) -> DataFrame:
    """The manifest with figures of the payload and the stored form, from the bytes in the shards."""

    def figures(data: bytes, digest: str) -> tuple:
        payload = from_png(data)
        sha = hashlib.sha256(payload).hexdigest()
        if sha != digest:
            raise ValueError(f"member {digest} holds {sha}")
        return len(payload), sha, zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(payload)

    def read(batches):
        reader = ShardReader(folder)
        last, found = None, None
        for batch in batches:
            for part in (batch.slice(i, ROWS_AT_A_TIME) for i in range(0, batch.num_rows, ROWS_AT_A_TIME)):
                column = {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}
                rows = []
                for at in zip(column["shard"], column["offset"], column["length"], column["digest"], strict=True):
                    if at != last:
                        last, found = at, figures(reader.read(*at[:3]), at[3])
                    rows.append(found)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=[*part.schema.names, *names])
        reader.close()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in manifest.schema)
    return manifest.mapInArrow(read, f"{fields}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """Rows with metadata and figures, and the folder of their shards."""
    folder = work_dir(docs.sparkSession, "shards")
    manifest = one_place(write_shards(docs, folder, key, text))
    return read_back(with_headers(manifest, folder), folder), folder
