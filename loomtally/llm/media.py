"""Media columns: content-addressed payloads in tar shards.

`write_shards` stores each row's payload losslessly as an 8-bit greyscale PNG of 64 pixels a line (a member named by its SHA-256) in
tar files of the shared folder; rows carry digest, shard, offset and length. Payloads that are equal within a shard are stored
once. `fill_metadata` reads only the first 33 bytes of a member, which hold the image header, and `read_payloads` decodes members.
A task that is run again writes a shard of a new name, and only the names in the rows of the successful attempt are ever read.

Defined results: a null or empty text is a payload of 64 zero bytes; equal texts have equal values in every column but the place
in a shard; an empty table gives an empty result; repeated rows and null ids are kept as they are; extra columns pass through each
function unless they clash with its own, in any case of letters.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtally.llm.shared import pack, quoted, scratch_path, unpack, written

WIDTH = 64
SHARD_BYTES = 32 << 20
#: Rows after which a shard is closed even if equal payloads have kept it small.
SHARD_ROWS = 20_000
LEVEL = 1
HEADER_BYTES = 33
REFERENCE = "digest string, shard string, offset long, length long, n_bytes long"
_MAGIC = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes) -> bytes:
    """payload: a positive multiple of WIDTH bytes, one a pixel. Every line has filter type 0."""
    height = len(payload) // WIDTH
    lines = bytearray((WIDTH + 1) * height)
    view = memoryview(lines)
    import numpy as np

    np.frombuffer(view, np.uint8).reshape(height, WIDTH + 1)[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, LEVEL)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first HEADER_BYTES bytes."""
    if data[:8] != _MAGIC or data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != struct.unpack(">I", data[29:33])[0]:
        raise ValueError("not the header of a PNG")
    width, height, bits = struct.unpack(">IIB", data[16:25])
    return width, height, bits


def decode_png(data: bytes) -> bytes:
    import numpy as np

    width, height, bits = png_header(data[:HEADER_BYTES])
    at, body = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(part, zlib.crc32(kind)):
            raise ValueError("a damaged chunk")
        if kind == b"IDAT":
            body.append(part)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if bits != 8 or lines[:, 0].any():
        raise ValueError("only unfiltered 8-bit lines are stored here")
    return lines[:, 1:].tobytes()


def image_feature(payload: bytes) -> str:
    """The image's size, the mean and the standard deviation of its samples, and its average hash: cells of 8 by 8, from the upper left, of
    which those that are lighter than the whole image are set. An image of fewer than 8 lines repeats lines."""
    import numpy as np

    lines = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).astype(np.int64)
    height, total = len(lines), int(lines.sum())
    low = np.arange(8) * height // 8
    high = np.maximum(low + 1, (np.arange(8) + 1) * height // 8)
    down = np.concatenate([np.zeros((1, 8), np.int64), lines.reshape(height, 8, WIDTH // 8).sum(2).cumsum(0)])
    cells = (down[high] - down[low]) * len(payload) > total * ((high - low) * (WIDTH // 8))[:, None]
    mean = total / len(payload)
    spread = max(0.0, int((lines * lines).sum()) / len(payload) - mean * mean) ** 0.5
    return f"grey8:{WIDTH}x{height}:mean={mean:.3f}:std={spread:.3f}:ahash={np.packbits(cells).tobytes().hex()}"


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Shard:
    """A tar file being written; members are content-addressed."""

    def __init__(self, folder: str) -> None:
        self.uri = f"{folder}/{uuid.uuid4().hex}.tar"
        self.fs, path = _place(self.uri)
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.at, self.members = self.fs.open_output_stream(path), 0, {}

    def add(self, data: bytes) -> tuple[str, int, int]:
        payload = padded(data)
        digest = hashlib.sha256(payload).hexdigest()
        if digest not in self.members:
            image = encode_png(payload)
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(image)
            block = info.tobuf(tarfile.USTAR_FORMAT) + image + bytes(-len(image) % 512)
            self.members[digest] = (self.at + 512, len(image))
            self.out.write(block)
            self.at += len(block)
        return digest, *self.members[digest]

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()


def write_shards(df: DataFrame, text: str = "text", folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """df without its text, with the columns of REFERENCE. Each task streams its rows into shards of about shard_bytes."""
    folder = folder or scratch_path(df.sparkSession, "media")
    names = [f.strip().split()[0] for f in REFERENCE.split(",")]
    own, row = pack(df, (text, *names))
    light = df.select(*row, F.col(quoted(text)).cast("string").alias("_text"))
    schema = T.StructType([*light.schema.fields[:-1], *T._parse_datatype_string(REFERENCE).fields])
    kept = light.columns[:-1]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, refs = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            # Rows leave only when their shard is closed, hence readable.
            nonlocal shard, held, refs
            if shard is not None:
                shard.close()
                columns = [pa.concat_arrays([b.column(k) for b in held]) for k in range(len(kept))] + [pa.array([r[i] for r in refs], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))]
                yield from pa.table(columns, kept + names).to_batches()
            shard, held, refs = None, [], []

        for batch in batches:
            start, bodies = 0, batch.column(len(kept))
            batch = batch.select(range(len(kept)))  # texts aren't held until the shard is closed
            for i in range(batch.num_rows):
                shard = shard or _Shard(folder)
                value = bodies[i].as_buffer()
                data = value.to_pybytes() if value is not None else b""
                digest, offset, length = shard.add(data)
                refs.append((digest, shard.uri, offset, length, len(data)))
                if shard.at >= shard_bytes or len(refs) >= SHARD_ROWS:
                    held.append(batch.slice(start, i + 1 - start))
                    start = i + 1
                    yield from flush()
            if start < batch.num_rows:
                held.append(batch.slice(start))
        yield from flush()

    return written(light.mapInArrow(write, schema), "refs").select(*unpack(own), *names)


def _ranges(refs: DataFrame, ddl: str, read) -> DataFrame:
    """Adds the columns of ddl, which read(file, offset, length) gives for each row of refs; rows come shard by shard, so a file is opened once in
    a run of them."""
    more = T._parse_datatype_string(ddl).fields
    own, row = pack(refs, tuple(f.name for f in more))
    placed = refs.select(*row, "shard", "offset", "length")
    schema = T.StructType([*placed.schema.fields[:-3], *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        uri, file = None, None
        for batch in batches:
            got = []
            for shard, offset, length in zip(*[c.to_pylist() for c in batch.columns[-3:]], strict=True):
                if shard != uri:
                    if file is not None:
                        file.close()
                    fs, path = _place(shard)
                    uri, file = shard, fs.open_input_file(path)
                got.append(read(file, offset, length))
            extra = [pa.array([g[i] for g in got], to_arrow_type(f.dataType)) for i, f in enumerate(more)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *extra], schema.names)
        if file is not None:
            file.close()

    return placed.mapInArrow(run, schema).select(*unpack(own), *[f.name for f in more])


def fill_metadata(refs: DataFrame) -> DataFrame:
    """Adds width, height and bits of each member by reading its header alone."""

    def read(file, offset: int, length: int):
        return png_header(file.read_at(HEADER_BYTES, offset))

    return _ranges(refs, "width int, height int, bits int", read)


def read_payloads(refs: DataFrame) -> DataFrame:
    """Adds what the stored bytes give when they are read back: media_bytes, media_sha256, payload_bytes, payload_sha256,
    tail_crc32 (of the last 64 payload bytes) and feature, as told by `image_feature`."""

    def read(file, offset: int, length: int):
        media = file.read_at(length, offset)
        payload = decode_png(media)
        return (
            len(media),
            hashlib.sha256(media).hexdigest(),
            len(payload),
            hashlib.sha256(payload).hexdigest(),
            zlib.crc32(payload[-64:]),
            image_feature(payload),
        )

    return _ranges(refs, "media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string", read)


def read_member(uri: str, offset: int, length: int) -> io.BytesIO:
    """One member's bytes, for callers outside a plan."""
    fs, path = _place(uri)
    with fs.open_input_file(path) as file:
        return io.BytesIO(file.read_at(length, offset))
