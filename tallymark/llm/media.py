"""Media columns: texts stored losslessly as 8-bit grey PNG members of ZIP archives, read back by a
custom data source.

Writing: every attempt of a task streams its rows into archives of its own under the shared folder and
returns their names, sizes and members. Spark commits the rows of one attempt of each task, so the table of
these rows is the folder's manifest: archives of lost, retried or speculative attempts are not in it.

Reading: ``MediaArchives`` plans byte ranges from the sizes in the manifest, or of all archives in a
folder that has none; every range is checked against the manifest's count of members. The task
of a range reads the archive's central directory, takes the members whose local header starts in
the range, and streams their payloads as Arrow batches of bounded size. A member that cannot be
read is retried by itself at its offset, over a newly opened file; after the last attempt the task
fails (a member is never skipped).

Defined results: null text is the empty text; an empty text is 64 zero bytes; equal texts give
equal values in every column but doc_id; repeated rows give a row each; a null doc_id stays null;
an empty table gives no rows; columns of the input other than the two named are not used.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import opened_fs, scratch, shipped, table

SIDE = 64  #: payloads are padded to a positive multiple of this; also the images' width
ARCHIVE_BYTES = 256 << 20  #: an archive is closed at this size
SPLIT_BYTES = 32 << 20  #: byte range of one read partition
BATCH_BYTES = 4 << 20  #: payload of one Arrow batch
ATTEMPTS = 3  #: reads of one member
MANIFEST = "manifest"  #: Parquet table in a folder of archives: archive, bytes, members
_MAGIC = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of SIDE."""
    return data.ljust(max(SIDE, -(-len(data) // SIDE) * SIDE), b"\0")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(data: bytes) -> bytes:
    """The padded data as rows of SIDE grey samples; a text chunk keeps the unpadded length."""
    rows = np.frombuffer(padded(data), np.uint8).reshape(-1, SIDE)
    lines = np.zeros((len(rows), SIDE + 1), np.uint8)  # each line starts with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", SIDE, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(lines, 3)) + _chunk(b"IEND", b"")


def decode_png(png: bytes) -> tuple[bytes, int]:
    """Samples and unpadded length of an image that encode_png made."""
    if png[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, found = 8, {}
    while at < len(png):
        (n,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError("damaged PNG chunk")
        found[kind] = found.get(kind, b"") + body
        at += 12 + n
    width, height = struct.unpack_from(">II", found[b"IHDR"])
    lines = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes(), int(found[b"tEXt"].partition(b"\0")[2])


def feature(samples: bytes) -> str:
    """Mean, deviation, entropy in bits, distinct values and largest run-free contrast of samples."""
    x = np.frombuffer(samples, np.uint8)
    n = np.bincount(x, minlength=256)
    v, total = np.arange(256), len(x)
    s1, s2 = int((n * v).sum()), int((n * v * v).sum())
    mean = s1 / total
    p = n[n > 0] / total
    step = int(np.abs(np.diff(x.astype(np.int16))).sum()) if total > 1 else 0
    return f"mean={mean:.6f};std={math.sqrt(max(0.0, s2 / total - mean * mean)):.6f};entropy={-float((p * np.log2(p)).sum()):.6f};levels={int((n > 0).sum())};contrast={step / max(1, total - 1):.6f}"


def write_archives(docs: DataFrame, id_col: str, text_col: str, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Stores every row's text as an archive member; returns the folder."""
    spark = shipped(docs.sparkSession)
    folder = scratch(spark, "media")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = opened_fs(folder)
        fs.create_dir(root, recursive=True)
        done, out, zf, name = [], None, None, ""

        def close() -> None:
            nonlocal zf
            zf.close()
            size = out.tell()
            out.close()
            done.append((name, size, row))
            zf = None

        row = 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                if zf is None:
                    name, row = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):05d}.zip", 0
                    out = fs.open_output_stream(f"{root}/{name}", buffer_size=1 << 20)
                    zf = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                key = doc.as_py()
                zf.writestr(zipfile.ZipInfo(f"{row:09d}{'' if key is None else f'_{key}'}.png"), encode_png((text.as_py() or "").encode("utf-8", "surrogatepass")))
                row += 1
                if out.tell() >= archive_bytes:
                    close()
        if zf is not None:
            close()
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], ["archive", "bytes", "members"])

    docs.select(id_col, text_col).mapInArrow(write, "archive string, bytes long, members long").write.parquet(f"{folder}/{MANIFEST}")
    return folder


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, members: int | None):
        self.path, self.start, self.end, self.members = path, start, end, members


class MediaArchives(DataSource):
    """Format ``media_archives``: members of the ZIP archives in the folder given by ``path``."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "archive string, member string, member_offset long, media binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.attempts = int(options.get("attempts", ATTEMPTS))
        self.batch = int(options.get("batch_bytes", BATCH_BYTES))

    def partitions(self) -> list[_Range]:
        fs, root = opened_fs(self.path)
        if fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.Directory:
            archives = pads.dataset(f"{root}/{MANIFEST}", filesystem=fs, format="parquet").to_table().to_pylist()
        else:
            files = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
            archives = [{"archive": f.base_name, "bytes": f.size, "members": None} for f in files if f.is_file and f.base_name.endswith(".zip") and f.base_name[0] not in "._"]
        archives.sort(key=lambda a: a["archive"])
        return [_Range(a["archive"], at, min(at + self.split, a["bytes"]), a["members"]) for a in archives for at in range(0, a["bytes"], self.split)] or [_Range("", 0, 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, root = opened_fs(self.path)

        def opened() -> zipfile.ZipFile:
            return zipfile.ZipFile(fs.open_input_file(f"{root}/{part.path}"))

        zf, rows, held = opened(), [], 0
        if part.members is not None and len(zf.infolist()) != part.members:
            raise ValueError(f"{part.path} holds {len(zf.infolist())} members, its manifest says {part.members}")
        for info in sorted(zf.infolist(), key=lambda i: i.header_offset):
            if not part.start <= info.header_offset < part.end:
                continue
            for attempt in range(self.attempts):
                try:
                    data = zf.read(info)  # checks the member's CRC
                    break
                except (OSError, zipfile.BadZipFile, EOFError):
                    if attempt + 1 == self.attempts:
                        raise
                    zf = opened()
            rows.append((part.path, info.filename, info.header_offset, data))
            held += len(data)
            if held >= self.batch:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["archive", "member", "member_offset", "media"])


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(spark: SparkSession, folder: str) -> DataFrame:
    """A row of FEATURES for each member of the archives in folder, from the stored bytes."""
    spark.dataSource.register(MediaArchives)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_bytes", "payload_bytes")), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
        for batch in batches:
            rows = []
            for member, media in zip(batch.column(0).to_pylist(), batch.column(1)):
                png = media.as_py()
                data, n = decode_png(png)
                key = member[:-4].partition("_")[2]
                rows.append((int(key) if key else None, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-SIDE:]), len(png), hashlib.sha256(png).hexdigest(), feature(data)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return spark.read.format("media_archives").load(folder).select("member", "media").mapInArrow(features, FEATURES)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return media_features(spark, write_archives(docs, "doc_id", "text"))


ORACLES = {}
QUERIES = {"op1_media": op1_media}
__all__ = ["MediaArchives", "write_archives", "media_features", "encode_png", "decode_png", "feature", "padded", "op1_media"]
