"""Consolidating very many tiny files into few well-sized ones, by joining bytes.

Nothing is parsed. What a file is decides how its bytes can be joined:

* complete zstandard frames are appended as they are (a file of several frames is a valid zstandard file); that they are
  complete is read off the frame and block headers, nothing is decompressed;
* newline-delimited text (.jsonl, .ndjson, .txt, .log) is appended, with a newline where the last line has none;
* text with a header (.csv, .tsv) likewise, into packs of that header, which is kept once at the start;
* anything else becomes one complete zstandard frame (stored, or compressed where that pays) and is appended.

A record is a place (the resolved path) with a content, known by the SHA-256 of both; stored copies of it are kept once.
Two passes read the files:

1. Digests are made and counted. Only 16 bytes of a digest and an id are shuffled. Those that occur more than once are
   marked in a filter of a fixed size, in which every one of them is found, and few others.
2. A file whose digest is not in the filter is the only one of its record. It is packed where it is read: its content is
   never shuffled. The others are grouped by their digest, one of each is kept, and these are packed as well. Should very
   many records have copies, the filter passes more on to the grouping; the result is the same.

A task writes packs of ``target_bytes`` under a temporary name and renames them when complete. A pack is named by the
digest of its first record, and its rows come in a fixed order, so a task that is run again after a loss writes the same
packs again. Only the index says which packs count (``remove_strays`` deletes the others). A pack is read back by its
index, and lengths and digests are compared.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gridloom.runtime import cut, new_path, pick, put_in_place, qualified

MAGIC = b"\x28\xb5\x2f\xfd"
TARGET_BYTES = 128 << 20
LEAST_SHARE = 8  # a task gets at least a packful divided by this, so that few files do not become many packs
OPEN_PACKS = 16
COMPRESS_FROM = 1 << 10
FILTER_BITS = 26  # of the filter of repeated digests: 8 MB
INDEX = "record binary, file_id bigint, last_file_id bigint, stored_files bigint, path string, pack string, how string, header_bytes int, pack_offset bigint, stored_bytes bigint, record_bytes bigint"
_TYPES = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
_ODD = re.compile(r"(^|/)\.{0,2}(/|$)")


def resolved(path: str) -> str:
    """The place a path leads to, as :func:`gridloom.functions.keys.path_key` has it."""
    path = path.replace("\\", "/")
    if not _ODD.search(path):
        return path
    done: list[str] = []
    for part in path.split("/"):
        if part == "..":
            del done[-1:]
        elif part not in ("", "."):
            done.append(part)
    return "/".join(done)


def record_digest(place: str | None, data: bytes) -> bytes:
    """The SHA-256 of a resolved path and a content. No path is a place of its own."""
    head = b"\x00" if place is None else b"\x01" + place.encode("utf-8", "replace") + b"\x00"
    return hashlib.sha256(head + data).digest()


def stored_frame(data: bytes) -> bytes:
    """``data`` as one complete zstandard frame without compression (single segment, raw blocks)."""
    n = len(data)
    if n < 256:
        head = b"\x20" + bytes([n])
    elif n < 65_792:
        head = b"\x60" + struct.pack("<H", n - 256)
    elif n < 1 << 32:
        head = b"\xa0" + struct.pack("<I", n)
    else:
        head = b"\xe0" + struct.pack("<Q", n)
    parts = [MAGIC, head]
    step = 128 << 10
    for at in range(0, max(n, 1), step):
        block = data[at : at + step]
        parts += [struct.pack("<I", (len(block) << 3) | (at + step >= n))[:3], block]
    return b"".join(parts)


def unframed(stored: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(stored), read_across_frames=True).read()


def _whole_frames(data: bytes) -> bool:
    """Whether ``data`` is nothing but complete zstandard frames, by their headers and those of their blocks."""
    at, n = 0, len(data)
    while at < n:
        magic = data[at : at + 4]
        if len(magic) == 4 and magic[1:] == b"\x2a\x4d\x18" and magic[0] >> 4 == 5:  # a frame to be skipped
            if at + 8 > n:
                return False
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            continue
        if magic != MAGIC or at + 5 > n:
            return False
        flags = data[at + 4]
        if flags & 0x08:
            return False
        single = flags >> 5 & 1
        size = (single, 2, 4, 8)[flags >> 6]
        at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + size
        last = False
        while not last:
            if at + 3 > n:
                return False
            block = int.from_bytes(data[at : at + 3], "little")
            last, kind = bool(block & 1), block >> 1 & 3
            if kind == 3:
                return False
            at += 3 + (1 if kind == 1 else block >> 3)
        at += 4 * (flags >> 2 & 1)
    return at == n


def joinable(path: str | None, data: bytes) -> tuple[str, bytes, bytes]:
    """(how, header, bytes to append) of one file."""
    if data[:4] == MAGIC and _whole_frames(data):
        return "frames", b"", data
    end = (path or "")[-8:].lower().rpartition(".")[2]
    if end in ("jsonl", "ndjson", "txt", "log"):
        return "lines", b"", data if data[-1:] in (b"\n", b"") else data + b"\n"
    if end in ("csv", "tsv"):
        header, newline, body = data.partition(b"\n")
        if newline:
            return "headed", header + newline, body if body[-1:] in (b"\n", b"") else body + b"\n"
    if len(data) < COMPRESS_FROM:
        return "framed", b"", stored_frame(data)
    import zstandard

    return "framed", b"", zstandard.ZstdCompressor(level=3).compress(data)


def restored(how: str, header: bytes, stored: bytes, record_bytes: int) -> bytes:
    """The file's own bytes from what was stored of it."""
    if how == "framed":
        return unframed(stored)
    return stored if how == "frames" else (header + stored)[:record_bytes]


class _Packs:
    """The packs that one task has open. Files are written whole or not at all."""

    def __init__(self, folder: str, target: int):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.folder, self.target = folder, target
        self.open: OrderedDict[tuple, list] = OrderedDict()

    def put(self, name: str | None, data: bytes, digest: bytes) -> tuple[str, str, int, int, int, int]:
        """Append a file; (pack, how, header bytes, offset, stored bytes, record bytes)."""
        how, header, stored = joinable(name, data)
        if header and ("headed", header) not in self.open and len(self.open) >= OPEN_PACKS:
            how, header, stored = "framed", b"", stored_frame(data)  # one more kind of header: no pack of its own
        kind = "frames" if how in ("framed", "frames") else how
        key = (kind, header)
        pack = self.open.get(key)
        if pack and pack[2] >= self.target:
            self.close(key)
            pack = None
        if not pack:
            name = f"pack-{digest.hex()[:32]}.{'zst' if kind == 'frames' else 'csv' if kind == 'headed' else 'txt'}"
            part = f"{self.root}/.{name}.{uuid.uuid4().hex[:8]}.part"
            pack = self.open[key] = [name, self.fs.open_output_stream(part), 0, part]
            if header:
                pack[1].write(header)
                pack[2] = len(header)
        at = pack[2]
        pack[1].write(stored)
        pack[2] += len(stored)
        return f"{self.folder}/{pack[0]}", how, len(header), at, len(stored), len(data)

    def close(self, key=None) -> None:
        for k in [key] if key else list(self.open):
            name, stream, _, part = self.open.pop(k)
            stream.close()
            put_in_place(self.fs, part, f"{self.root}/{name}")


@dataclass(frozen=True)
class Compaction:
    """``index``: a row for each record, with its digest, its pack and place in it, its length, the smallest and largest
    id of the files that hold it and their number. ``files``: (file_id, record) of the input files whose record may have
    copies; all others are the ``file_id`` of their index row."""

    index: DataFrame
    files: DataFrame
    folder: str

    def packs(self) -> DataFrame:
        """``(pack, records, pack_bytes, record_bytes)`` of every pack."""
        return self.index.groupBy("pack").agg(F.count("*").alias("records"), (F.max("header_bytes") + F.sum("stored_bytes")).alias("pack_bytes"), F.sum("record_bytes").alias("record_bytes"))

    def members(self) -> DataFrame:
        """``(file_id, representative)`` of every file whose record is stored more than once: the membership, in as many
        rows as there are such files."""
        many = self.index.where("stored_files > 1").select("record", F.col("file_id").alias("representative"))
        return self.files.join(many, "record").select("file_id", "representative")

    def copies(self) -> DataFrame:
        """``(file_id_a, file_id_b)``: all pairs of files that hold the same record, the smaller id first. Of k copies
        these are k (k - 1) / 2 rows; :meth:`members` says the same in k."""
        many = self.index.where("stored_files > 1")
        two = many.where("stored_files = 2 and file_id < last_file_id").select(F.col("file_id").alias("file_id_a"), F.col("last_file_id").alias("file_id_b"))
        more = cut(self.files.join(many.where("stored_files > 2").select("record"), "record", "left_semi").distinct(), "compaction-copies")
        a, b = more.select("record", F.col("file_id").alias("file_id_a")), more.select("record", F.col("file_id").alias("file_id_b"))
        return two.unionByName(a.join(b, "record").where("file_id_a < file_id_b").select("file_id_a", "file_id_b"))

    def remove_strays(self) -> list[str]:
        """Delete what attempts of lost tasks left in the folder: files that no index row names. Returns their names."""
        from pyarrow import fs

        named = {r["pack"].rsplit("/", 1)[1] for r in self.index.select("pack").distinct().collect()}  # packs, not records
        where, root = fs.FileSystem.from_uri(self.folder)
        gone = [f for f in where.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name not in named]
        for f in gone:
            where.delete_file(f.path)
        return sorted(f.base_name for f in gone)

    def validate(self) -> DataFrame:
        """``(pack, records, pack_bytes, wrong)``: every record is cut out of its pack again; ``wrong`` counts those
        whose length or digest differs, and places of a pack that no record or several records cover."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs

            name, stream, header, seen = None, None, b"", [0, 0, 0]
            out: list[tuple] = []

            def done() -> None:
                if stream is not None:
                    size = stream.size()
                    out.append((name, seen[0], size, seen[2] + (seen[1] != size)))
                    stream.close()

            for batch in batches:
                for pack, how, head, at, stored, size, path, record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if pack != name:
                        done()
                        where, root = fs.FileSystem.from_uri(pack)
                        name, stream = pack, where.open_input_file(root)
                        header, seen = stream.read(head), [0, head, 0]
                        reader = _Ahead(stream, head)
                    data = restored(how, header, reader.take(at, stored), size)
                    seen[0] += 1
                    seen[2] += len(data) != size or record_digest(path, data) != record or at != seen[1]
                    seen[1] = at + stored
            done()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["pack", "records", "pack_bytes", "wrong"])

        src = self.index.select("pack", "how", "header_bytes", "pack_offset", "stored_bytes", "record_bytes", "path", "record")
        # A pack is bounded by its target size, and so is the number of its rows in a task.
        return src.repartition("pack").sortWithinPartitions("pack", "pack_offset").mapInArrow(run, "pack string, records bigint, pack_bytes bigint, wrong bigint")


class _Ahead:
    """Sequential reads in large pieces."""

    def __init__(self, stream, at: int, piece: int = 4 << 20):
        self.stream, self.start, self.piece, self.held = stream, at, piece, b""

    def take(self, at: int, size: int) -> bytes:
        if not (self.start <= at and at + size <= self.start + len(self.held)):
            self.stream.seek(at)
            self.held, self.start = self.stream.read(max(self.piece, size)), at
        return self.held[at - self.start : at - self.start + size]


def compact_files(files: DataFrame, target_bytes: int = TARGET_BYTES, id_col: str = "file_id", path_col: str = "crop_relative_path", payload_col: str = "payload", folder: str | None = None, filter_bits: int = FILTER_BITS) -> Compaction:
    """Pack the files of ``(file_id, path, payload)`` into ``folder`` (by default in the shared folder).

    Real files come in through ``spark.read.format("binaryFile")``. Paths are compared where they lead, letter case
    counts. Tasks get at least an eighth of ``target_bytes`` each, and as many packs as their part of the input fills, so
    the sizes follow from the bytes and the input's partitions only. ``filter_bits``: the filter of repeated digests has
    ``2**filter_bits`` bits; it should be some times the number of records with copies.

    Defined results: a null path is a place of its own kind, equal to no other path; a null payload is an empty file;
    empty files are stored and come back empty; a file larger than ``target_bytes`` fills a pack alone; text with a header
    of its own, beyond the 16 headers that a task has open, is stored as a frame; repeated ids with the same record count
    once as a pair partner; an empty table writes no pack; extra columns are ignored.
    """
    spark, files = files.sparkSession, pick(files, id_col, path_col, payload_col)
    folder = qualified(spark, folder or new_path(spark, "packs"))
    src = files.select(F.col(id_col).cast("bigint").alias("file_id"), F.col(path_col).cast("string").alias("path"), F.col(payload_col).alias("payload"))

    def read(batch: pa.RecordBatch) -> Iterator[tuple[int | None, str | None, bytes, bytes]]:
        for number, path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            place, data = None if path is None else resolved(path), data or b""
            yield number, place, data, record_digest(place, data)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(data), digest) for _, _, data, digest in read(batch)]
            half = np.frombuffer(b"".join(d[:16] for _, d in rows), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(half[:, 0]), pa.array(half[:, 1]), pa.array([n for n, _ in rows], pa.int64())], names=["h1", "h2", "size"])

    sizes = Observation()
    counted = src.mapInArrow(digests, "h1 bigint, h2 bigint, size bigint").observe(sizes, F.sum("size").alias("bytes"))
    repeated = cut(counted.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1"), "compaction-repeated")
    words = 1 << (filter_bits - 6)
    bits = repeated.groupBy(F.shiftrightunsigned("h1", 6).bitwiseAND(F.lit(words - 1)).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h1 & 63 as int))")).alias("bits")).toArrow()
    marked = np.zeros(words, dtype=np.int64)  # 2**filter_bits bits, however many rows there are
    marked[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(marked)

    def tasks(seen: Observation) -> int:
        try:
            total = seen.get["bytes"] or 0
        except Py4JJavaError:  # of an empty table nothing is run, and nothing is observed
            total = 0
        return max(1, -(-total * LEAST_SHARE // target_bytes))

    def emitted(made: list[tuple], carried: list[bytes | None]) -> pa.RecordBatch:
        columns = [pa.array([m[i] for m in made], t) for i, t in enumerate(_TYPES)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(carried, pa.binary())], names=[*(x.split()[0] for x in INDEX.split(", ")), "payload"])

    def pack_single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs, known = _Packs(folder, target_bytes), shared.value
        for batch in batches:
            made, carried = [], []
            for number, place, data, digest in read(batch):
                h = int.from_bytes(digest[:8], "little")
                if int(known[h >> 6 & words - 1]) >> (h & 63) & 1:
                    made.append((digest, number, None, None, place, None, None, None, None, None, len(data)))
                    carried.append(data)
                else:
                    made.append((digest, number, number, 1, place, *packs.put(place, data, digest)))
                    carried.append(None)
            yield emitted(made, carried)
        packs.close()

    moved = Observation()
    first = src.coalesce(tasks(sizes)).mapInArrow(pack_single, INDEX + ", payload binary").observe(moved, F.sum(F.octet_length("payload")).alias("bytes"))
    first = cut(first, "compaction-first")
    carried = first.where("payload is not null")
    once = carried.groupBy("record").agg(F.min("file_id").alias("file_id"), F.max("file_id").alias("last_file_id"), F.count("*").alias("stored_files"), F.min_by(F.struct("path", "payload"), F.struct("file_id")).alias("f"))
    once = once.select("record", "file_id", "last_file_id", "stored_files", "f.path", "f.payload").coalesce(tasks(moved)).sortWithinPartitions("record")

    def pack_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = _Packs(folder, target_bytes)
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield emitted(made := [(digest, number, last, n, place, *packs.put(place, data, digest)) for digest, number, last, n, place, data in rows], [None] * len(made))
        packs.close()

    second = cut(once.mapInArrow(pack_shared, INDEX + ", payload binary").drop("payload"), "compaction-second")
    return Compaction(first.where("payload is null").drop("payload").unionByName(second), carried.select("file_id", "record"), folder)
