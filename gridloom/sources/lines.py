"""Physical lines of files as a data source, with their numbers and byte offsets, in batch and as a stream.

A file is cut into byte ranges that tasks read in large pieces; a line belongs to the range in which it begins. Numbers
within a range become numbers of the file by adding the lines of the ranges before, a small table that comes from counting
newlines. Lines longer than ``max_line_bytes`` are passed over without being held; they come out as null with
``too_large``. The stream's offsets are byte positions, so the driver looks at sizes and the ends of files only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "path string, range_start bigint, line_in_range bigint, byte_offset_end bigint, raw_line binary, too_large boolean"
MAX_LINE_BYTES = 1 << 20
SPLIT_BYTES = 64 << 20


def line_source() -> type:
    """The data source class. It is made in here, so that it is pickled by value and needs nothing on a worker."""
    import json

    from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

    PIECE, BATCH_ROWS, BATCH_BYTES = 1 << 20, 4096, 8 << 20

    class Range(InputPartition):
        """Bytes ``start`` to ``end`` of a file; ``fresh``: a line begins at ``start`` whatever stands before it."""

        def __init__(self, path: str, start: int, end: int, fresh: bool = False):
            self.path, self.start, self.end, self.fresh = path, start, end, fresh

    def opened(path: str):
        from pyarrow import fs

        where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        return where.open_input_file(name)

    def files(path: str) -> dict[str, int]:
        """Sizes of the files that ``path``, a file, a folder or a pattern, names."""
        import fnmatch

        from pyarrow import fs

        where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        scheme = path[: len(path) - len(name)] if "://" in path else ""
        shown = lambda f: not any(x[:1] in ("_", ".") for x in f.path[len(base) :].split("/"))
        one, base = where.get_file_info(name), name
        if one.type == fs.FileType.File:
            return {path: one.size}
        if one.type == fs.FileType.Directory:
            found = where.get_file_info(fs.FileSelector(name, recursive=True))
        else:
            base = name[: min([i for i in (name.find(c) for c in "*?[") if i >= 0], default=len(name))].rpartition("/")[0]
            found = [f for f in where.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if fnmatch.fnmatchcase(f.path, name) and f.path.count("/") == name.count("/")]
        return {scheme + f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and shown(f)}

    def after_newline(f, at: int, size: int) -> int:
        """The place behind the first newline at ``at`` or later; the end of the file if there is none."""
        f.seek(at)
        while at < size:
            piece = f.read(PIECE)
            found = piece.find(b"\n")
            if found >= 0:
                return at + found + 1
            if not piece:
                break
            at += len(piece)
        return size

    def last_newline(f, low: int, size: int) -> int:
        """The place behind the last newline before ``size``; ``low`` if there is none after it."""
        at = size
        while at > low:
            start = max(low, at - PIECE)
            f.seek(start)
            found = f.read(at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
        return low

    def physical(f, start: int, end: int, most: int):
        """(line without its newline or None, whether it is too large, its end) of the lines that begin before ``end``."""
        f.seek(start)
        held, dropped = b"", 0
        while start < end:
            piece, i = f.read(PIECE), 0
            if not piece:
                if held or dropped:
                    yield (None, True, start + dropped + len(held)) if dropped else (held, False, start + len(held))
                return
            while True:
                j = piece.find(b"\n", i)
                if j < 0:
                    rest = piece[i:]
                    if dropped or len(held) + len(rest) > most:
                        held, dropped = b"", dropped + len(held) + len(rest)
                    else:
                        held += rest
                    break
                size = dropped + len(held) + j - i
                large = dropped > 0 or size > most
                start += size + 1
                yield (None if large else held + piece[i:j]), large, start
                held, dropped, i = b"", 0, j + 1
                if start >= end:
                    return

    def batches(part: Range, most: int):
        import pyarrow as pa

        def made(rows: list[tuple]):
            n = len(rows)
            columns = [pa.array([part.path] * n, pa.string()), pa.array([part.start] * n, pa.int64()), *[pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.bool_()))]]
            return pa.RecordBatch.from_arrays(columns, names=["path", "range_start", "line_in_range", "byte_offset_end", "raw_line", "too_large"])

        with opened(part.path) as f:
            at = part.start if part.fresh or not part.start else after_newline(f, part.start - 1, f.size())
            rows, held = [], 0
            for n, (line, large, end) in enumerate(physical(f, at, min(part.end, f.size()), most), start=1):
                rows.append((n, end, line, large))
                held += len(line or b"")
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    def counted(part: Range):
        """One row: how many lines begin in the range, which is how many newlines come right before one of its bytes."""
        import pyarrow as pa

        n, at = int(part.start == 0), max(0, part.start - 1)
        with opened(part.path) as f:
            f.seek(at)
            while at < part.end - 1:
                piece = f.read(min(PIECE, part.end - 1 - at))
                if not piece:
                    break
                n, at = n + piece.count(b"\n"), at + len(piece)
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part.path, part.start, n, None, None, None), types, strict=True)], names=["path", "range_start", "line_in_range", "byte_offset_end", "raw_line", "too_large"])

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.path, self.split = options["path"], int(options.get("split_bytes", 64 << 20))
            self.most, self.count = int(options.get("max_line_bytes", 1 << 20)), options.get("count_only", "false") == "true"

        def partitions(self):
            out = [Range(p, at, min(size, at + self.split)) for p, size in files(self.path).items() for at in range(0, size, self.split)]
            return out or [Range("", 0, 0)]

        def read(self, partition):
            if partition.path:
                yield from [counted(partition)] if self.count else batches(partition, self.most)

    class Stream(DataSourceStreamReader):
        """Micro-batches of growing files, of each about ``batch_bytes`` from where the stream stands, up to the end of a line.
        A last line without a newline is taken when the file has not grown since the look before. Where the stream stands
        when it is started comes from the option ``stands``; without it, it takes all that is there at first, as Spark
        tells it only then. Either way tasks share a batch by ranges."""

        def __init__(self, options):
            self.path, self.split = options["path"], int(options.get("split_bytes", 64 << 20))
            self.most, self.size = int(options.get("max_line_bytes", 1 << 20)), int(options.get("batch_bytes", 256 << 20))
            self.at, self.sizes = json.loads(options["stands"]) if "stands" in options else None, {}

        def initialOffset(self):
            return {"files": {}}

        def latestOffset(self):
            stops = dict(self.at or {})
            for path, size in files(self.path).items():
                at = 0 if self.at is None else self.at.get(path, 0)
                if size <= at:
                    continue
                stop = size if self.at is None else min(size, at + self.size)
                with opened(path) as f:
                    if stop < size:
                        stop = after_newline(f, stop - 1, size)
                    if stop == size and self.sizes.get(path) != size:
                        stop = last_newline(f, at, size)
                self.sizes[path] = size
                if stop > at:
                    stops[path] = stop
            self.at = stops
            return {"files": stops}

        def partitions(self, start, end):
            began, stops = start["files"], end["files"]
            self.at = {**(self.at or {}), **{p: max(stop, (self.at or {}).get(p, 0)) for p, stop in stops.items()}}
            out = [Range(p, at, min(stop, at + self.split), at == began.get(p, 0)) for p, stop in stops.items() for at in range(began.get(p, 0), stop, self.split)]
            return out or [Range("", 0, 0)]

        def read(self, partition):
            if partition.path:
                yield from batches(partition, self.most)

        def commit(self, end):
            pass

    class PhysicalLines(DataSource):
        @classmethod
        def name(cls):
            return "physical_lines"

        def schema(self):
            return "path string, range_start bigint, line_in_range bigint, byte_offset_end bigint, raw_line binary, too_large boolean"

        def reader(self, schema):
            return Reader(self.options)

        def streamReader(self, schema):
            return Stream(self.options)

    return PhysicalLines


def register(spark: SparkSession) -> None:
    spark.dataSource.register(line_source())


def numbered(lines: DataFrame, counts: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """``lines`` with their ``line_number`` in the file: the lines of the ranges before (``counts(path, range_start, n)``,
    a row a range), and of what was read before (``base(path, lines)``)."""
    back = Window.partitionBy("path").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("path", "range_start", F.coalesce(F.sum("n").over(back), F.lit(0)).alias("before"))
    if base is not None:
        counts = counts.join(base, "path", "left").select("path", "range_start", (F.col("before") + F.coalesce("lines", F.lit(0))).alias("before"))
    j = lines.join(counts, ["path", "range_start"])
    return j.select("path", (F.col("before") + F.col("line_in_range")).alias("line_number"), "byte_offset_end", "raw_line", "too_large")


def read_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, max_line_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """``(path, line_number, byte_offset_end, raw_line, too_large)`` of all files below ``path`` (a file, a folder or a
    pattern; a URI of any file system that Arrow knows, else a path that all executors mount)."""
    register(spark)
    load = lambda count: spark.read.format("physical_lines").option("split_bytes", split_bytes).option("max_line_bytes", max_line_bytes).option("count_only", count).load(path)
    return numbered(load("false"), load("true").select("path", "range_start", F.col("line_in_range").alias("n")))


def stream_lines(spark: SparkSession, path: str, batch_bytes: int = 256 << 20, split_bytes: int = SPLIT_BYTES, max_line_bytes: int = MAX_LINE_BYTES, stands: dict[str, int] | None = None) -> DataFrame:
    """The lines of growing files as a stream, as ``SCHEMA``: with their numbers in the byte range that a task read. Files
    that come later are read from their beginning. ``stands``: how far each file was read when the stream is started."""
    register(spark)
    return spark.readStream.option("stands", json.dumps(stands or {})).format("physical_lines").option("batch_bytes", batch_bytes).option("split_bytes", split_bytes).option("max_line_bytes", max_line_bytes).load(path)


def judged_line() -> Column:
    """What the line contract judges: the line, or for one that is too large a text that no format takes for a record."""
    return F.when(F.col("too_large"), F.lit(b"too large")).otherwise(F.col("raw_line"))


def prefix_chains(lines: DataFrame, file_col: str, order_col: str, line_col: str) -> DataFrame:
    """``(file, lines, chain)``: the chained digest of every file's lines, ``chain = sha256(chain + sha256(line))`` in
    hex, from the empty string on. The chain is sequential, so a file is one task's; its lines are streamed in order,
    as 32-byte digests that were made before the shuffle."""
    import hashlib

    import pyarrow as pa

    def run(batches):
        name, n, chain, out = None, 0, "", []
        for batch in batches:
            for file, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != name or n == 0:
                    if n:
                        out.append((name, n, chain))
                    name, n, chain = file, 0, ""
                n, chain = n + 1, hashlib.sha256((chain + digest).encode()).hexdigest()
        if n:
            out.append((name, n, chain))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=[file_col, "lines", "chain"])

    src = lines.select(F.col(file_col).cast("string").alias("f"), F.sha2(F.coalesce(F.col(line_col), F.lit(b"")), 256).alias("h"), F.col(order_col).alias("o"))
    return src.repartition("f").sortWithinPartitions("f", "o").select("f", "h").mapInArrow(run, f"`{file_col}` string, lines bigint, chain string")
