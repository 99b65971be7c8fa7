"""Finding, attesting and publishing files, on any file system that Spark and Arrow both know."""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.measures import set_digest
from gridloom.runtime import new_path, put_in_place, qualified

# The extensions that are read, and those of pictures that are not.
SUPPORTED = (".jpg", ".jpeg")
IMAGE_LIKE = (".avif", ".bmp", ".gif", ".heic", ".heif", ".png", ".tif", ".tiff", ".webp")
UNSUPPORTED, UNREADABLE, ESCAPE = "IMAGE_SOURCE_FORMAT_UNSUPPORTED", "IMAGE_SOURCE_UNREADABLE", "IMAGE_SOURCE_PATH_ESCAPE"


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the frame header of a JPEG file; None for anything else."""
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = int.from_bytes(data[at + 5 : at + 7], "big"), int.from_bytes(data[at + 7 : at + 9], "big")
            return (width, height) if width and height and at + 9 <= len(data) else None
        if size < 2 or kind in (0xD9, 0xDA):
            return None
        at += 2 + size
    return None


def write_files(files: DataFrame, folder: str, path_col: str = "path", content_col: str = "content") -> None:
    """Write every (path, content) below ``folder``; tasks write their rows, each under another name and renamed."""
    root = qualified(files.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = f"{base}/{path}"
                where.create_dir(posixpath.dirname(name), recursive=True)
                with where.open_output_stream(name + ".part") as f:
                    f.write(data or b"")
                put_in_place(where, name + ".part", name)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    files.select(path_col, content_col).mapInArrow(run, "n bigint").write.format("noop").mode("overwrite").save()


def empty_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path)`` of the files without content below ``root``, which Spark's own scans pass over. The folders of the first
    level are walked by a task each."""
    from pyarrow import fs

    where, top = fs.FileSystem.from_uri(root)
    first = [f for f in where.get_file_info(fs.FileSelector(top, allow_not_found=True)) if not f.base_name.startswith((".", "_"))]
    folders = [(f.path,) for f in first if f.type == fs.FileType.Directory]
    found = [(f.base_name,) for f in first if f.type == fs.FileType.File and f.size == 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, top = fs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                names = [f.path[len(top) + 1 :] for f in where.get_file_info(fs.FileSelector(folder, recursive=True)) if f.type == fs.FileType.File and f.size == 0]
                yield pa.RecordBatch.from_arrays([pa.array([n for n in names if not any(x[:1] in "._" for x in n.split("/"))], pa.string())], names=["path"])

    walked = spark.createDataFrame(folders, "path string").repartition(max(1, min(len(folders), spark.sparkContext.defaultParallelism))).mapInArrow(run, "path string")
    return walked.unionByName(spark.createDataFrame(found, "path string"))


def discover_images(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, issues, ignored) of all files below ``folder``.

    ``images(sha256, width, height, files)``: a row for each content, its files in the order of their names without regard
    to letter case; ``issues(path, code)``: pictures of other kinds and files that are no readable picture;
    ``ignored(n)``: how many files have none of these extensions. Names of files only are looked at for those: the
    scan reads contents of supported files alone.
    """
    root = qualified(spark, folder).rstrip("/")
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), "^\\Q" + "/" + root.split("://", 1)[-1].lstrip("/") + "\\E/", "")
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    supported = extension.isin(*SUPPORTED)
    empty = empty_files(spark, root)
    heads = scan.select(path.alias("path"), extension.alias("extension")).unionByName(empty.select("path", extension.alias("extension")))
    ignored = heads.agg(F.count_if(~F.col("extension").isin(*SUPPORTED, *IMAGE_LIKE)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [jpeg_size(x or b"") or (None, None) for x in batch.column(1).to_pylist()]
            digests = [hashlib.sha256(x or b"").hexdigest() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests), pa.array([s[0] for s in sizes], pa.int32()), pa.array([s[1] for s in sizes], pa.int32())], names=["path", "sha256", "width", "height"])

    read = scan.where(supported).select(path.alias("path"), "content").mapInArrow(run, "path string, sha256 string, width int, height int")
    files = F.transform(F.array_sort(F.collect_list(F.struct(F.lower("path").alias("k"), "path"))), lambda x: x["path"])
    images = read.where("width is not null").groupBy("sha256").agg(F.first("width").alias("width"), F.first("height").alias("height"), files.alias("files"))
    issues = heads.where(F.col("extension").isin(*IMAGE_LIKE)).select("path", F.lit(UNSUPPORTED).alias("code"))
    broken = read.where("width is null").select("path").unionByName(empty.where(supported))
    issues = issues.unionByName(broken.select("path", F.lit(UNREADABLE).alias("code")))
    return images, issues, ignored


def attest_files(files: DataFrame, root: str, max_bytes: int, formats: tuple[str, ...] = ("csv", "jsonl")) -> DataFrame:
    """``(path, file_format, size_bytes, sha256, code)`` of the relative paths ``files(path)`` below ``root``.

    ``code`` says why a file is refused: a path that is absolute or leads out of the root, another format, no such file,
    nothing in it, more than ``max_bytes``, or a size or time that is another after reading than before. Files are read in
    pieces by the tasks and nothing of them is kept. Null paths are refused; repeated paths come out as often as they come in.
    """
    base = qualified(files.sparkSession, root).rstrip("/")

    def judge(where, top: str, path: str | None) -> tuple:
        from pyarrow import fs

        parts = [] if path is None else path.split("/")
        if not path or path.startswith("/") or "\\" in path or "\0" in path or any(x in ("", ".", "..") for x in parts):
            return None, None, None, "IMPORT_SOURCE_PATH_INVALID"
        kind = path.rpartition(".")[2].lower()
        if kind not in formats or "." not in parts[-1]:
            return None, None, None, "IMPORT_SOURCE_FORMAT_UNSUPPORTED"
        before = where.get_file_info(f"{top}/{path}")
        if before.type != fs.FileType.File:
            return kind, None, None, "IMPORT_SOURCE_NOT_FOUND"
        if not before.size:
            return kind, before.size, None, "IMPORT_SOURCE_EMPTY"
        if before.size > max_bytes:
            return kind, before.size, None, "IMPORT_SOURCE_TOO_LARGE"
        digest, seen = hashlib.sha256(), 0
        with where.open_input_stream(f"{top}/{path}") as f:
            while piece := f.read(1 << 20):
                digest.update(piece)
                seen += len(piece)
        after = where.get_file_info(f"{top}/{path}")
        if (after.size, after.mtime) != (before.size, before.mtime) or seen != before.size:
            return kind, after.size, None, "IMPORT_SOURCE_CHANGED"
        return kind, before.size, digest.hexdigest(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, top = fs.FileSystem.from_uri(base)
        for batch in batches:
            rows = [judge(where, top, path) for path in batch.column(0).to_pylist()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["path", "file_format", "size_bytes", "sha256", "code"])

    return files.select(F.col("path").cast("string")).mapInArrow(run, "path string, file_format string, size_bytes bigint, sha256 string, code string")


def curated_name(start: Column, end: Column, sha256: Column) -> Column:
    """The name of a published picture: its range and the first 12 digits of its digest."""
    number = lambda n: F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(6)), F.lit("0"))
    return F.concat(F.lit("seq_"), number(start), F.lit("-"), number(end), F.lit("__"), F.substring(sha256, 1, 12), F.lit(".jpg"))


def publish_curated(selected: DataFrame, folder: str) -> str:
    """Publish the pictures ``selected(range_start, range_end, content, sha256)``, one a range, and return their folder.

    Tasks copy the contents, compare the digest before and after, and return a manifest row. The folder is named by the
    digest of all manifest rows and appears by one rename, so equal selections are published once, and one that was broken
    off is not there. A range that occurs twice, a digest that differs and an empty selection are errors.
    """
    spark = selected.sparkSession
    root = qualified(spark, folder).rstrip("/")
    pending = qualified(spark, new_path(spark, "curated-pending"))
    named = selected.select("range_start", "range_end", curated_name(F.col("range_start"), F.col("range_end"), F.col("sha256")).alias("name"), "sha256", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, top = fs.FileSystem.from_uri(pending)
        where.create_dir(f"{top}/images", recursive=True)
        for batch in batches:
            sizes = []
            for name, wanted, data in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                path = f"{top}/images/{name}"
                with where.open_output_stream(path) as f:
                    f.write(data or b"")
                with where.open_input_stream(path) as f:
                    if hashlib.sha256(f.read()).hexdigest() != wanted:
                        raise ValueError(f"the content of {name} differs from its digest")
                sizes.append(len(data or b""))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes, pa.int64())], names=["range_start", "range_end", "name", "sha256", "size_bytes"])

    manifest = named.mapInArrow(run, "range_start bigint, range_end bigint, name string, sha256 string, size_bytes bigint")
    manifest.write.parquet(f"{pending}/manifest")
    written = spark.read.parquet(f"{pending}/manifest")
    row = F.concat_ws("|", *[F.col(c).cast("string") for c in ("range_start", "range_end", "name", "sha256", "size_bytes")])
    seen = written.agg(F.count("*").alias("n"), F.count_distinct("range_start", "range_end").alias("ranges"), set_digest(row).alias("digest")).first()
    if not seen["n"] or seen["n"] != seen["ranges"]:
        raise ValueError("there is nothing to publish" if not seen["n"] else "a range occurs more than once")
    jvm = spark.sparkContext._jvm
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (pending, f"{root}/{seen['digest']}"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
        if not fs.exists(target):
            raise OSError(f"{target} could not be made")
    return f"{root}/{seen['digest']}"
