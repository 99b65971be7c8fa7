"""Session-level plumbing: shipping the package, cutting lineage, reading tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_TEMP: dict[str, str] = {}
_SHIPPED: set[str] = set()
_CUT: dict[int, tuple] = {}  # tables that are still referred to, by identity: (reference, path)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application.

    Arrow UDFs are pickled by reference, so Python workers must be able to import the package even where
    only the driver has it on its path.
    """
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="gridloom-ship-")) / "gridloom_pkg.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        spark.sparkContext.addPyFile(str(target))
        atexit.register(shutil.rmtree, target.parent, ignore_errors=True)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor can reach.

    It is ``spark.checkpoint.dir`` of the session, or the folder that ``setCheckpointDir`` was called with. Only where
    neither is set (tests, a laptop) a folder of our own is made: on a local master in the temporary directory, else
    beside the warehouse.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_TEMP:
        if spark.sparkContext.master.startswith("local"):
            _OWN_TEMP[app] = made = tempfile.mkdtemp(prefix="gridloom-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
        else:
            _OWN_TEMP[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_gridloom_intermediate"
    return _OWN_TEMP[app]


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system that Spark resolves it on, as a URI that Arrow reads too."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file:///") else full


def put_in_place(fs, part: str, name: str) -> None:
    """Rename a file that was written completely, on an Arrow file system. An attempt of the same task that was lost may have
    left the same file; not every file system renames over one."""
    try:
        fs.move(part, name)
    except OSError:
        fs.delete_file(name)
        fs.move(part, name)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gridloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here, and an executor that is
    lost later costs nothing, since every executor can read the files."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _CUT[id(out)] = (weakref.ref(out, lambda _, key=id(out): _CUT.pop(key, None)), path)
    return out


def release(*tables: DataFrame | None) -> None:
    """Remove the files of tables that :func:`cut` made and that nothing will be read from again."""
    for t in tables:
        path = _CUT.pop(id(t), (None, None))[1] if t is not None else None
        if path:
            drop_path(t.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application, once its results have been read or written elsewhere."""
    drop_path(spark, f"{shared_dir(spark)}/gridloom/{spark.sparkContext.applicationId}")
    _CUT.clear()


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def stamp(spark: SparkSession, path: str) -> str:
    """Time of the last change and length of a file or folder: another one when it was written again."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{fs.getFileStatus(p).getModificationTime()}-{fs.getContentSummary(p).getLength()}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def pick(df: DataFrame, *names: str, optional: tuple[str, ...] = ()) -> DataFrame:
    """Only the columns ``names`` (and those of ``optional`` that there are), found by their exact spelling first.

    Other columns may have any names, even equal ones or such that differ in letter case only.
    """
    columns = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(columns))])
    chosen = []
    for n in (*names, *optional):
        at = [i for i, c in enumerate(columns) if c == n] or [i for i, c in enumerate(columns) if c.lower() == n.lower()]
        if at:
            chosen.append(F.col(f"_c{at[0]}").alias(n))
        elif n in names:
            raise ValueError(f"there is no column {n!r}")
    return plain.select(*chosen)
