"""Documents and the registry from files, files from rows, and tables that are written once.

Defined results: files of no bytes are not seen, as by Spark's readers; a null content is an empty file; of rows with one path any one stays;
empty tables write no files.
"""

from __future__ import annotations

import functools
import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.registry import from_files

OPENING, LISTED = 64 << 10, "path string, length long"


def shared(spark: SparkSession) -> str:
    """A folder that driver and executors see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or "file://" + tempfile.mkdtemp(prefix="spark-shared-")


@functools.cache
def _opened(store: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(store)


def _stored(path: str) -> tuple:
    """pyarrow's file system of a path as Hadoop writes it (nothing is escaped), and the path's name there."""
    scheme, host = re.match("([^/:]+):((?://[^/]*)?)", path).groups()
    system, top = _opened(f"{re.sub('^s3[an]$', 's3', scheme)}:{host or '//'}/")
    return system, top.rstrip("/") + path[len(f"{scheme}:{host}") :]


def _roots(spark: SparkSession, path: str) -> list[str] | None:
    """What ``path``, which may be a pattern, stands for, by Hadoop. None where pyarrow does not see it too."""
    from pyarrow import fs

    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    roots = [f.getPath().toString() for f in place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or ()]
    if not roots:
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {path}.")
    try:
        system, name = _stored(roots[0])
        return None if system.get_file_info(name).type == fs.FileType.NotFound else roots
    except (pa.ArrowException, OSError):
        return None


def _listed(spark: SparkSession, roots: list[str], folder: str) -> DataFrame:
    """The files below ``roots`` (path, length), those that Spark's readers see: at any depth, not hidden, not of no bytes. Tasks list
    the folders of one depth, then those of the next, and write what they find below ``folder``, so the driver has only their number.
    A single folder is listed by one task, at about 200 bytes of memory a file."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def below(path: str) -> Iterator[tuple[str, int | None]]:
            system, name = _stored(path)
            whole = system.get_file_info(name)
            for f in [whole] if whole.is_file else system.get_file_info(fs.FileSelector(name)):
                hidden = f.base_name.startswith(".") or f.base_name.startswith("_") and "=" not in f.base_name or f.base_name.endswith("._COPYING_")
                at = path if f is whole else f"{path.rstrip('/')}/{f.base_name}"
                if f.type == fs.FileType.Directory:
                    if not hidden or f.base_name.startswith(("_metadata", "_common_metadata")):
                        yield at, None
                elif f.size and not hidden:
                    yield at, f.size

        rows = (row for batch in batches for path in batch.column(0).to_pylist() for row in below(path))
        while some := list(itertools.islice(rows, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.string(), pa.int64()), strict=True)], ["path", "length"])

    todo, n, depths = spark.createDataFrame([(r,) for r in roots], "path string"), len(roots), []
    while n:
        depths.append(f"{folder}/{len(depths)}")
        todo.repartition(min(n, 32 + n // 16, 10_000)).mapInArrow(found, LISTED).write.parquet(depths[-1])
        todo = spark.read.schema(LISTED).parquet(depths[-1]).where("length IS NULL").select("path")  # folders
        n = todo.count()
    files = spark.read.schema(LISTED).parquet(*depths).where("length IS NOT NULL")
    return files if len(roots) == 1 else files.distinct()  # one root may lie in another


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files with their bytes, a few MB in a batch or one file."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["path", "n_bytes", "content"])

    rows, size = [], 0
    for path, length in (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
        system, name = _stored(path)
        with system.open_input_stream(name, compression=None) as file:
            content = file.read(length + 1)
        if len(content) != length:
            raise OSError(f"{path} has changed since it was listed")
        rows.append((path, length, content))
        size += length
        if size >= 8 << 20 or len(rows) == 10_000:
            yield batch(rows)
            rows, size = [], 0
    if rows:
        yield batch(rows)


def read_documents(spark: SparkSession, path: str, max_bytes: int = 50 << 20) -> tuple[DataFrame, DataFrame]:
    """Files up to the limit (path, n_bytes, content) and what is larger (path, max_bytes, actual_bytes), at any depth. The limit is
    applied to the files' listed lengths, so large files are not read. Opening a file counts as 64 KB, not as Spark's 4 MB, so that a
    task has hundreds of small files, not 32. Spark's reader has the list of all files in the driver's memory; here it is a table that
    tasks make in a shared folder. A file that has another length by the time it is read is an error. What pyarrow cannot open is left
    to Spark's reader, and to the driver's memory."""
    if roots := _roots(spark, path):
        files = _listed(spark, roots, f"{shared(spark)}/listed-{uuid.uuid4().hex}")
        kept = files.where(F.col("length") <= max_bytes)
        n, size = kept.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        cost, most = size + n * OPENING, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        a_task = min(most, max(OPENING, -(-cost // spark.sparkContext.defaultParallelism)))  # as Spark deals out files
        kept = kept.repartition(max(1, -(-cost // a_task))).mapInArrow(_contents, "path string, n_bytes long, content binary")
    else:
        session = spark.newSession()  # the cost is this reader's choice alone
        session.conf.set("spark.sql.files.openCostInBytes", OPENING)
        files = session.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        kept = files.where(F.col("length") <= max_bytes).select("path", F.col("length").alias("n_bytes"), "content")
    refused = files.where(F.col("length") > max_bytes).select("path", F.lit(max_bytes).alias("max_bytes"), F.col("length").alias("actual_bytes"))
    return kept, refused


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a job has ended that wrote ``path``: the driver looks for its mark."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def keeper(spark: SparkSession, base: str) -> Callable[[DataFrame, str], DataFrame]:
    """A function that writes a table below ``base`` under a name and reads it back. What a job has already written in full is only
    read, so a run that failed goes on where it stopped; what it left half done is replaced."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = f"{base.rstrip('/')}/{name}"
        if not _complete(spark, path):
            df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


def below(folder: str) -> Column:
    """The ``path`` of a file relative to ``folder``, which may or may not name its file system."""
    root = re.sub("^[a-z0-9]+:/+", "/", f"{folder.rstrip('/')}/")  # Spark writes file:/ for file:///
    return F.substring("path", F.instr("path", F.lit(root)) + F.lit(len(root)), F.length("path"))


def read_registry(spark: SparkSession, folder: str) -> DataFrame:
    """The registry table of the .yaml and .yml files below ``folder``, at any depth. They are read whole and must be JSON, which is
    YAML too. A folder that is not there is an error, one without files gives no rows. Spark's readers pass over files
    of no bytes, so those have no row."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{yaml,yml}").load(folder)
    return from_files(found.select(below(folder).alias("path"), F.col("content").cast("string").alias("text")))


def write_files(rows: DataFrame, folder: str) -> None:
    """A file below ``folder`` for each row of ``path`` (relative) and ``content`` (text or bytes; null is empty). Tasks write them; a task that runs again writes
    the same files again. Of rows with one path any one stays."""
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))
        made = None
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                below = f"{root}/{path}".rpartition("/")[0]
                if below != made:
                    system.create_dir(below, recursive=True)
                    made = below
                with system.open_output_stream(f"{root}/{path}", compression=None) as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], ["n"])

    rows.select("path", F.col("content").cast("binary")).mapInArrow(put, "n long").agg(F.sum("n")).collect()  # one number
