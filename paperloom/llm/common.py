"""What the operators of this subpackage share: reading, written intermediates, text columns."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: What a batch of rows for a Python function holds at most; a single longer row is a batch of its own.
BATCH_BYTES, BATCH_CONF = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
DEFAULT_BATCH = "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. Batches for Python functions are bounded unless the session says otherwise."""
    if spark.conf.get(BATCH_CONF, DEFAULT_BATCH) == DEFAULT_BATCH:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share; a temporary one where it is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again: all that was made of them is written itself."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)  # whatever store Spark wrote it to


def filesystem(path: str):
    """For tasks that read or write a folder by themselves: its file system and its name there. Hadoop's names of S3 are known too."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path) if re.match(r"\w+:", path) else f"file://{path}")


def files_of(path: str, hidden: bool = False):
    """The file system of a folder and the names of its files, ``hidden`` ones only if asked for; none where there is no folder."""
    from pyarrow import fs

    system, root = filesystem(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return system, sorted(f.path for f in found if f.is_file and (hidden or not f.base_name.startswith(("_", "."))))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
