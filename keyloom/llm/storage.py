"""Intermediate tables and files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Where materialized frames lie.
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where the setting is absent, a local session gets a temporary folder; any other
    master raises, as a machine-local folder would not be seen by the executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="keyloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/keyloom/{uuid.uuid4().hex[:12]}-{name}"


#: Options of materialize() for rows of several MB: their sizes are looked at after each row, not
#: after the first hundred, so that neither writer nor reader ever holds more than a few of them.
LARGE_ROWS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df to the shared folder, with options of the writer, and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def keyed(df: DataFrame) -> DataFrame:
    """key, a number for each row, and row, a struct of df's columns, written once."""
    from pyspark.sql import functions as F

    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return materialize(df.select(F.monotonically_increasing_id().alias("key"), row.alias("row")), "keyed")


def adopt(df: DataFrame, source: DataFrame) -> DataFrame:
    """df, a projection of the materialized source, which discard() then takes for it."""
    _written[df] = _written.pop(source)
    return df


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that nothing will read any more; others stay."""
    for df in frames:
        if path := _written.pop(df, None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def sweep(spark: SparkSession, path: str) -> None:
    """Delete the temporary files (names that begin with .part-) that lost tasks left in a folder."""
    glob = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/.part-*")
    system = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in system.globStatus(glob) or []:
        system.delete(found.getPath(), True)


def cleanup(spark: SparkSession) -> None:
    """Delete every intermediate of this shared folder; call when results are saved."""
    remove(spark, f"{shared_root(spark)}/keyloom")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_output(uri: str):
    """(filesystem, path) of a URI, for file access from executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
