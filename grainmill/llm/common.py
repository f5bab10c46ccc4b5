"""What the operators share: the shared folder, written tables and batches of bounded bytes."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions.batches import chunks, trimmed, utf8  # noqa: F401


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named in spark.checkpoint.dir.

    Where it is unset, a temporary folder serves in local mode; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="grainmill-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def bounded(spark: SparkSession, rows: int = 1000) -> None:
    """Send Python workers batches of at most so many rows; the default of 10,000 long texts takes tens of MB several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(min(rows, int(spark.conf.get(key)))))


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and safe from lost executors."""
    path = new_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables that written() made and nothing needs any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for df in frames:
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, as its own collector does from time to time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def open_fs(uri: str):
    """(file system, path) of a URI, for binary files that executors write and range-read."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def publish(fs, temporary: str, final: str) -> None:
    """Put a finished file in place; a second attempt of the same task writes the same bytes."""
    from pyarrow.fs import FileType

    if fs.get_file_info(final).type != FileType.NotFound and fs.type_name != "local":
        fs.delete_file(final)
    fs.move(temporary, final)


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """2**bits bits, with those of a 64-bit column's low bits set. The driver gets at most 2**bits / 8 rows of 8 bytes, whatever the input."""
    slots = df.select(F.expr(f"pmod({column}, {1 << bits})").cast("int").alias("slot"))
    table = slots.groupBy(F.shiftright("slot", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, slot % 8)")).alias("value")).toArrow()
    marks = np.zeros((1 << bits) // 8, np.uint8)
    marks[table.column("byte").to_numpy()] = table.column("value").to_numpy()
    return marks


def marked(marks: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which 64-bit values a bitmap has; it may have others too, but misses none."""
    slot = values.view(np.uint64) & np.uint64(len(marks) * 8 - 1)
    return (marks[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1) > 0
