"""Helpers that the operators of this subpackage share: written tables between steps, word splitting."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the byte-level contracts: a run of bytes that are neither space nor \x09-\x0D.
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
#: The same over text. Not ``str.split()``, which also cuts at other Unicode spaces.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a folder of its own; a cluster gets an error, as its executors
    would write to their own disks.
    """
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="weftwork-"))
        found = context.getCheckpointDir()
    return found


def stored(df: DataFrame, name: str = "step", codec: str = "snappy") -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` that no later step reads."""
    path = getattr(df, "_weft_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def swept(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps, which it does once the driver has collected its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """Partitions for steps that are dealt out by an explicit key: the session's own figure."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def trimmed() -> None:
    """Give this Python process's unused memory back to the system."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def released(run):
    """``run`` for mapInArrow, after which the Python worker, which Spark keeps for later tasks, gives its memory back."""

    def whole(batches):
        yield from run(batches)
        trimmed()

    return whole


def spread(df: DataFrame, *cols: str) -> DataFrame:
    return df.repartition(parallelism(df.sparkSession), *[F.col(c) for c in cols])
