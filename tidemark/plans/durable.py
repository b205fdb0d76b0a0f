"""Lineage cuts that survive the loss of an executor, and input spreading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of at most 16 bytes; a broadcast of so many stays under 64 MB on the driver.
BROADCAST_ROWS = 1_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; make one only in local mode, where it is unset."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    context.setCheckpointDir(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's checkpoint folder, which all executors share; it goes when Spark ends."""
    ensure_checkpoint_dir(spark)
    jvm, root = spark._jvm, spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """Repartition only inputs with fewer splits than twice the cores.

    A file of one row group is one task, however many splits it is planned as; large tables have enough files
    and aren't shuffled.
    """
    n = 2 * cores(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes that a task is to read of a shuffle whose number of partitions is set here.
TASK_BYTES = 64 << 20


def parts_for(spark: SparkSession, size: float = 0) -> int:
    """As many partitions as are set, two a core at least, and enough for ``size`` bytes."""
    return max(shuffle_parts(spark), 2 * cores(spark), -(-int(size) // TASK_BYTES))


def grouped(df: DataFrame, key: str, size: float = 0) -> DataFrame:
    """Bring rows of a key together in :func:`parts_for` partitions for ``size`` bytes.

    Groups that take long but are small in bytes would else be coalesced into a few tasks.
    """
    return df.repartition(parts_for(df.sparkSession, size), key)
