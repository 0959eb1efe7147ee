"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("noticegrid")
    builder = builder.config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in LOCAL_SETTINGS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    return session


def _has_checkpoint_dir(spark: SparkSession) -> bool:
    return spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used where it is set. Only a local
    master without that setting gets a folder of its own; a cluster without one is an
    error, because a machine-local folder would be lost with its executor.
    """
    spark = df.sparkSession
    if not _has_checkpoint_dir(spark):
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="noticegrid-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, for stream state and results."""
    import uuid

    if not _has_checkpoint_dir(spark):
        cut_lineage(spark.range(1))
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base}/{name}-{uuid.uuid4().hex}"


def next_round(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for the state of a loop, through files in the shared folder.

    A checkpointed table keeps the size that was estimated for it, and a join multiplies the sizes of its sides. In a
    loop that joins its state to itself the digits of that number double with every round, and planning soon
    takes longer than the work. Files are as large as they are.
    """
    folder = scratch_folder(df.sparkSession, "round")
    df.write.option("compression", "zstd").parquet(folder)
    made = df.sparkSession.read.schema(df.schema).parquet(folder)
    release(df.sparkSession)
    return made


def release(spark: SparkSession) -> None:
    """Let go of shuffles and checkpoints that no table names any more.

    Their files are removed once the driver has collected the tables that made them; a driver with room to spare
    does that so late that a query keeps the shuffles of all of its steps.
    """
    gc.collect()
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that ``next_round`` made, once what was made of them is itself in files."""
    for df in tables:
        spark = df.sparkSession
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
        path = spark._jvm.org.apache.hadoop.fs.Path
        files = df.inputFiles()
        folder = path(spark._jvm.java.net.URI(files[0])).getParent() if files else None
        if folder is None or not folder.getName().startswith("round-") or folder.getParent().toUri().getPath() != path(base).toUri().getPath():
            raise ValueError("only what next_round made can be discarded")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def keyed(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: both sides go by key, and neither to the driver.

    A checkpointed table carries the size that was estimated for it before it was made, which says nothing about
    rows that Python or a join gave, and a compressed file is taken for as small as it is on disk. By these numbers
    the engine would collect hundreds of megabytes for a broadcast. Skewed keys are still split.
    """
    return df.hint("merge")


def evaluated(df: DataFrame) -> DataFrame:
    """The same rows, each column worked out once.

    A filter on a column is otherwise moved below the projection that makes it and works it out again, in
    copies for every place it is named in; rows that a generator gave stay as they are.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for per-row heavy work on an input that arrives in few splits.

    A large input has more splits than the cluster has cores and is returned as it is, so
    no shuffle is added there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


#: Bytes of a file that one task reads where rows get much work each: compressed files hold many of them.
SPLIT_BYTES = 16 << 20


def small_splits(spark: SparkSession) -> None:
    """Bound what a task reads of files, unless the session asks for less already."""
    key = "spark.sql.files.maxPartitionBytes"
    units = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    now = str(spark.conf.get(key)).strip().lower()
    number = now.rstrip("bkmg")
    if not number.isdigit() or now[len(number):] not in units or int(number) * units[now[len(number):]] > SPLIT_BYTES:
        spark.conf.set(key, str(SPLIT_BYTES))


_SHIPPED: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Where the package is installed on the executors or passed with ``--py-files`` this only
    repeats what is there.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="noticegrid-package-")
    archive = shutil.make_archive(f"{folder}/noticegrid", "zip", root, "noticegrid")
    context.addPyFile(archive)
    _SHIPPED[context.applicationId] = archive
