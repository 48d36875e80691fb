"""Session settings and the shared folder for checkpoints and written stages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    A cluster sets ``spark.checkpoint.dir``, and without it this is an error.  On one
    machine (a test) a fresh temporary folder is made and remembered in the session.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def new_stage_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier stage has used."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind: without it they stay on the executors' disks
    until the driver happens to collect its garbage."""
    known = spark.conf.get(CLEANUP_CONF, "false")
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_CONF, known)


def write_stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``write_and_read``, and the path of what was written, for ``drop_stage``."""
    path = new_stage_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder as parquet and read it back."""
    return write_stage(df, name)[0]


def write_bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Write ``df`` dealt into ``buckets`` by ``key`` and sorted by it, as a table of the session's catalog.

    A join or grouping by ``key`` then reads the rows where they lie, without an exchange.
    """
    path = new_stage_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    dealt = df.repartition(buckets, key).write.format("parquet").option("path", path)
    with shuffles_dropped(df.sparkSession):
        dealt.bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; later plans start from it."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def drop_stage(spark: SparkSession, path: str) -> None:
    """Delete a stage that no later plan reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_read(df: DataFrame) -> None:
    """Delete the stages that ``df`` reads, as far as they lie in the shared folder; no later plan may read them."""
    path_of = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    shared = path_of(shared_folder(df.sparkSession)).toUri().getPath().rstrip("/")
    for folder in sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}):
        if path_of(folder).toUri().getPath().startswith(f"{shared}/"):
            drop_stage(df.sparkSession, folder)
