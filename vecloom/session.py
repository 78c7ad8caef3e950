"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings the results depend on or that every job wants.  Sizes (shuffle partitions, memory) belong to
# the cluster and are left to it.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("vecloom")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that is unset, and only on one machine (tests), is a fresh folder made here.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="vecloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; never one used before."""
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, columnar, of known size, free of its lineage.

    For results that several jobs read, or that must not change when a lost task runs again.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go when it is written, not when the driver comes to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def packed(df: DataFrame, label: str, by: str) -> tuple[str, DataFrame]:
    """Like ``written``, for whole rows of points, in a folder for each value of ``by``: takes less disk, and leaves no shuffle files."""
    path = scratch_path(df.sparkSession, label)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").partitionBy(by).parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables, each in one folder, that nothing reads any more: neither a later step nor a step that may run again."""
    for one in tables:
        files = one.inputFiles()
        if files:
            jvm = one.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0])).getParent()
            folder.getFileSystem(one.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def input_bytes(df: DataFrame) -> int:
    """Size of all files that ``df`` reads, as they are stored; 0 if it reads none."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    path_of, uri_of = jvm.org.apache.hadoop.fs.Path, jvm.java.net.URI
    paths = [path_of(uri_of(file)) for file in set(df.inputFiles())]
    return sum(path.getFileSystem(conf).getFileStatus(path).getLen() for path in paths)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    # Spark copies the file to the executors itself, so a driver-local file is enough.
    archive = Path(tempfile.mkdtemp(prefix="vecloom-ship-")) / "vecloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
