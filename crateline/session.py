"""Session helpers: a local session for tests and bench, and lineage cutting."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "6g", name: str = "crateline") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; only where none is named make one (tests, local runs)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        assert sc.master.startswith("local["), "set spark.checkpoint.dir to a folder that all executors share"
        named = tempfile.mkdtemp(prefix="crateline-checkpoint-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs no recomputation of a loop."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Whether a query's shuffle files go with its end (Spark's setting).
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as :func:`ensure_checkpoint_dir` found or made it."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, free: bool = False, onto: DataFrame | None = None) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage as :func:`cut` does, but packed and read by column.

    The table is removed when the session's JVM ends, or by :func:`removed`. ``free``: remove what was shuffled as soon as it
    is written, not when the driver happens to collect its garbage. ``onto``: a table made here that the rows are added to.
    """
    spark = df.sparkSession
    folder = onto.folder_ if onto is not None else f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, str(free or before == "true").lower())
    try:
        df.write.mode("errorifexists" if onto is None else "append").parquet(folder)
    finally:
        spark.conf.set(FREED, before)
    fs, path = _path(spark, folder)
    fs.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(folder)
    out.folder_ = folder
    return out


def removed(*tables: DataFrame) -> None:
    """Remove tables that :func:`written` made; nothing that is still to run may read them."""
    for t in tables:
        fs, path = _path(t.sparkSession, t.folder_)
        fs.delete(path, True)


def _path(spark: SparkSession, folder: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def spread(df: DataFrame, *keys: str, per_core: int = 2) -> DataFrame:
    """Spread rows over the cores where the scan yields fewer partitions than cores (few, small files).

    A large table has many splits already and is left alone, so this shuffles only small inputs.
    """
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *[F.col(k) for k in keys]) if keys else df.repartition(want)


def splits_for(df: DataFrame, bytes_each: int = 16 << 20, per_core: int = 2) -> int:
    """Partitions for a sort of ``df``: by the size Spark knows of its inputs, and at least ``per_core`` for each core."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(df.sparkSession.sparkContext.defaultParallelism * per_core, min(size // bytes_each, 100_000), 2)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, so that their Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="crateline-code-"), "crateline_code")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
    _shipped.add(sc.applicationId)
