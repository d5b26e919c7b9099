"""Session settings the library relies on, and the shared folder for scratch data."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED, _SCRATCH = "_threadhaul_shipped", "_threadhaul_scratch"

_RUNTIME = {
    # Every timestamp is UTC.
    "spark.sql.session.timeZone": "UTC",
    # Roster objects may repeat a name in another case: the last one counts.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Lets the paged source see the predicates on its window and mailboxes.
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators need (all are session-level)."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this library, wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='threadhaul-')}/{package.name}",
        "zip",
        root_dir=package.parent,
        base_dir=package.name,
    )
    sc.addPyFile(archive)
    setattr(sc, _SHIPPED, True)


def local_session(app: str = "threadhaul", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Noting the call site of every column makes large expressions slow to build.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: `spark.checkpoint.dir` of the session.

    A folder of our own is made only where none is configured and the session
    runs on one machine, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if folder is None:
        folder = sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="threadhaul-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    made = getattr(spark.sparkContext, _SCRATCH, None)
    if made is None:
        made = []
        setattr(spark.sparkContext, _SCRATCH, made)
    made.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Remove every scratch folder that this session has made and not removed; how many it had.

    Results that have not been written or collected yet read from such folders.
    """
    made = getattr(spark.sparkContext, _SCRATCH, [])
    paths, made[:] = list(made), []
    for path in paths:
        drop_folder(spark, path)
    return len(paths)


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder and what is in it; one that is not there is no error."""
    files, folder = _file_system(spark, path)
    files.delete(folder, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a path whose writing has finished (Spark marks them)."""
    files, folder = _file_system(spark, path)
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory()]
    return [n for n in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write `df` to a Parquet folder and read it back, its schema being known.

    Cuts the lineage, and tells the planner the true size of what follows.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
