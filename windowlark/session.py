"""Session factory and reliable materialisation of intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # vector means run in object hash aggregates; keep them hashed past 128 groups a task
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
}


def get_spark(app: str = "windowlark", master: str | None = None, **conf: str) -> SparkSession:
    """Build or reuse a session. The master is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as named by ``spark.checkpoint.dir``.

    A machine-local folder is made only for a local master, where there is no cluster to share with.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="windowlark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_opened: dict[str, object] = {}


def session_folder(spark: SparkSession) -> str:
    """Own subfolder of this application in the shared folder, deleted when the driver ends or by ``release``."""
    path = f"{work_folder(spark).rstrip('/')}/windowlark/{spark.sparkContext.applicationId}"
    if path not in _opened:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        _opened[path] = (hadoop, spark.sparkContext._jsc.hadoopConfiguration())
    return path


def release() -> None:
    """Delete all that ``materialize`` has written so far; tables read from it are gone too."""
    while _opened:
        path, (folder, conf) = _opened.popitem()
        try:
            folder.getFileSystem(conf).delete(folder, True)
        except Exception as problem:  # the gateway may be gone at exit
            print(f"{path} could not be deleted: {problem}")


atexit.register(release)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing will read them again: the last round of a loop, say."""
    for df in tables:
        own = session_folder(df.sparkSession).split(":", 1)[-1].lstrip("/")
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.split(":", 1)[-1].lstrip("/").rpartition("/")[0].endswith(own):
                folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(conf).delete(folder, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with files that outlive executors, and fixes values such as positions that a
    second evaluation could produce differently. Later passes read only the columns they need. The files live as
    long as the driver, or until ``release``.
    """
    path = f"{session_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
