"""Session helpers: a local session for tests, and tables in the cluster's shared folder."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("procsight")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the cluster names in `spark.checkpoint.dir`.

    Only a local master, where driver and executors are one process, may fall
    back to a folder of its own; anywhere else a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="procsight-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


# Shuffle files of an SQL execution go at its end instead of with the driver's garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that only the work inside a `with` block reads; they are deleted at its end."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/procsight-scratch-{uuid.uuid4().hex}"
        self.tables = 0

    def stored(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        return _write(df, f"{self.folder}/{self.tables}")

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    For rows that many later jobs use: the lineage ends here, a lost executor
    costs a scan, and later jobs read only the columns they need.
    """
    return _write(df, f"{shared_folder(df.sparkSession)}/procsight-{uuid.uuid4().hex}")
