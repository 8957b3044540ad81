"""Session settings, table loading and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the settings every operator here relies on (UTC, ANSI, AQE).

    A cluster job normally brings its own session; this one is for tests and the benchmark.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        # Small local tables are CPU-bound: merge their shuffle partitions less eagerly.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "512k",
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.master(master).appName("deedwork")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _conf(spark: SparkSession, key: str) -> str | None:
    return spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)


def scratch_root(spark: SparkSession) -> str:
    """The folder for staged copies: ``spark.checkpoint.dir``, or one in the warehouse; every executor must reach it.

    A warehouse on the driver's own disk, as it is by default, serves a local session only.
    """
    if root := _conf(spark, "spark.checkpoint.dir"):
        return root.rstrip("/")
    root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    if root.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses, under this application's own folder, which goes when the application ends."""
    context = spark.sparkContext
    own = f"{scratch_root(spark)}/deedwork-{context.applicationId}"
    if getattr(context, "_deedwork_staged", None) != own:
        context._deedwork_staged = own
        atexit.register(_discard, context, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _discard(context, folder: str) -> None:
    if context._jsc is not None and not context._jsc.sc().isStopped():
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the scratch folder and read back: a cut that outlives executors.

    For an intermediate result several branches need, where each would otherwise start over from
    the source. As a columnar table it keeps its column pruning and its size estimate.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, for work that runs in Python there."""
    context = spark.sparkContext
    if getattr(context, "_deedwork_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="deedwork-"), "deedwork-package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("deedwork", os.path.relpath(path, home)))
    context.addPyFile(archive)
    context._deedwork_shipped = True


class Tables:
    """The tables of one data folder: ``Tables(spark, folder).orders`` is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str, files_per_batch: int | None = None):
        self.spark = spark
        self.files_per_batch = files_per_batch
        self.folder = folder.rstrip("/")
        ship_package(spark)
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    def stream(self, name: str) -> DataFrame:
        """The table as a file stream. The pattern takes a folder of files and a single file alike."""
        reader = self.spark.readStream.schema(getattr(self, name).schema)
        if self.files_per_batch:
            reader = reader.option("maxFilesPerTrigger", self.files_per_batch)
        return reader.parquet(f"{self.folder}/{name}.parque[t]")

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, name)
