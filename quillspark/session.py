"""Session helpers: settings, table loading, shared storage, worker imports."""

from __future__ import annotations

import gc
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: Settings for a session of our own; a cluster's settings are left alone.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow, for tests and the bench."""
    b = SparkSession.builder.master(master).config("spark.driver.memory", memory)
    for k, v in (DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows of one Arrow batch: with long texts a batch of Spark's default of 10,000 takes a large part of a worker's memory.
BATCH_ROWS = "2048"


def _local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def _ship(spark: SparkSession) -> None:
    """Gives workers this package: by path in one process, else as an archive that Spark sends to executors."""
    sc = spark.sparkContext
    if _local(spark):
        known = sc.environment.get("PYTHONPATH", "")
        if ROOT not in known.split(os.pathsep):
            sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
        return
    if getattr(sc, "_quillspark_sent", False):
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for folder, _, names in sorted(os.walk(os.path.join(ROOT, "quillspark"))):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), ROOT))
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quillspark-{uuid.uuid4().hex}.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(held.getvalue()))
    out.close()
    sc.addPyFile(path.toString())
    sc._quillspark_sent = True


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, keeps Arrow batches small unless they are set, and gives a local session a checkpoint folder if it has none."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    shared_dir(spark)
    _ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local session (tests) gets one of its own and any other raises."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not _local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
        where = sc.getCheckpointDir()
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_path = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes a table of written() that nothing will read again."""
    spark, path = table.sparkSession, table._written_path
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished jobs now: it does so for plans that the driver's garbage collector has found."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slim(spark: SparkSession) -> None:
    """Lets the executors' JVMs collect garbage and give back heap, as far as their collector does: else the heap stays as wide as the widest phase made it, next to
    Python workers that need the memory. One short task for each core; an executor that gets none stays as it is."""
    release(spark)
    if not _local(spark):  # there the driver is the executor
        n = max(1, spark.sparkContext.defaultParallelism)
        spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).collect()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
