"""Session conventions shared by every job: UTC clock, adaptive execution, size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_ROWS_KEY = "tidemark.hot.rows"
BROADCAST_ROWS_KEY = "tidemark.broadcast.rows"

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options every query relies on; safe to call on a shared session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors once per context, so that workers can import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / "tidemark-code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._tidemark_shipped = True


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-JVM session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files, be it one file or a folder of them.

    The last letter stands in brackets, so that the path is a pattern: a stream takes a plain path for a folder.
    """
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; only a local session may fall back to /tmp."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    sc.setCheckpointDir(folder)


def durable(df: DataFrame) -> DataFrame:
    """Write the frame once below the checkpoint folder and read it back.

    Cuts the lineage, survives lost executors, and gives later joins the true size of the table.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_rows(spark: SparkSession) -> int:
    """Rows of one key that a single task may sort; larger keys are split."""
    return int(spark.conf.get(HOT_ROWS_KEY, "5000000"))


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_ROWS_KEY, "200000"))


def fits_broadcast(df: DataFrame) -> bool:
    limit = broadcast_rows(df.sparkSession)
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast only after counting; otherwise leave the join to shuffle and AQE skew splitting."""
    return F.broadcast(df) if fits_broadcast(df) else df


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly per-row work when the scan has fewer splits than that (a few small files).

    With many files, the usual case at scale, the frame is returned as it is and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of one task where ``by_key`` is told how many there are.
TASK_ROWS = 500_000


def by_key(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """Place rows by key in ``spark.sql.shuffle.partitions`` tasks. The number is explicit, so adaptive
    execution, which sizes partitions by bytes, does not merge them in front of costly Python work.

    Given the number of ``rows``, more tasks are used so that each gets about ``TASK_ROWS`` at most: what a task
    holds then does not grow with the table.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-rows // TASK_ROWS)), *keys)


@contextmanager
def few_local_partitions(spark: SparkSession):
    """In a single-JVM session, no more shuffle partitions than cores: each holds a state store of its own.
    A cluster's setting is left alone."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    if spark.sparkContext.master.startswith("local"):
        spark.conf.set(key, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder, for tables and stream checkpoints a job writes."""
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    sc._tidemark_folders = [*getattr(sc, "_tidemark_folders", []), path]
    return path


def remove_scratch(spark: SparkSession) -> int:
    """Remove every folder that this context's jobs got from ``scratch_dir``; the number of folders.

    Call it when results are stored elsewhere: tables read from these folders are gone afterwards.
    """
    sc = spark.sparkContext
    folders, sc._tidemark_folders = getattr(sc, "_tidemark_folders", []), []
    for folder in folders:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    return len(folders)
