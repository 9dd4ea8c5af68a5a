"""Session helpers: a local session for tests and benches, and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Settings worth having on a cluster too. Scoring is one wide projection; the JVM leaves methods above 8,000 bytes
# uncompiled, so such a stage must fall back to per-operator code, which Spark splits into small methods.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(app: str = "ebbtide", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Single-JVM session for tests and benches; a cluster job brings its own session."""
    builder = SparkSession.builder
    for name, setting in TUNING.items():
        builder = builder.config(name, setting)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        # Python workers are spoken to without the delays of TCP's acknowledgements, 40 ms a task.
        .config("spark.python.unix.domain.socket.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    A machine-local folder is used only on a local master, where one machine is the whole cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    named = tempfile.mkdtemp(prefix="ebbtide-checkpoints-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def ensure_checkpoints(spark: SparkSession) -> None:
    """Let iterative fits checkpoint into the shared folder."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder as Parquet and go on from the written copy.

    The copy survives lost executors, and later passes over it read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ebbtide-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
