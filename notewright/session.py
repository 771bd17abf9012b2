"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that change results, not just speed: JSON objects with a repeated key keep the
# last value instead of failing, and timestamps print the same everywhere.
RESULT_SETTINGS = {
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Speed: let the runtime split skewed join partitions and merge small ones; pack many
# small note files into one task.
PLAN_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.files.openCostInBytes": str(64 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Speed: the JVM never compiles a method above 8,000 bytes, and making a log's rows fuses into one
# beyond that; above the limit Spark runs a stage's steps one by one, each compiled.
CODE_SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def configure(spark: SparkSession, plan: bool = True) -> SparkSession:
    """Apply the settings a job relies on to an existing session."""
    for key, value in {**RESULT_SETTINGS, **CODE_SETTINGS, **(PLAN_SETTINGS if plan else {})}.items():
        spark.conf.set(key, value)
    # Python workers import this package from where the driver has it, unless told otherwise
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    return spark


def shared_dir(spark: SparkSession, folder: str | None = None) -> str:
    """The folder for written intermediate tables: ``folder``, or the one the cluster names
    for checkpoints. A local session with neither gets one by its application's id; a
    cluster with neither is refused, as no executor could read a folder of one machine."""
    conf = spark.sparkContext.getConf()
    named = folder or conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    own = f"/tmp/notewright-{spark.sparkContext.applicationId}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def run_dir(spark: SparkSession, label: str, folder: str | None = None) -> str:
    """A folder of its own for one run, below the shared folder."""
    return f"{shared_dir(spark, folder)}/notewright/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` once and go on from the written table: for what is costly, has side
    effects or is read more than once, and so must survive a lost executor."""
    path = run_dir(df.sparkSession, label, folder)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote, once nothing reads it."""
    spark = df.sparkSession
    jvm = spark._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
