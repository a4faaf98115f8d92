"""Session settings the package is tested with."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DIR_CONF = "spark.checkpoint.dir"
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "leakflow", **more: str) -> SparkSession:
    """A session with the defaults; keyword arguments add settings with dots written as double underscores."""
    builder = SparkSession.builder.appName(app)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the executors, once a session, so that workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_leakflow_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="leakflow-")) / "leakflow.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._leakflow_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset (a single machine, as in tests) a new temporary one."""
    base = spark.conf.get(DIR_CONF, None) or spark.sparkContext.getConf().get(DIR_CONF)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {DIR_CONF} to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="leakflow-")
        spark.conf.set(DIR_CONF, base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no one else uses; removed when the driver ends, as is a stream's checkpoint at the same path and ``-checkpoint``."""
    path = f"{shared_dir(spark)}/leakflow-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(conf)
    store.deleteOnExit(target)
    store.deleteOnExit(jvm.org.apache.hadoop.fs.Path(f"{path}-checkpoint"))
    return store.makeQualified(target).toString()


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here, one job does it, and lost executors cost no work done before."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of an equality join that both sides' growth leaves a sorted shuffle: Spark would collect a side of some megabytes of Parquet in the driver and broadcast it, which loops add up."""
    return df.hint("merge")
