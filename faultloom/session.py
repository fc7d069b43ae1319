"""Session settings used by the tests and the bench, and the shared checkpoint folder."""

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, app: str = "faultloom") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("FAULTLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession, name: str) -> str:
    """A folder below the cluster's shared checkpoint directory.

    The session's ``spark.checkpoint.dir`` is used when set.  Without it a local session gets a
    temporary folder; on a cluster that is an error, since other machines could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/{name}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    return tempfile.mkdtemp(prefix=f"faultloom-{name}-")
