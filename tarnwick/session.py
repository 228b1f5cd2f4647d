"""Sessions with the settings the engine is designed for."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


def make_session(app: str = "tarnwick", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. On a cluster leave ``master`` and partitions unset."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tarnwick-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one on a single machine only."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = _own_dir()
    return at.rstrip("/")


def checkpointed(df):
    """``df`` cut from its lineage by a reliable checkpoint in the shared folder (``spark.checkpoint.dir``)."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


class Parked:
    """Tables that one run of an operator writes to the shared folder, as compressed Parquet: smaller than checkpoints of the same rows."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df, name: str, **options: str):
        """Write a table and read it again: its lineage ends here."""
        df.write.options(compression="zstd", **options).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def keep(self, *names: str) -> None:
        """Remove all tables but those that the result still reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if files.exists(path):
            for each in files.listStatus(path):
                if each.getPath().getName() not in names:
                    files.delete(each.getPath(), True)
