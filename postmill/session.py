"""Session settings, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(master: str = "local[8]", app: str = "postmill", partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution. Shuffle partitions: as given, else 8 on one machine, and on a cluster what it is configured with."""
    builder = (SparkSession.builder.master(master).appName(app).config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false"))
    if partitions is None and master.startswith("local") and not master.startswith("local-cluster"):
        partitions = 8
    return (builder if partitions is None else builder.config("spark.sql.shuffle.partitions", str(partitions))).getOrCreate()


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder named by spark.checkpoint.dir; on one machine, as in tests, a temporary one is set where it is unset."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="postmill-shared-")
        sc.setCheckpointDir(where)
    return f"{where.rstrip('/')}/postmill/{what}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove_leftovers(spark: SparkSession, hours: float = 24) -> int:
    """Remove tables that jobs left in the shared folder (those of the training-data operators as well) and in which no file was written for so many hours.

    The number of those that went. Results that are read from such tables must have been written elsewhere by then."""
    root = spark._jvm.org.apache.hadoop.fs.Path(shared_path(spark, "x").rsplit("/", 1)[0])
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return 0
    before = (time.time() - hours * 3600) * 1000

    def in_use(path) -> bool:
        inside = files.listFiles(path, True)
        while inside.hasNext():
            if inside.next().getModificationTime() >= before:
                return True
        return False

    old = [s.getPath() for s in files.listStatus(root) if s.getModificationTime() < before and not in_use(s.getPath())]
    return sum(bool(files.delete(path, True)) for path in old)
