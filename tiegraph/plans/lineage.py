"""Cutting lineage: intermediate tables in a folder that the driver and every executor share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor see: spark.checkpoint.dir; where it is unset a temporary one, in one process only."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tiegraph-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


_owned: set[str] = set()


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)
    _owned.discard(path)


def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        for path in list(_owned):
            try:
                drop_folder(spark, path)
            except Exception:  # the session may be gone already; its folder then stays for the cluster's own clean-up
                return


atexit.register(_sweep)


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/tiegraph/{label}-{uuid.uuid4().hex}"
    _owned.add(path)
    return path


#: Spark's setting by which a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, label: str, codec: str = "zstd", free: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors. Also the path. With
    ``free`` the write's shuffle files are deleted as soon as it is done."""
    spark = df.sparkSession
    path, before = fresh_path(spark, label), spark.conf.get(_FREE, None)
    try:
        if free:
            spark.conf.set(_FREE, "true")
        df.write.option("compression", codec).parquet(path)
    finally:
        if free:
            spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str, codec: str = "zstd", free: bool = False) -> DataFrame:
    return stash(df, label, codec, free)[0]


class Rounds:
    """State of a loop: every round is written, and the folder of the round before the last is deleted."""

    def __init__(self, label: str) -> None:
        self.label, self.paths = label, []

    def keep(self, df: DataFrame) -> DataFrame:
        out, path = stash(df, self.label)
        self.paths.append(path)
        while len(self.paths) > 2:
            drop_folder(df.sparkSession, self.paths.pop(0))
        return out
