"""Where lineage is cut, and how small files are dealt."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only where none is named and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    name = spark.sparkContext.applicationId
    if name not in _OWN:
        _OWN[name] = tempfile.mkdtemp(prefix="checkpoints_")
    return _OWN[name]


def ensure_checkpoints(spark: SparkSession) -> None:
    """checkpoint() writes to the shared folder; it is set only where none is."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def spread(rows: DataFrame) -> DataFrame:
    """A table in fewer splits than there are cores, as a single small file is, dealt over all of them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() * 2 > cores else rows.repartition(cores)
