"""The folder that driver and executors share, and files at paths."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: How many partitions the queries' tables are dealt to; unset or 0: as their files are read. For tables whose files have fewer row groups than there are cores.
SCAN_PARTITIONS = "spark.sieveline.scanPartitions"

#: Folders that this process asked for, for frames that read them later.
_written: set[str] = set()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables, dealt anew if SCAN_PARTITIONS says so."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    n = int(spark.conf.get(SCAN_PARTITIONS, "0"))
    return df.repartition(n) if n else df


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where none is set, a local session gets one of its own; on a cluster that would be another folder on every machine, so it is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sieveline-"))
        found = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, kind: str) -> str:
    """A folder for files that a returned frame reads from; `clear` takes them away."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def clear(spark: SparkSession, paths: Iterable[str] | None = None) -> int:
    """Deletes the given folders of new_path, or all that this process has asked for, and says how many there were. To be called when the frames that read from them have been used."""
    gone = 0
    jvm = spark.sparkContext._jvm
    for path in sorted(_written if paths is None else _written.intersection(paths)):
        p = jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))
        _written.discard(path)
    return gone


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern finds anything, in whatever store it lies."""
    try:
        spark.read.format("binaryFile").load(path).schema
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True
