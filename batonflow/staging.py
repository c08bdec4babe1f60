"""Tables written to the cluster's shared folder to cut lineage or to read a result twice.

The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a local
session takes a temporary folder of this process, removed at exit; on a cluster it
is an error, as executors would write to disks of their own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from functools import cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="batonflow-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_folder(spark: SparkSession) -> str:
    path, master = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.master", "")
    if not path and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (path or _own_folder()).rstrip("/")


def stage(df: DataFrame, name: str, group: int | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    The files outlive lost executors, and the lineage of what is read is one scan.
    Where rows hold megabytes, `group` is the bytes of a row group: the writer looks
    at its size after each row, not after a hundred, and a reader takes a group at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/batonflow-{name}-{uuid4().hex}"
    writer = df.write
    if group:
        rows = ("block.size.row.check.min", "block.size.row.check.max", "page.size.row.check.min", "page.size.row.check.max")
        writer = writer.option("parquet.block.size", group).options(**{f"parquet.{x}": 1 for x in rows})
    writer.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def grown(df: DataFrame) -> DataFrame:
    """`df`, which grows with the input: a join that has it as a side shuffles, and broadcasts it at no size.

    Without this Spark goes by the size of the files under `df`. They are compressed, and
    rows that a generator adds aren't counted, so tables of many times the limit for
    broadcasts would pass whole through the driver. A side that is small by nature is
    broadcast as before where it is marked by F.broadcast.
    """
    return df.hint("merge")


#: What this process has staged and not removed.
_STAGED: list[str] = []


def staged() -> int:
    """How many tables are staged: a mark for clear()."""
    return len(_STAGED)


def clear(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Removes the tables staged after the mark `since`, but for the last `keep`. No result that reads them may be in use."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    end = len(_STAGED) - keep
    for path in _STAGED[since:end]:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    del _STAGED[since:end]
