"""Table access and staging in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[str] = []
_LOCAL: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a session that runs in one process (tests) has a temporary folder; a cluster, whose executors
    could not see each other's, has none, and that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return "file://" + _LOCAL[0]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted with the staged tables."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _STAGED:
        atexit.register(_at_exit)
    _STAGED.append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors.

    The table stays until ``release``, the end of ``staging`` or of the driver.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the staged tables (those after the first ``since``): what was built on them can no longer be computed."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _STAGED[since:]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        _STAGED.remove(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Staged tables of the block are deleted at its end; write or collect results inside it."""
    since = len(_STAGED)
    try:
        yield
    finally:
        release(spark, since)


def _at_exit() -> None:
    """Delete what is left: through the session if it still runs, else what lies in folders of this machine."""
    try:
        if (spark := SparkSession.getActiveSession()) is not None:
            release(spark)
    except Exception:  # the gateway may be gone
        pass
    for path in _STAGED:
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), True)
