"""Tables that jobs store between their stages, in the folder that driver and executors share, and when these go.

A scope belongs to the thread (or task) that opened it, so jobs that run side by side in one driver do not touch each other's
tables. What is stored outside any scope stays until the end of the program.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_rest: list[str] = []
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=(_rest,))
_making = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Where none is set, a temporary one if all runs on this
    machine, as in tests; on a cluster an error, as executors could not see such a folder."""
    sc = spark.sparkContext
    with _making:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="coverlake-checkpoint-")
            sc.setCheckpointDir(named)
    return named


def delete(paths: list[str]) -> None:
    """Delete tables through Spark's file systems, where a session is still there."""
    if not (sc := SparkContext._active_spark_context) or not paths:
        return
    conf = sc._jsc.hadoopConfiguration()
    while paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


atexit.register(delete, _rest)


def stored(df: DataFrame, scope: int = -1) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder, which a lost executor does not take away. The table stays
    until the end of its scope (the innermost by default, -2 the one around), else of the program, as results may be read late."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    scopes = _scopes.get()
    scopes[max(scope, -len(scopes))].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _opened(own: list[str]) -> Iterator[list[str]]:
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield own
    finally:
        _scopes.reset(token)


@contextmanager
def scope() -> Iterator[None]:
    """Tables stored within are deleted at the end, but for those stored with ``scope=-2``, in the scope around."""
    own: list[str] = []
    try:
        with _opened(own):
            yield
    finally:
        delete(own)


@contextmanager
def kept() -> Iterator[list[str]]:
    """The paths of the tables stored within, oldest first. What has not been deleted at the end goes to the scope around."""
    own: list[str] = []
    around = _scopes.get()[-1]
    try:
        with _opened(own):
            yield own
    finally:
        around += own
