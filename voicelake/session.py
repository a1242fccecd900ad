"""Session settings, lineage cuts and work tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "voicelake", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators are written for.

    AQE coalesces small shuffles, splits skewed join partitions and turns joins into broadcasts when the measured side
    is below the threshold, so no operator carries an unchecked broadcast hint.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints and work tables: spark.checkpoint.dir, or a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder: executors cannot read a machine-local one")
    folder = tempfile.mkdtemp(prefix="voicelake-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Cut lineage by writing a table in the shared folder and reading it back.

    An iterative plan stays short, a lost executor costs nothing but a reread, and the file sizes tell Spark how large
    the result is, so it picks broadcast or shuffle joins on measured sizes. `replaces` is a result of an earlier round
    that nothing reads any more; its files are removed.
    """
    spark = df.sparkSession
    path = work_path(spark, "cut")
    df.write.parquet(path)
    result = spark.read.schema(df.schema).parquet(path)
    result._work_path = path
    if replaces is not None:
        remove_work(spark, replaces._work_path)
    return result


def remove_work(spark: SparkSession, path: str) -> None:
    """Delete a work table of our own (never a path outside the work folder)."""
    if "/voicelake-work/" not in path:
        raise ValueError(f"not a work table: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class WorkScope:
    """The work tables that were made while the scope was open."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def remove(self) -> None:
        """Delete them; nothing may read them any more."""
        while self.paths:
            remove_work(self.spark, self.paths.pop())


_SCOPES: list[WorkScope] = []
_ROOTS: set[str] = set()


@contextmanager
def work_scope(spark: SparkSession) -> Iterator[WorkScope]:
    """Collect the work tables made inside, so that a job of several steps can drop those of a finished step."""
    scope = WorkScope(spark)
    _SCOPES.append(scope)
    try:
        yield scope
    finally:
        _SCOPES.remove(scope)


def _remove_root(spark: SparkSession, root: str) -> None:
    with suppress(Exception):  # the session may have ended before the interpreter does
        remove_work(spark, root)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table or files that a job writes.

    Everything lies in one folder per application, which goes when the application ends.
    """
    root = os.path.join(shared_folder(spark), "voicelake-work", spark.sparkContext.applicationId)
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_remove_root, spark, root)
    path = os.path.join(root, uuid.uuid4().hex, name)
    for scope in _SCOPES:
        scope.paths.append(path)
    return path
