"""Small helpers that the corpus operators share."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; bounds a Python worker's memory whatever the length of the texts.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
#: The column that holds a document's own columns.
DOC = "__doc"


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of very long texts still fits a worker; smaller settings stay as they are.

    The result is lazy, so the settings must hold until it is read and can't be put back here.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session (driver and executors in one process) gets a folder of its own,
    and any other gets a ValueError: a machine's own folder would lose what other executors wrote.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.TemporaryDirectory(prefix="byteloom-"))
        found = _OWN[0].name
    return found.rstrip("/")


#: The folder of a local session without the setting; it goes when the process ends.
_OWN: list[tempfile.TemporaryDirectory] = []
#: Paths written inside each open scratch().
_OPEN: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/byteloom/{uuid.uuid4().hex}-{name}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path that fresh_path gave, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    if jvm is None:
        shutil.rmtree(path, ignore_errors=True)
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes on leaving what was materialised inside, but for the tables put on the list that it gives."""
    keep: list[DataFrame] = []
    _OPEN.append([])
    try:
        yield keep
    finally:
        kept = {p for df in keep for p in [getattr(df, "_byteloom_path", None)] if p}
        written = _OPEN.pop()
        if _OPEN:
            _OPEN[-1] += kept
        for path in written:
            if path not in kept:
                delete(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage for good.

    A lost executor costs nothing of what was written, and later steps read only the columns they name.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._byteloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_byteloom_path", None)
        if path:
            delete(df.sparkSession, path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable is never inlined into inner lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def utf8(name: str) -> Column:
    """A string column's UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def packed(docs: DataFrame) -> DataFrame:
    """docs as the one struct column DOC, so that no name of theirs meets a name of ours; unpacked by select(DOC.*)."""
    return docs.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias(DOC))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
