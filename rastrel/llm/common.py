"""What the corpus operators share: tables, shared storage, and cutting lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its whole name, dots and quotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset the one that was given to
    setCheckpointDir(). Without either, only a local session has a folder that all can read; others raise."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    import tempfile

    context.setCheckpointDir(tempfile.mkdtemp(prefix="rastrel-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


_SCRATCH: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Removes the tables that written() makes inside, but for kept ones, when their readers are done: at the end."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for df in _SCRATCH.pop():
            discard(df)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows of df, written as Parquet to a fresh folder of the shared one and reread: computed once, without lineage.

    Unlike checkpoint(), which computes its rows a second time to store them.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(made)
    return made


def discard(df: DataFrame) -> None:
    """Removes the files of a table from written(), once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffled(df: DataFrame) -> DataFrame:
    """df, to be joined by a shuffle and never by broadcast. Spark sizes a table by its files and the kinds of its columns,
    so what an explode, an array or packed values multiply looks small, and would go through the driver whole."""
    return df.hint("merge")


def spread_join(rows: DataFrame, names: DataFrame, key: str | list[str], hot: DataFrame) -> DataFrame:
    """rows joined with names, one row a key, on key. The keys in `hot`, a table of bounded size, go by broadcast, so that
    no task gets all rows of one; the others by a shuffle."""
    hot = hot.select(key).distinct()
    some = rows.join(F.broadcast(names.join(F.broadcast(hot), key, "left_semi")), key)
    return some.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(names, key))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of a task's batches, whose worker gives freed memory back to the system at the task's end: workers
    are kept for the next stages, which need the room for their own tables."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)
