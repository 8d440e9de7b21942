"""Tables in numbered versions with an atomic commit.

A version is a folder of data and a manifest, ``_commits/<number>``, that
names it. Data is written first, under a name of its own; then the manifest is
renamed into place, which the file system refuses if the number is taken. A
writer says which version it has read (by default the current one when it
starts): if another one was committed meanwhile, its commit is refused and its
data removed. A crash before the rename leaves the old version current, and a
reader always finds the highest committed one; nothing is ever overwritten.
The manifest also carries a mark, the last unit of work (a stream's batch, say)
that the version holds, so that a replay can tell what was committed already.
Of the old versions the last ``keep`` stay, for readers that are still at them.

File systems whose rename is not atomic (some object stores) need a single
writer or a store with conditional puts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class VersionConflict(RuntimeError):
    """Another version was committed since the one this writer has read."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, path: str) -> list[int]:
    p, fs = _fs(spark, f"{path}/_commits")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n) for n in names if n.isdigit())


def current_version(spark: SparkSession, path: str) -> int:
    """Number of the last committed version; 0 if nothing was committed yet."""
    return max(_commits(spark, path), default=0)


def _manifest(spark: SparkSession, path: str, number: int) -> tuple[str, str]:
    """(folder, mark) of a version."""
    p, fs = _fs(spark, f"{path}/_commits/{number}")
    stream = fs.open(p)
    try:
        folder = stream.readUTF()
        return folder, stream.readUTF() if stream.available() else ""
    finally:
        stream.close()


def version_mark(spark: SparkSession, path: str, number: int | None = None) -> str:
    """Mark of the current (or the given) version; empty if there is none."""
    number = current_version(spark, path) if number is None else number
    return _manifest(spark, path, number)[1] if number else ""


def read_version(spark: SparkSession, path: str, schema: str, number: int | None = None) -> DataFrame:
    """The current (or the given) version of a table; an empty one if nothing was committed yet."""
    number = current_version(spark, path) if number is None else number
    if not number:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{_manifest(spark, path, number)[0]}")


def write_version(df: DataFrame, path: str, based_on: int | None = None, keep: int = 3, mark: str | None = None) -> int:
    """Commit ``df`` as the version after ``based_on`` and give its number; VersionConflict if that number is taken.

    Without a mark of its own the version keeps that of the one before.
    """
    spark = df.sparkSession
    based_on = current_version(spark, path) if based_on is None else based_on
    mark = version_mark(spark, path, based_on) if mark is None else mark
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    try:
        commit_version(spark, path, folder, based_on + 1, mark)
    except VersionConflict:
        where, fs = _fs(spark, f"{path}/{folder}")
        fs.delete(where, True)
        raise
    for old in [n for n in _commits(spark, path) if n <= based_on + 1 - keep]:
        where, fs = _fs(spark, f"{path}/{_manifest(spark, path, old)[0]}")
        manifest, _ = _fs(spark, f"{path}/_commits/{old}")
        fs.delete(manifest, False)  # first the manifest: what is listed can be read
        fs.delete(where, True)
    return based_on + 1


def commit_version(spark: SparkSession, path: str, folder: str, number: int, mark: str = "") -> None:
    """Make the written ``folder`` version ``number``, or refuse."""
    jvm = spark._jvm
    draft, fs = _fs(spark, f"{path}/_drafts/{uuid.uuid4().hex}")
    final, _ = _fs(spark, f"{path}/_commits/{number}")
    fs.mkdirs(final.getParent())
    stream = fs.create(draft, False)
    stream.writeUTF(folder)
    stream.writeUTF(mark)
    stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(final), how)
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(final):
            raise VersionConflict(f"version {number} of {path} is committed already") from e
        raise
