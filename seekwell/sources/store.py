"""Small files in any store that Spark reads: a pointer that is replaced, a lock that only one holds."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or nothing if there is none."""
    jvm, where, fs = _path(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> bool:
    """Write a small file; without ``overwrite`` false is returned if there is one."""
    _, where, fs = _path(spark, path)
    try:
        stream = fs.create(where, overwrite)
    except Exception:
        if not overwrite and fs.exists(where):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def replace_text(spark: SparkSession, path: str, text: str, name: str) -> None:
    """Write beside the file and rename over it, so that readers see the old text or the new one."""
    jvm, where, _ = _path(spark, path)
    write_text(spark, f"{path}.{name}", text)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    qualified = context.makeQualified
    context.rename(qualified(jvm.org.apache.hadoop.fs.Path(f"{path}.{name}")), qualified(where), options)


def delete(spark: SparkSession, path: str) -> None:
    _, where, fs = _path(spark, path)
    fs.delete(where, False)


def delete_folder(spark: SparkSession, path: str) -> None:
    _, where, fs = _path(spark, path)
    fs.delete(where, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no folder."""
    _, where, fs = _path(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def state_of(spark: SparkSession, path: str) -> str:
    """A name for what a table's files are now: their paths, sizes and times."""
    _, where, fs = _path(spark, path)
    found, files = [], fs.listFiles(where, True)
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()
