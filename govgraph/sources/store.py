"""Small file-system steps that work on whatever store a path names: list, look, drop, put if absent."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names right below a folder; none where it does not exist."""
    store, target = _at(spark, path)
    if not store.exists(target):
        return []
    return sorted(entry.getPath().getName() for entry in store.listStatus(target))


def exists(spark: SparkSession, path: str) -> bool:
    store, target = _at(spark, path)
    return bool(store.exists(target))


def remove(spark: SparkSession, path: str) -> None:
    """Drop a folder or file; nothing happens where there is none."""
    store, target = _at(spark, path)
    store.delete(target, True)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless one is there: of several writers exactly one gets True.

    The text is written beside the target and renamed without overwriting, so no reader sees half a file. Where
    the store lacks such a rename (plain object stores), ``create`` without overwriting decides.
    """
    import uuid

    store, target = _at(spark, path)
    if store.exists(target):
        return False
    mine = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = store.create(mine, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
        options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(mine, target, options)
        return True
    except Exception as error:
        if "FileAlreadyExistsException" in str(error):
            return False
        raise
    finally:
        store.delete(mine, False)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; null where there is none."""
    store, target = _at(spark, path)
    if not store.exists(target):
        return None
    stream = store.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
