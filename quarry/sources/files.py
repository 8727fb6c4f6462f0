"""Small files beside tables, through the file systems that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _at(spark, path)
    return store.exists(place)


def read_text(spark: SparkSession, path: str) -> str:
    store, place = _at(spark, path)
    stream = store.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the place and renames, so that a reader finds the old text or the new one."""
    store, place = _at(spark, path)
    _, beside = _at(spark, f"{path}.part")
    store.mkdirs(place.getParent())
    stream = store.create(beside, True)
    stream.write(text.encode())
    stream.close()
    if store.exists(place):
        store.delete(place, False)
    if not store.rename(beside, place):
        raise OSError(f"cannot write {path}")


def remove(spark: SparkSession, path: str) -> None:
    store, place = _at(spark, path)
    store.delete(place, True)
