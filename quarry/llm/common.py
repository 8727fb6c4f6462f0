"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI: spark.checkpoint.dir, or what the context has been given.

    A temporary folder stands in for it only where driver and executors are one process (master local); elsewhere
    a missing setting raises, as no machine's own folder is seen by the others.
    """
    uri = spark.conf.get("spark.checkpoint.dir", None)
    if not uri:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        uri = sc.getCheckpointDir()
    if uri.startswith("file:"):
        uri = uri[len("file:") :]
    return f"file:///{uri.lstrip('/')}" if uri.startswith("/") else uri.rstrip("/")


def fresh_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage at a reliable checkpoint in the shared folder.

    Before that it has Spark remove the files of shuffles and checkpoints that nothing refers to any more: its cleaner
    acts on what a collection of the driver's memory finds (Python's and the JVM's), and a driver with little to do may
    not collect for hours.
    """
    spark = df.sparkSession
    gc.collect()
    spark._jvm.System.gc()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def remove_dir(spark: SparkSession, uri: str) -> None:
    """Removes a folder that fresh_dir named, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key of fewer rows is one task's work, whatever share of all rows that is.
LIGHT = 1 << 16


def spread_join(many: DataFrame, one: DataFrame, on: list[str], weight: str, total: int | None = None) -> DataFrame:
    """Inner join of rows to one row a key, of which `weight` says how many of the rows it will meet; weight is dropped.

    A key that meets more than an even task's share of all rows (total; counted if not given), and over LIGHT, is dealt
    among as many tasks as it fills. Fewer keys than there are shuffle partitions can be so heavy, which bounds what is
    broadcast to tell them. Rows are dealt by their hash, so a task that runs again deals them alike.
    """
    parts = max(1, int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if total is None:
        one = checkpointed(one)
        total = one.agg(F.sum(weight)).first()[0] or 0
    share = max(LIGHT, total // parts)
    if total <= share:  # no key can be heavy
        return many.join(one.drop(weight).hint("merge"), on)
    salts = F.least(F.lit(parts), F.ceil(F.col(weight) / share)).cast("int")
    heavy = one.where(F.col(weight) > share).select(*on, salts.alias("_salts"))
    dealt = many.join(F.broadcast(heavy), on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*many.columns), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    held = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(weight) > share, salts).otherwise(1) - 1))).drop(weight)
    return dealt.join(held.hint("merge"), [*on, "_salt"]).drop("_salt")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once a row however often the body names it."""
    return F.transform(F.array(value), body)[0]


#: The columns by which rows are dealt and joined, so that a join and the grouping of equal rows share one shuffle.
ROW = ["_id", "_none", "tie"]


def keyed(rows: DataFrame) -> DataFrame:
    """rows (doc_id, tie) with ROW, of which none is null."""
    return rows.withColumns({"_id": F.coalesce("doc_id", F.lit(0)), "_none": F.col("doc_id").isNull()})


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """What is run within hands Arrow batches of about `size` bytes to its workers; else they may be of 10,000 rows of any length."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def slices(batch, rows: int = 256) -> Iterator:
    """An Arrow batch in pieces, so that few texts at a time become Python objects."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
