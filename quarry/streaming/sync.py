"""Incremental corpus sync: by content fingerprints, in batch or from a stream."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

#: Parts of a table that a stream keeps; a batch rewrites only those that it touches.
BUCKETS = 64


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns as JSON in order of name, nulls written."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def difference(old: DataFrame, new: DataFrame, key: str, digest: str = "digest") -> DataFrame:
    """key, change (added, changed, removed, unchanged) between two tables of fingerprints."""
    a, b = old.select(key, F.col(digest).alias("_old")), new.select(key, F.col(digest).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def sync(index: DataFrame | None, docs: DataFrame, key: str, embed: Callable[[DataFrame], DataFrame], columns: list[str], refit: bool = False) -> tuple[DataFrame, dict]:
    """The new index (key, digest and what embed made) and a report; only new and changed rows are embedded, with refit all if any changed.

    embed turns rows of docs into key and the columns of a vector.
    """
    now = docs.withColumn("digest", fingerprint(*columns))
    old = index if index is not None else now.select(key, "digest").limit(0)
    diff = difference(old, now, key)
    counts = {r["change"]: r["count"] for r in diff.groupBy("change").count().collect()}
    fresh, removed = counts.get("added", 0) + counts.get("changed", 0), counts.get("removed", 0)
    rebuild = index is None or bool(refit and (fresh or removed))
    again = now if rebuild else now.join(diff.where("change IN ('added', 'changed')").select(key), key, "left_semi")
    made = embed(again).join(now.select(key, "digest"), key)
    if not rebuild:
        kept = index.join(diff.where("change = 'unchanged'").select(key), key, "left_semi")
        made = kept.select(made.columns).unionByName(made)
    n = counts.get("unchanged", 0)
    return made, {"embedded": fresh + n if rebuild else fresh, "reused": 0 if rebuild else n, "removed": removed, "full_rebuild": rebuild, "changed": bool(fresh or removed)}


def stream_sync(stream: DataFrame, key: str, order: str, columns: list[str], path: str, checkpoint: str, buckets: int = BUCKETS):
    """Keeps a table of the version of each key that is last by order, however late the others come; read it with synced.

    Rows lie in buckets by the hash of their key. A batch is merged into the buckets that it touches, which are written
    anew, and a manifest then names the files of every bucket; a batch that runs again writes the same. What neither the
    manifest nor the one before it names is removed. Of versions that are equal by order, that of the greatest row stays.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _manifest(spark, path, number - 1)
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
        fresh = batch.withColumn("digest", fingerprint(*columns)).select("*", bucket).persist()
        try:
            touched = sorted(r[0] for r in fresh.select("bucket").distinct().collect())  # at most `buckets`
            if not touched:
                _write_manifest(spark, path, number, before)
                return
            old = [p for b in touched if (p := before.get(str(b)))]
            placed = fresh.unionByName(spark.read.parquet(*old).select("*", bucket)) if old else fresh
            rest = [c for c in placed.columns if c not in (key, "bucket", order)]
            last = placed.groupBy("bucket", key).agg(F.max(F.struct(order, *rest)).alias("r")).select("bucket", key, "r.*")
            target = f"{path}/data/{number}"
            last.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        finally:
            fresh.unpersist()
        now = before | {str(b): f"{target}/bucket={b}" for b in touched}
        _write_manifest(spark, path, number, now)
        kept = set(now.values()) | set(before.values())
        for gone in set(_manifest(spark, path, number - 2).values()) - kept:
            files.remove(spark, gone)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _manifest(spark: SparkSession, path: str, number: int) -> dict[str, str]:
    at = f"{path}/manifest/{number}.json"
    return json.loads(files.read_text(spark, at)) if number >= 0 and files.exists(spark, at) else {}


def _write_manifest(spark: SparkSession, path: str, number: int, buckets: dict[str, str]) -> None:
    files.write_text(spark, f"{path}/manifest/{number}.json", json.dumps(buckets, sort_keys=True))
    files.write_text(spark, f"{path}/manifest/last.json", json.dumps({"number": number}))


def synced(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that stream_sync keeps; null before its first rows."""
    at = f"{path}/manifest/last.json"
    if not files.exists(spark, at):
        return None
    parts = sorted(_manifest(spark, path, json.loads(files.read_text(spark, at))["number"]).values())
    return spark.read.parquet(*parts) if parts else None
