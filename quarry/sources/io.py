"""Sources and sinks."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.metrics import LABEL_NAMES
from ..operators.schemas import CANDIDATE, CANDIDATE_LISTS, JOB, JOB_LISTS, normalized, struct, unknown_keys, violations
from . import files

LABELS = "job_id string, candidate_id string, relevance_label int, label_name string, rationale string, review_status string"


def read_records(spark: SparkSession, path: str, ddl: str, lists: list[str], multiline: bool = False, strict: bool = True) -> DataFrame:
    """JSON (multiline) or JSON lines as records; strict: keys that the record lacks and broken lines raise. Blank lines are skipped."""
    raw = spark.read.text(path, wholetext=multiline).where(F.trim("value") != "")
    if strict:
        unknown = F.array_join(unknown_keys(F.col("value"), ddl), ", ")
        raw = raw.select(F.when(unknown != "", F.raise_error(F.concat(F.lit("unknown keys: "), unknown)).cast("string")).otherwise(F.col("value")).alias("value"))
    rows = raw.select(F.from_json("value", struct(ddl), {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("r")).select("r.*")
    return normalized(rows, lists)


def read_candidates(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_records(spark, path, CANDIDATE, CANDIDATE_LISTS, **options)


def read_jobs(spark: SparkSession, path: str, multiline: bool = True, **options) -> DataFrame:
    return read_records(spark, path, JOB, JOB_LISTS, multiline, **options)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Graded labels from CSV with a header; a column that is missing raises."""
    found = spark.read.csv(path, header=True)
    missing = [f for f in struct(LABELS).fieldNames() if f not in found.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return found.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in struct(LABELS)])


def label_violations(labels: DataFrame, names: dict[int, str] | None = None, job_id: str | None = None) -> DataFrame:
    """candidate_id, rule for each row that breaks a rule of label files; what is null breaks every rule about it."""
    known = F.create_map(*[F.lit(x) for p in (names or LABEL_NAMES).items() for x in p])
    sure = lambda check: F.coalesce(check, F.lit(False))
    rules = {"label": sure(F.col("relevance_label").between(0, 3)), "label_name": sure(F.col("label_name") == known[F.col("relevance_label")])}
    if job_id is not None:
        rules["job_id"] = sure(F.col("job_id") == job_id)
    twice = labels.groupBy("candidate_id").count().where("count > 1").select("candidate_id", F.lit("duplicate").alias("rule"))
    return violations(labels, "candidate_id", rules).unionByName(twice)


def checked_labels(spark: SparkSession, path: str, job_id: str | None = None) -> DataFrame:
    """Graded labels of which none breaks a rule; else the first that does, by id, raises."""
    labels = read_labels(spark, path)
    bad = label_violations(labels, job_id=job_id).orderBy("candidate_id", "rule").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['candidate_id']}: {bad[0]['rule']}")
    return labels


#: The most files or members that one interactive run takes, and their sizes.
MOST_FILES, MOST_BYTES, MOST_ARCHIVE = 200, 10 << 20, 250 << 20
FILES = "source_file string, text string, error string"


def read_files(spark: SparkSession, path: str, extract: Callable[[bytes], str], suffix: str = ".pdf") -> DataFrame:
    """source_file, text, error of every file with the suffix, in any case; extract turns bytes into text and may raise. Files without text are errors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_extracted(p, c, extract) for p, c in zip(batch["path"], batch["content"], strict=True)], columns=["source_file", "text", "error"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{_any_case(suffix)}").load(path)
    return found.select("path", "content").mapInPandas(run, FILES)


def _any_case(suffix: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def in_name_order(rows: DataFrame, column: str = "source_file") -> DataFrame:
    """Files by name regardless of case, then by path."""
    return rows.orderBy(F.lower(F.regexp_extract(column, r"([^/]*)$", 1)), column)


def parsed_or_raise(rows: DataFrame) -> DataFrame:
    """The files that were read; raises if there are none, or none could be read."""
    report = ingestion_report(rows).first()
    if not report["parsed"]:
        raise ValueError(f"no file could be read, of {report['found']}")
    return rows.where("error IS NULL").drop("error")


def read_zip(spark: SparkSession, path: str, extract: Callable[[bytes], str], suffix: str = ".pdf", max_file: int = MOST_BYTES, max_total: int = MOST_ARCHIVE, max_members: int = MOST_FILES, start: int = 1) -> DataFrame:
    """As read_files, over the members of ZIP archives; folders, __MACOSX and other suffixes are skipped, sizes and number are bounded.

    Members are named by their place from `start` on, so that equal names stay apart.
    """

    def members(content: bytes) -> Iterator[tuple[str, bytes]]:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            every = archive.infolist()
            own = [i for i in every if not i.is_dir() and not i.filename.startswith("__MACOSX/") and i.filename.lower().endswith(suffix)]
            if sum(i.file_size for i in every) > max_total or any(i.file_size > max_file for i in own):
                raise ValueError("archive is too large")
            if len(own) > max_members:
                raise ValueError(f"archive has more than {max_members} files")
            for n, info in enumerate(own, start):
                yield f"{n:04d}_{info.filename.rsplit('/', 1)[-1]}", archive.read(info)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [_extracted(name, data, extract) for name, data in members(content)]
                except (ValueError, zipfile.BadZipFile) as error:
                    rows = [(path, None, str(error))]
                yield pd.DataFrame(rows, columns=["source_file", "text", "error"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{_any_case('.zip')}").load(path)
    return found.select("path", "content").mapInPandas(run, FILES)


def _extracted(name: str, content: bytes, extract: Callable[[bytes], str]) -> tuple:
    try:
        text = extract(content)
        return (name, text, None) if text.strip() else (name, None, "no extractable text")
    except Exception as error:  # a file that fails is a row of its own, not the end of the scan
        return name, None, f"{type(error).__name__}: {error}"


def staged_names(uploads: DataFrame, suffix: str = ".pdf", max_files: int = MOST_FILES, max_bytes: int = MOST_BYTES) -> DataFrame:
    """ord, name, staged: the names under which uploads (ord, name, size) are kept, by name regardless of case.

    Folders of a name are dropped, other suffixes left out; of names that differ in case only, the later ones get _2, _3
    and so on. An upload over max_bytes, or more than max_files, raise.
    """
    base = F.regexp_extract("name", r"([^/\\]*)$", 1)
    own = uploads.withColumn("_base", base).where(F.lower("_base").endswith(suffix))
    n = F.row_number().over(W.partitionBy(F.lower("_base")).orderBy("ord"))
    stem = F.regexp_replace("_base", r"\.[^.]*$", "")
    size = F.when(F.col("size") > max_bytes, F.raise_error(F.concat("_base", F.lit(" is too large"))).cast("string")).otherwise(F.col("_base"))
    named = own.withColumn("_n", n).withColumn("staged", F.when(F.col("_n") == 1, size).otherwise(F.concat(F.substring(size, 1, F.length(stem)), F.lit("_"), F.col("_n").cast("string"), F.lit(suffix))))
    if own.limit(max_files + 1).count() > max_files:
        raise ValueError(f"at most {max_files} files are taken")
    return named.select("ord", "name", "staged").orderBy(F.lower("staged"))


def bounded(content: bytes, most: int = MOST_BYTES) -> bytes:
    """The content of an upload; one of no bytes, or of more than `most`, raises."""
    if not content:
        raise ValueError("the upload is empty")
    if len(content) > most:
        raise ValueError(f"the upload is larger than {most} bytes")
    return content


def ingestion_report(rows: DataFrame) -> DataFrame:
    """found, parsed, failed, and failures (source_file, error) of files as read."""
    failure = F.when(F.col("error").isNotNull(), F.struct("source_file", "error"))
    return rows.agg(F.count("*").alias("found"), F.count("text").alias("parsed"), F.count("error").alias("failed"), F.sort_array(F.collect_list(failure)).alias("failures"))


def write_csv(flat_rows: DataFrame, path: str) -> None:
    flat_rows.write.mode("overwrite").csv(path, header=True)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines, nulls written."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_document(spark: SparkSession, path: str, value: dict) -> None:
    """One JSON document, indented, in one file."""
    files.write_text(spark, path, json.dumps(value, indent=2, ensure_ascii=False))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The table of metrics that an experiment report writes: experiment and job_id, then numbers."""
    found = spark.read.csv(path, header=True)
    return found.select("experiment", "job_id", *[F.col(f"`{c}`").cast("double").alias(c) for c in found.columns if c not in ("experiment", "job_id")])
