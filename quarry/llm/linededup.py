"""Line dedup over overlapping three-line windows.

Consecutive lines are hashed by threes; a window met before, in an earlier document or further up, is
a repeat, and every line that a repeat covers goes; where a repeat overlaps its own first occurrence, by
(doc_id, position), the lines of that stay (six equal lines become three). The lines of a first occurrence
go only where they are also part of a repeat of another, earlier window, in whose first place they stay.

Defined results: lines part at \\n only; windows without any word are not looked at; texts of fewer than
three lines, null and empty ones are left as they are; a text all of whose lines are covered becomes
empty. A null doc_id comes last in order. Rows that repeat both id and text are one document and are cut
alike; rows that repeat only the id are told apart by the hash of their texts. Other columns pass through,
whatever their names; no rows give no rows. Only hashes and positions are shuffled, pre-aggregated by hash,
and windows that very many documents have are dealt among tasks; the runs to cut are joined back, at most as
many to a document as it has lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, WORD, checkpointed, let, spread_join, table

WINDOW = 3


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, tie, pos, h: every window of lines that holds a word, by the place of its first line."""
    lines = F.split("text", "\n", -1)
    has_word = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), x.rlike(WORD).alias("w")))

    def of(own: Column) -> Column:
        at = lambda i, k: F.get(own, i + k)
        made = F.transform(F.sequence(F.lit(0), F.size(own) - size), lambda i: F.struct(i.alias("pos"), F.xxhash64(*[at(i, k)["h"] for k in range(size)]).alias("h"), sum((at(i, k)["w"].cast("int") for k in range(1, size)), at(i, 0)["w"].cast("int")).alias("w")))
        return F.when(F.size(own) >= size, F.filter(made, lambda x: x["w"] > 0))

    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.explode(let(has_word, of)).alias("x"))
    return rows.select("doc_id", "tie", F.col("x.pos").alias("pos"), F.col("x.h").alias("h"))


def covered(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, tie, cut: the runs of lines (start, stop) that windows met before cover, sorted by start.

    A window that overlaps its own first occurrence covers only what lies behind that.
    """
    rows = checkpointed(windows(docs, size))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie", "pos")
    firsts = rows.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("other"), F.count("*").alias("n")).where("first <> other").select("h", "first", "n")
    later = spread_join(rows, firsts, ["h"], "n").where(place != F.col("first"))
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie"))
    start = F.when(own, F.greatest(F.col("pos"), F.col("first.pos") + size)).otherwise(F.col("pos"))
    runs = later.select("doc_id", "tie", start.alias("start"), (F.col("pos") + size).alias("stop")).where("start < stop")
    return runs.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("cut"))


def _between(lines: Column, cut: Column) -> Column:
    """The lines outside the sorted runs cut: what lies between one run's end and the next one's start."""
    starts = F.concat(F.array(F.lit(0)), F.transform(cut, lambda c: c["stop"]))
    ends = F.concat(F.transform(cut, lambda c: c["start"]), F.array(F.size(lines)))
    return let(ends, lambda e: F.flatten(F.transform(starts, lambda s, i: F.slice(lines, s + 1, F.greatest(F.get(e, i) - s, F.lit(0))))))


def without_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs with their texts cut, and n_cut, the number of lines that went; a column n_cut is replaced."""
    cut = covered(docs, size).select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "cut")
    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64("text").alias("_own"))
    joined = rows.join(cut, (F.col("_row.doc_id").eqNullSafe(F.col("_id"))) & (F.col("_own") == F.col("_tie")), "left")
    text = F.col("_row.text")
    parts = let(F.split(text, "\n", -1), lambda lines: let(_between(lines, F.col("cut")), lambda kept: F.struct(F.array_join(kept, "\n").alias("text"), (F.size(lines) - F.size(kept)).alias("n"))))
    made = joined.withColumn("_kept", F.when(F.col("cut").isNotNull(), parts))
    own = [F.when(F.col("_kept").isNull(), text).otherwise(F.col("_kept.text")).alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns if c != "n_cut"]
    return made.select(*own, F.coalesce(F.col("_kept.n"), F.lit(0)).cast("long").alias("n_cut"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_cut")


def cut_lines(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: texts cut, their lengths counted anew; documents left without any text stay, empty."""
    made = without_repeats(docs.select(*DOCUMENT_COLUMNS)).drop("n_cut")
    return made.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*DOCUMENT_COLUMNS)


OP9_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents),
w AS (
  SELECT doc_id, text, p, x[p] || chr(10) || x[p + 1] || chr(10) || x[p + 2] AS g
  FROM (SELECT doc_id, text, x, unnest(range(1, len(x) - 1)) AS p FROM l WHERE len(x) >= 3)),
r AS (
  SELECT doc_id, text, p, row_number() OVER o AS k, first_value(doc_id) OVER o AS d1, first_value(text) OVER o AS t1, first_value(p) OVER o AS p1
  FROM w WHERE regexp_matches(g, '[^\x20\x09-\x0D]')
  WINDOW o AS (PARTITION BY g ORDER BY doc_id NULLS LAST, text, p)),
q AS (SELECT doc_id, text, unnest([p, p + 1, p + 2]) AS line, CASE WHEN d1 IS NOT DISTINCT FROM doc_id AND t1 = text THEN p1 + 2 ELSE 0 END AS held FROM r WHERE k > 1),
c AS (SELECT doc_id, text, list(DISTINCT line) AS cut FROM q WHERE line > held GROUP BY doc_id, text)
SELECT l.doc_id,
       CASE WHEN c.cut IS NULL THEN l.text ELSE
         coalesce(array_to_string(list_filter(l.x, lambda v, i: NOT list_contains(c.cut, i)), chr(10)), '') END AS text,
       coalesce(len(c.cut), 0)::BIGINT AS n_cut
FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.text = c.text
"""
