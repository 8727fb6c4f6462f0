"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Base figures are whole-text counts; RULES bounds ratios of them. A document is kept if the base rules
and every rule of the table hold.

Defined results: a null text counts as empty; a text without words fails the base rules, so no ratio is
taken over nothing. Repeated rows are judged each on its own; other columns pass through unless they
bear the name of a figure, which replaces them; no rows give no rows. Texts of any length are judged whole:
repeated windows are found by sorting their hashes within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, SPACES, WORD, count_words, let, table

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\f\r"
NGRAM = 5

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = """
the of and to in is it that was for on with as at by be this are or an have from not
le la les de des du un une et est en dans que qui pour sur pas au avec
der die das und ist in den von zu mit sich des auf dem ein eine nicht im
el los las del y es por con para una lo se al como
""".split()

#: name, figure as SQL over the base figures, least, most (None: open). Ratios of words unless said otherwise.
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("mean_word_length", "word_chars / n_words", 1.5, 15.0),
    ("symbols", "n_symbols / n_words", None, 0.2),
    ("exclamations", "n_exclaims / n_words", None, 0.4),
    ("stutters", "n_stutters / n_words", None, 0.2),
    ("stop_words", "CASE WHEN n_words >= 50 THEN n_stops / n_words ELSE 1 END", 0.01, None),
    ("repeated_lines", "n_dup_lines / n_lines", None, 0.7),
]


def _repeat_words(hashes: Column) -> Column:
    """How many words, given by their hashes, stand in windows of NGRAM words that occur twice or more."""

    def covered(grams: Column) -> Column:
        def places(order: Column) -> Column:
            same = lambda x, i: F.coalesce(F.get(order, i)["h"] == x["h"], F.lit(False))
            twice = F.filter(order, lambda x, i: same(x, i - 1) | same(x, i + 1))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(NGRAM), F.coalesce(F.get(p, i + 1) - x, F.lit(NGRAM))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda order: let(places(order), total))

    def windows(h: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(h) - NGRAM), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(NGRAM)]))
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0)))

    return F.when(F.size(hashes) > NGRAM, windows(hashes)).otherwise(F.lit(0))


def _stutters(hashes: Column) -> Column:
    """How many words equal the one before them."""
    return F.size(F.filter(hashes, lambda h, i: F.coalesce(h == F.get(hashes, i - 1), F.lit(False))))


FIGURES = ["n_words", "word_chars", "n_symbols", "n_exclaims", "n_lines", "n_dup_lines", "n_repeat_words", "n_stops", "n_stutters"]


def figures(docs: DataFrame) -> DataFrame:
    """Adds the base figures of the whole text, in place of columns of their names."""
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c not in FIGURES]
    return _counted(rows, F.col("_text")).select(*own, *[F.col(c).cast("long").alias(c) for c in FIGURES])


def _counted(rows: DataFrame, text: Column) -> DataFrame:
    words = F.filter(F.split(text, SPACES, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    length = F.length(text)
    without = lambda chars: F.length(F.translate(text, chars, ""))

    def of_words(own: Column) -> Column:
        stops = F.size(F.filter(own, lambda w: F.lower(w).isin(STOP_WORDS)))
        return let(F.transform(own, lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).alias("n"), _repeat_words(h).alias("repeats"), stops.alias("stops"), _stutters(h).alias("stutters")))

    per_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")))
    held = rows.withColumns({"_words": let(words, of_words), "_lines": per_lines, "_length": length})
    made = {
        "n_words": F.col("_words.n"), "word_chars": without(WHITE), "n_symbols": F.col("_length") - without(SYMBOLS), "n_exclaims": F.col("_length") - without("!"), "n_lines": F.col("_lines.n"),
        "n_dup_lines": F.col("_lines.n") - F.col("_lines.distinct"), "n_repeat_words": F.col("_words.repeats"), "n_stops": F.col("_words.stops"), "n_stutters": F.col("_words.stutters"),
    }
    return held.select("_row", *[v.alias(k) for k, v in made.items()])


def judged(docs: DataFrame, rules: list = RULES) -> DataFrame:
    """Adds figures, base_failed and kept, in place of columns of their names."""
    verdict = F.lit(True)
    for _, figure, least, most in rules:
        value = F.expr(figure)
        if least is not None:
            verdict &= value >= F.lit(least)
        if most is not None:
            verdict &= value <= F.lit(most)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return figures(docs).withColumn("base_failed", failed).withColumn("kept", F.when(failed, F.lit(False)).otherwise(verdict))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*COLUMNS)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept. The place in the condition ties it above the projection: pushed below, the filter
    would work every figure out again each time the condition names it."""
    placed = judged(docs.select(*DOCUMENT_COLUMNS)).withColumn("_place", F.monotonically_increasing_id())
    return placed.where("kept AND _place >= 0").select(*DOCUMENT_COLUMNS)


def _rules_sql(rules: list = RULES) -> str:
    parts = []
    for _, figure, least, most in rules:
        parts += [f"({figure}) >= {least}"] if least is not None else []
        parts += [f"({figure}) <= {most}"] if most is not None else []
    return " AND ".join(parts)


_WORD_SQL = r"[^\x20\x09-\x0D]+"
_STOPS_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS (
  SELECT doc_id, text, regexp_extract_all(text, '{_WORD_SQL}') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD_SQL}')) AS lines
  FROM d),
grams AS (
  SELECT doc_id, g, i FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) AS g,
           unnest(range(1, len(w) - 3)) AS i
    FROM base WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
cover AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
f AS (
  SELECT b.doc_id, len(w)::BIGINT AS n_words, length(translate(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
         (length(text) - length(translate(text, '!', '')))::BIGINT AS n_exclaims,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({_STOPS_SQL})))::BIGINT AS n_stops,
         len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1]))::BIGINT AS n_stutters
  FROM base b LEFT JOIN cover c ON b.doc_id = c.doc_id),
j AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CASE WHEN base_failed THEN false ELSE {_rules_sql()} END AS kept
FROM j
"""
