"""URL filters: path rules first, gradient-boosted trees on lexical features for the rest.

Features of a URL: length, depth, digit ratio, character entropy, number of parameters, host labels and
statistics of its suffix. The trees are fitted on URLs labelled by a verdict, on at most `sample` of them
(smallest hashes of the URL first, a documented bound), and then judge every URL. The blocked share of a
suffix, one of the features, is taken out of fold while the trees are fitted: a URL's own half of the
sample has no part in it. Everything runs as DataFrame functions and Spark's own tree ensemble; no Python
runs on the executors.

Defined results: a null URL or one without :// has an empty host and path and no rule; no rule fits an
empty host. With labels of one class only, or none, every URL gets that class (allow if none). No rows give
no rows; repeated rows and clashing column names change nothing: only page_id and url are read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

#: The queries' rules: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
SAMPLE = 20_000
FEATURES = ["url_length", "depth", "digit_ratio", "entropy", "n_params", "n_labels", "host_length", "hyphens", "suffix_share", "suffix_length"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.lit(2**31 - 1))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list = RULES) -> tuple[Column, Column]:
    """The rule (host and path) that fits, the longest one, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, prefix, says in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(prefix)
        name, verdict = F.when(fits, F.lit(own + prefix)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Bits per character, from the runs of the sorted characters."""
    n = F.length(text)

    def of(chars: Column) -> Column:
        ends = F.filter(F.transform(chars, lambda c, i: F.when(~c.eqNullSafe(F.get(chars, i + 1)), i + 1)), lambda x: x.isNotNull())
        runs = let(ends, lambda e: F.transform(e, lambda x, i: (x - F.when(i > 0, F.get(e, i - 1)).otherwise(F.lit(0))).cast("double")))
        return F.aggregate(runs, F.lit(0.0), lambda a, x: a - x / n * F.log2(x / n))

    return F.when(n > 0, let(F.sort_array(F.filter(F.split(text, ""), lambda c: c != "")), of)).otherwise(F.lit(0.0))


def features(urls: DataFrame, shares: list[dict[str, float]]) -> DataFrame:
    """Adds host, path and the lexical features; shares: the blocked share of labelled URLs by suffix, one for each value of the column fold if there is more than one."""
    host, path = host_and_path(F.col("url"))
    base = urls.withColumns({"host": host, "path": path, "_u": F.coalesce("url", F.lit(""))})
    n = F.greatest(F.length("_u"), F.lit(1))
    query = F.regexp_extract("_u", r"\?([^#]*)", 1)
    suffix = F.substring_index("host", ".", -1)
    of = lambda own: F.create_map(*[F.lit(x) for pair in own.items() for x in pair])[suffix] if own else F.lit(None).cast("double")
    known = of(shares[0]) if len(shares) == 1 else F.coalesce(*[F.when(F.col("fold") == i, of(own)) for i, own in enumerate(shares)])
    made = {
        "url_length": F.length("_u"), "depth": F.regexp_count("path", F.lit("/[^/]")), "digit_ratio": F.regexp_count("_u", F.lit("[0-9]")) / n, "entropy": _entropy(F.col("_u")),
        "n_params": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1), "n_labels": F.regexp_count("host", F.lit("[^.]+")), "host_length": F.length("host"),
        "hyphens": F.regexp_count("host", F.lit("-")), "suffix_share": F.coalesce(known, F.lit(0.5)), "suffix_length": F.length(suffix),
    }
    return base.withColumns({k: v.cast("double") for k, v in made.items()}).drop("_u")


class UrlFilter:
    """Trees fitted on labelled URLs (columns url, verdict)."""

    def __init__(self, labelled: DataFrame, sample: int = SAMPLE, rounds: int = 10, depth: int = 4, seed: int = 7):
        own = labelled.where("verdict IN ('allow', 'block')").select("url", "verdict").orderBy(F.xxhash64("url"), "url", "verdict").limit(sample)
        rows = own.select("url", (F.col("verdict") == "block").cast("double").alias("label"), F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(2)).alias("fold")).persist()
        try:
            found = rows.agg(F.avg("label")).first()[0]
            self.constant = "allow" if found in (None, 0.0) else "block" if found == 1.0 else None
            self.shares, self.model = [self._shares(rows)], None
            if self.constant is None:
                apart = [self._shares(rows.where(F.col("fold") != i)) for i in range(2)]
                self.model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, featuresCol="_f", labelCol="label").fit(self._vectors(features(rows, apart)).coalesce(4))
        finally:
            rows.unpersist()

    @staticmethod
    def _shares(rows: DataFrame) -> dict[str, float]:
        """The blocked share of the most frequent suffixes, 200 at most, of 5 URLs at least."""
        host, _ = host_and_path(F.col("url"))
        by = rows.groupBy(F.substring_index(host, ".", -1).alias("suffix")).agg(F.avg("label").alias("share"), F.count("*").alias("n")).where("n >= 5").orderBy(F.desc("n"), "suffix").limit(200).collect()
        return {r["suffix"]: r["share"] for r in by}

    @staticmethod
    def _vectors(rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=FEATURES, outputCol="_f").transform(rows)

    def judge(self, urls: DataFrame) -> DataFrame:
        """Adds host, path and model_verdict; columns of these names are replaced."""
        made = features(urls.select("url", F.struct("*").alias("_row")), self.shares)
        if self.model is None:
            said = made.withColumn("prediction", F.lit(float(self.constant == "block")))
        else:
            said = self.model.transform(self._vectors(made))
        verdict = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
        own = [F.col(f"_row.{c}") for c in urls.columns if c not in ("host", "path", "model_verdict")]
        return said.select(*own, "host", "path", verdict.alias("model_verdict"))


def held_out_accuracy(labelled: DataFrame, **options) -> float | None:
    """The share of URLs judged as labelled among the fifth of them, by hash, that the trees were not fitted on; null if it is empty."""
    apart = F.pmod(F.xxhash64("url", F.lit("held out")), F.lit(5)) == 0
    model = UrlFilter(labelled.where(~apart), **options)
    right = (F.col("model_verdict") == F.col("verdict")).cast("double")
    return model.judge(labelled.where(apart).select("url", "verdict")).agg(F.avg(right)).first()[0]


def with_rules(urls: DataFrame, rules: list = RULES) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_of(host, path, rules)
    return urls.select("page_id", "url", rule.alias("rule"), verdict.alias("rule_verdict"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_rules(table(spark, sf_dir, "pages"))
    model = UrlFilter(pages.where("rule IS NOT NULL").select("url", F.col("rule_verdict").alias("verdict")))
    return model.judge(pages).select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "model_verdict").alias("verdict"))
