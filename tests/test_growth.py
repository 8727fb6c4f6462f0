"""Costly steps are dealt to all cores and do not grow faster than their input."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import match, tfidf
from quarry.plans import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["parse_jobs", "parse_resumes"])
def test_a_table_of_one_row_group_is_parsed_by_all_cores(spark, name):
    made = queries.QUERIES[name](spark, SMALL)
    held = made.groupBy(F.spark_partition_id()).count().count()
    assert held >= spark.sparkContext.defaultParallelism and made.count() == 200


def test_title_case_takes_time_by_length(spark):
    own = "o'neil 𐐨𐐩 éa-1x " * 2000
    began = time.time()
    assert spark.createDataFrame([(own,)], "t string").select(text.title_case(F.col("t"))).first()[0] == "O'Neil 𐐀𐐩 Éa-1X " * 2000
    assert time.time() - began < 15


@pytest.mark.parametrize("inflated", [False, True])
def test_vocabulary_counts_only_terms_that_can_be_in_it(spark, monkeypatch, inflated):
    """Rare terms are left out before anything is shuffled; where buckets of rare terms seem frequent, a second count settles it."""
    r = random.Random(1)
    common = [f"w{i}" for i in range(30)]
    texts = [" ".join(r.choice(common) if r.random() < 0.5 else f"É{r.random()}x{i}" for _ in range(40)) for i in range(200)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    tf, df = Counter(), Counter()
    for t in texts:
        tf.update(own := tfidf.terms(t))
        df.update(set(own))
    asked, count, bucket = [], tfidf.term_counts, tfidf.bucket_counts
    monkeypatch.setattr(tfidf, "term_counts", lambda *a: asked.append(count(*a)) or asked[-1])
    counts = bucket(docs)
    assert counts.sum() == tf.total()
    if inflated:
        counts[np.argsort(counts, kind="stable")[:100]] += 10**6
        monkeypatch.setattr(tfidf, "bucket_counts", lambda *a: counts)
    model = tfidf.TfidfModel.fit(docs, max_features=40)
    best = sorted(sorted(tf, key=lambda t: (-tf[t], t))[:40])
    assert model.terms == best and model.tf == [tf[t] for t in best] and model.df == [df[t] for t in best] and model.n_docs == len(texts)
    assert len(asked) == 1 + inflated and (inflated or asked[0].count() < len(tf) / 10)


def test_words_are_cut_for_many_texts_at_once(monkeypatch):
    """The same words, terms and counts as text by text."""
    r = random.Random(2)
    odd = [None, "", ".", "a", "the", "A B", "é", "日本 東京x", "ﬁne ßtraße Ünïcode 日", "𝐀𝐁c K", "x\x00yz\x85ab\xa0cd", "²³ ½a ١٢", "_ __ a_b", "ǅ ǆab‍cd", "\U0001f600ab", "the ab of cd", "x" * 200000 + " " + "y" * 70000 + " zz"]
    odd += ["".join(r.choice("aé日 .́İıſ̈ßK_9²٣\n") for _ in range(50)) for _ in range(500)]
    plain = [" ".join(r.choice(["tax", "the", "q"]) if r.random() < 0.3 else f"w{r.randrange(10**5)}" for _ in range(300)) for _ in range(1500)]
    batch = lambda texts: iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])])
    found = []
    for piece in tfidf._read(batch(odd)):
        own = [[] for _ in range(piece.n)]
        for w, at in zip(piece.strings.to_pylist(), piece.of.tolist(), strict=True):
            own[at].append(w)
        found += own
    assert found == [tfidf.words(t) for t in odd]
    monkeypatch.setattr(tfidf, "_words", None)  # no text's words are looked for by themselves
    pieces = list(tfidf._read(batch(plain)))
    names, found_df, found_tf = tfidf._added([x.counts() for x in pieces])
    buckets = sum(np.bincount(x.buckets(), minlength=tfidf.BUCKETS) for x in pieces)
    monkeypatch.undo()
    tf, df = Counter(), Counter()
    for t in plain:
        own = tfidf.terms(t)
        tf.update(own)
        df.update(set(own))
    names = names.to_pylist()
    assert dict(zip(names, found_tf.tolist(), strict=True)) == tf and dict(zip(names, found_df.tolist(), strict=True)) == df and buckets.sum() == tf.total()


def test_documents_of_one_row_group_are_dealt_though_the_file_has_many_parts(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        table = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
        assert table.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        dealt = queries._dealt(table, "doc_id")
        assert dealt.groupBy(F.spark_partition_id()).count().count() >= spark.sparkContext.defaultParallelism and dealt.count() == table.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("name", ["best_evidence", "score_pairs"])
def test_evidence_is_matched_within_a_candidates_row(spark, name):
    """Neither sorted for an aggregate nor exploded into rows that meet again; no work for the one task that reads the table."""
    made = queries.QUERIES[name](spark, SMALL)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and "collect_list" not in plan
    parts = made.rdd.glom().map(len).filter(bool).count()
    assert name == "score_pairs" or parts >= spark.sparkContext.defaultParallelism  # 200 pairs are too few to stay apart after a shuffle


def test_pairs_and_candidates_meet_in_tasks_of_bounded_rows(spark, monkeypatch):
    """Rather than in as many tasks as there are shuffle partitions; no task that reads the table holds all ids."""
    order = lambda made: sorted(map(tuple, made.collect()))
    before = order(queries.QUERIES["score_pairs"](spark, SMALL))
    monkeypatch.setattr(match, "TASK_ROWS", 10, raising=False)
    monkeypatch.setattr(match, "LEAST_ROWS", 1, raising=False)
    made = queries.QUERIES["score_pairs"](spark, SMALL)
    held = made.rdd.glom().map(len).collect()
    assert sum(held) == 200 and max(held) <= 25 and "HashAggregate" not in made._jdf.queryExecution().executedPlan().toString()
    assert order(made) == before


def test_a_candidate_of_several_pairs_is_scored_for_each(spark, monkeypatch):
    monkeypatch.setattr(match, "TASK_ROWS", 10, raising=False)
    monkeypatch.setattr(match, "LEAST_ROWS", 1, raising=False)
    jobs, people = queries._jobs(spark, SMALL), queries._people(spark, SMALL)
    pairs = spark.createDataFrame([(f"n{j}", f"p{c}", 0.5, j) for j in range(3) for c in (1, 2, 10**9)] + [("none", "p1", 0.5, 1)], "job_id string, candidate_id string, retrieval_score double, retrieval_rank int")
    made = [match.score_pairs(pairs, jobs, people, queries._concepts(), fuzzy=False, rows=rows).select("job_id", "candidate_id", "final_score") for rows in (None, 200)]
    held = [sorted(map(tuple, m.collect())) for m in made]
    assert held[0] == held[1] and [h[:2] for h in held[0]] == sorted((f"n{j}", f"p{c}") for j in range(3) for c in (1, 2))
