"""The near-dedup stage links all texts that are alike, not only those that MinHash brings together."""

import random

import numpy as np

from quarry.llm import alike, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)


def shingles(text):
    return alike.shingle_set(list(alike.digests(text.encode(), 5)))


def edited_copies(seed, n, words=404, changes=8):
    """A text, and copies of it that each have other words changed: 0.8 alike to it, hardly 0.7 to each other."""
    r = random.Random(seed)
    original = [f"w{r.randrange(50000)}" for _ in range(words)]
    texts = [" ".join(original)]
    for i in range(n):
        copy = list(original)
        for at in r.sample(range(0, words - 4, 10), changes):
            copy[at + 4] = f"x{seed}-{i}-{at}"
        texts.append(" ".join(copy))
    return texts


def test_every_edited_copy_of_one_original_is_linked(spark):
    texts = edited_copies(1, 3000)
    sets = [shingles(t) for t in texts]
    assert all(10 * np.intersect1d(sets[0], x).size >= 8 * np.union1d(sets[0], x).size for x in sets[1:])
    got = simhash.alike_groups(documents(spark, texts)).collect()
    assert len(got) == len(texts) and {r.component_id for r in got} == {0}


def test_pairs_whose_sketches_hardly_agree_are_linked(spark, monkeypatch):
    monkeypatch.setattr(alike, "AGREE", alike.MINIMA + 1)
    got = simhash.alike_groups(documents(spark, edited_copies(2, 1))).collect()
    assert [r.component_id for r in got] == [0, 0]
