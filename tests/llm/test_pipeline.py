"""The whole pipeline over a small table, held against plain Python stage by stage."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np

import corpus_pipeline
from quarry.llm import bpe, mixing, quality, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    return [w for w in SPACE.split(t or "") if w]


def prose(r, n, line=8):
    own = [r.choice(["the", "of", "and", "to"]) if i % 5 == 0 else "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 9))) for i in range(n)]
    return "\n".join(" ".join(own[i : i + line]) for i in range(0, n, line))


def fixture():
    r = random.Random(11)
    texts = [prose(r, r.randrange(60, 400)) for _ in range(24)]
    license_ = "\n".join(["all rights reserved by the owners of it", "no part of this may be copied", "without the leave of the owners"])
    texts += [prose(r, 80) + "\n" + license_ + "\n" + prose(r, 80) for _ in range(4)]
    for i in (2, 5, 5):
        texts.append(texts[i])
        edited = texts[i].split(" ")
        edited[len(edited) // 2] = "changed"
        texts.append(" ".join(edited))
    texts += [None, "", "too short", "# $ % " * 30, "spam spam spam spam spam " * 20, "x y"]
    rows = [(i if i % 13 else None, t, "en", ("a", "a", "b", None)[i % 4], len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[3], (7, "another text of one id " + prose(r, 90), "en", "b", 0)]


def good(t):
    w = words(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    cover = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    if len(w) < 10 or 100 * len(cover) > 20 * len(w):
        return False
    lines = [x for x in t.split("\n") if words(x)]
    n = len(w)
    figures = {
        "n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum(c in quality.SYMBOLS for c in t), "n_exclaims": t.count("!"), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_stops": sum(x.lower() in quality.STOP_WORDS for x in w), "n_stutters": sum(a == b for a, b in zip(w, w[1:], strict=False)),
    }
    value = {name: figures["n_stops"] / n if n >= 50 else 1 for name, *_ in quality.RULES if name == "stop_words"}
    for name, figure, least, most in quality.RULES:
        x = value.get(name, None) if name in value else eval(figure, {}, figures)
        if (least is not None and x < least) or (most is not None and x > most):
            return False
    return True


def dedup_lines(rows):
    first, out = {}, []
    order = sorted({(r[0], r[1]) for r in rows}, key=lambda x: (x[0] is None, x[0] or 0))
    cuts = {}
    for name in order:
        lines, cut = (name[1] or "").split("\n"), set()
        for p in range(len(lines) - 2):
            g = tuple(lines[p : p + 3])
            if any(words(x) for x in g):
                if g in first:
                    cut |= {j for j in range(p, p + 3) if first[g][0] != name or j >= first[g][1] + 3}
                first.setdefault(g, (name, p))
        cuts[name] = "\n".join(x for i, x in enumerate(lines) if i not in cut) if cut else name[1]
    for r in rows:
        t = cuts[r[0], r[1]]
        out.append((r[0], t, r[2], r[3], r[4] if t is None else len(t)))
    return out


def representatives(rows):
    own = sorted(set(rows), key=str)
    sets, fps = [], []
    for r in own:
        w = [x.decode() for x in (r[1] or "").encode().lower().split()]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
        fps.append(simhash.fingerprint((r[1] or "").encode(), 5))
    root = list(range(len(own)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(own)), 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) or (fps[a] ^ fps[b]).bit_count() <= 3:
            root[find(a)] = find(b)
    groups = {}
    for i, r in enumerate(own):
        groups.setdefault(find(i), []).append(r)
    return list(groups.values())


def test_every_stage_against_plain_python(spark, tmp_path):
    import tiktoken

    rows = fixture()
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        found.write.parquet(at := f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(at)
        made[name] = [tuple(x) for x in docs.collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = [r for r in rows if good(r[1] or "")]
    assert sorted(made[names[0]], key=str) == sorted(kept, key=str) and 20 < len(kept) < len(rows)
    cut = dedup_lines(kept)
    assert sorted(made[names[1]], key=str) == sorted(cut, key=str) and cut != kept
    groups = representatives(cut)
    assert len(made[names[2]]) == len(groups) < len(set(cut))
    for group in groups:
        least = min((r[0] is None, r[0] or 0) for r in group)
        assert [r for r in made[names[2]] if r in group] == [r for r in made[names[2]] if r in group and (r[0] is None, r[0] or 0) == least] and sum(r in group for r in made[names[2]]) == 1
    # The mix: runs of each document's words, none more than three times, sources near their targets.
    before = {(r[0], r[3]): [] for r in made[names[2]]}
    for r in made[names[2]]:
        before[r[0], r[3]].append(words(r[1]))
    taken, sizes = {}, {}
    for r in made[names[2]]:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    for r in made[names[3]]:
        taken[r[3]] = taken.get(r[3], 0) + len(words(r[1]))
        assert any(" ".join(words(x)) in " ".join(own) for own in before[r[0], r[3]] for x in [r[1]]) or all(any(" ".join(words(x)) in " ".join(own) for own in before[r[0], r[3]]) for x in r[1].split("\n"))
        assert r[4] == len(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for source, target in zip(order, mixing.water_fill([sizes[s] for s in order], [i % 3 + 1 for i in range(len(order))]), strict=True):
        assert abs(taken.get(source, 0) - target) <= 256 + 0.05 * target
    # The ids: those of the tokenizer, and rows told apart.
    own = bpe.encoder(*bpe.default_vocabulary())
    ref = tiktoken.Encoding("ref", pat_str=bpe.default_vocabulary()[1], mergeable_ranks=own.ranks, special_tokens={})
    wanted = sorted((r[0] if r[0] is not None else -1, ref.encode_ordinary(r[1]), hashlib.sha256(r[1].encode()).hexdigest()) for r in made[names[3]])
    got = docs.collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, np.frombuffer(bytes(r.ids), "<u4").tolist(), r.decoded_sha256) for r in got) == wanted
    told = [(r.doc_id, r.epoch) for r in got if r.doc_id is not None]
    assert len(told) == len(set(told)) and all(r.n_tokens == len(r.ids) // 4 for r in got)


def test_run_is_the_stages_one_after_another(spark, tmp_path):
    spark.createDataFrame(fixture(), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    once, again = (sorted((str(r.doc_id), r.epoch, bytes(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) for _ in range(2))
    assert once == again and len(once) > 15


def test_an_empty_table_runs_through(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
