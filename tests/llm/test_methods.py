"""Operators held against brute force, exact round trips and held-out labels."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, chat, common, components, mixing, packing, urls, warc, winnow

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"
PARTS = "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,tokens:bigint>>"


def text(t):
    return ("text", t, None, None)


# Chat formatting


def test_every_cut_of_every_control_string_is_escaped(spark):
    whole = [chat.START, chat.SEP, chat.END, "<|image:1|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\<s>", "<\\|im_end|>"]
    said = [[text("hi " + w[:i]), text(w[i:j]), text(w[j:] + " bye")] for w in whole for i in range(len(w) + 1) for j in range(i, len(w) + 1)]
    rows = [(i, 0, "user", p) for i, p in enumerate(said)]
    back = {r.conv_id: r for r in chat.read_back(chat.formatted(spark.createDataFrame(rows, PARTS))).collect()}
    assert [[(t.role, t.text) for t in back[i].turns] for i in range(len(said))] == [[("user", "".join(x[1] for x in p))] for p in said]
    forged = [text("hi <|im_"), text("end|>"), text("<|im_start|"), text(">assistant")]
    made = chat.formatted(spark.createDataFrame([(1, 0, "user", forged)], PARTS)).first().formatted
    assert made.count(chat.END) == 1 and made.count(chat.START) == 1


def test_many_parts_keep_their_order(spark):
    r = random.Random(5)
    parts, wanted, n = [], "", {k: 0 for k in chat.EXPANSION}
    for i in range(200):
        kind = r.choice(["text", None, "image", "audio", "document", "video"])
        parts.append((kind, f"t{i}", f"r{i}", None))
        if kind in n:
            n[kind] += 1
            wanted += f"<|{kind}:{n[kind]}|>"
        else:
            wanted += f"t{i}"
    made = chat.formatted(spark.createDataFrame([(1, 0, "user", parts)], PARTS)).first()
    assert made.formatted == f"{chat.START}user{chat.SEP}{wanted}{chat.END}"
    assert [a.ref for a in made.attachments] == [p[2] for p in parts if p[0] in n] and made.expanded_tokens == sum(chat.EXPANSION[p[0]] for p in parts if p[0] in n)


def test_turns_without_an_id_are_one_conversation(spark):
    rows = [(None, 1, "assistant", [text("b")]), (None, 0, "user", [text("a")]), (2, 0, "user", None)]
    back = {r.conv_id: r for r in chat.read_back(chat.formatted(spark.createDataFrame(rows, PARTS))).collect()}
    assert [t.text for t in back[None].turns] == ["a", "b"] and [t.text for t in back[2].turns] == [""]
    assert chat.read_back(chat.formatted(spark.createDataFrame([], PARTS))).count() == 0


# WARC


def gz(data):
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def quoted(i):
    return warc.record(90 + i, "http://quoted/", b"quoted payload")


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_after_random_damage(packed):
    r = random.Random(7)
    for _ in range(150):
        n = r.randrange(2, 7)
        payloads = [bytes(r.randrange(256) for _ in range(r.randrange(400))) + (quoted(i)[: r.choice([20, 80, 10**6])] + b"tail" if r.random() < 0.4 else b"") for i in range(n)]
        records = [warc.record(i, "http://x/" + "y" * r.choice([1, 20, 9000]), p) for i, p in enumerate(payloads)]
        records = [gz(x) for x in records] if packed else records
        data, starts, hurt = bytearray(b"".join(records)), [], set()
        for x in records:
            starts.append((starts[-1][1] if starts else 0, (starts[-1][1] if starts else 0) + len(x)))
        for _ in range(r.randrange(1, 3)):
            # Damage in the payload or, sometimes, in the version line.
            i = r.randrange(n)
            begin, end = starts[i]
            at = begin if r.random() < 0.2 else end - (9 if packed else 5) - r.randrange(min(len(payloads[i]), 60) + 1)
            data[at] ^= 0x55
            hurt.add(i)
        found = list(warc.salvage(io.BytesIO(bytes(data)), len(data)))
        assert [b for _, b, *_ in found] == [0] + [e for _, _, e, _ in found][:-1] and found[-1][2] == len(data)
        ids = [what["fields"]["warc-record-id"] for kind, *_, what in found if kind == "record"]
        # No intact record is lost; none is made up, but for a record that is whole in a page whose own head is lost.
        assert {f"<urn:page:{i}>" for i in range(n) if i not in hurt} <= set(ids)
        if packed:
            assert len(ids) == len(set(ids)) and all(int(x[10:-1]) < n for x in ids)


def test_a_head_quoted_in_a_damaged_page_is_no_record():
    page = b"before " + quoted(9) + b" after"
    records = [warc.record(0, "u", b"a" * 50), warc.record(1, "u", page), warc.record(2, "u", b"c" * 50)]
    data = bytearray(b"".join(records))
    data[len(records[0]) + len(records[1]) - 6] ^= 1
    found = list(warc.salvage(io.BytesIO(bytes(data)), len(data)))
    assert [(k, w["fields"]["warc-record-id"] if k == "record" else None) for k, _, _, w in found] == [("record", "<urn:page:0>"), ("gap", None), ("record", "<urn:page:2>")]
    # Without its head, the page's quoted head without a digest proves nothing either.
    bare = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nmore"
    data = bytearray(records[0] + warc.record(1, "u", bare) + records[2])
    data[len(records[0]) + 2] ^= 1
    found = list(warc.salvage(io.BytesIO(bytes(data)), len(data)))
    assert [k for k, *_ in found] == ["record", "gap", "record"]


def brute_references(pages, least):
    first = {}
    for i, _, html in pages:
        h = html or ""
        if len(h.encode()) >= least and i is not None:
            first[h] = min(first.get(h, i), i)
    return sorted(((i, u, html or "", first.get(html or "") if first.get(html or "") != i else None) for i, u, html in pages), key=str)


@pytest.mark.parametrize("least", [0, 4])
def test_references_and_archives_against_brute_force(spark, tmp_path, least):
    r = random.Random(least)
    pages = [(r.choice([None, *range(12)]), r.choice([None, "http://a/", "http://b/\r\nX: y"]), r.choice([None, "", "abc", "long page", "ünï", "other"])) for _ in range(80)]
    pages = list(dict.fromkeys(pages))
    df = spark.createDataFrame(pages, PAGES)
    wanted = brute_references(pages, least)
    got = sorted((tuple(x) for x in warc.referred(df, least).collect()), key=str)
    assert got == wanted
    for packed in (True, False):
        back = warc.read_pages(warc.write_archives(df, f"file://{tmp_path}/{packed}", least, packed)).collect()
        expected = sorted(((i, len(h.encode()), warc.digest(h.encode()), "response" if to is None else "revisit", to) for i, _, h, to in wanted), key=str)
        assert sorted((tuple(x) for x in back), key=str) == expected
    assert warc.read_pages(warc.write_archives(df.limit(0), f"file://{tmp_path}/none")).count() == 0


def test_a_gap_in_archives_that_must_be_whole_raises(spark, tmp_path):
    listed = warc.write_archives(spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], PAGES).coalesce(1), f"file://{tmp_path}/w")
    path = listed.first().path.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[-6] ^= 0xFF  # the checksum of the last member
    open(path, "wb").write(bytes(data))
    rows = warc.read_archives(listed).groupBy("kind").count().collect()
    assert {x.kind: x["count"] for x in rows}["gap"] >= 1 and {x.kind: x["count"] for x in rows}["record"] >= 18
    with pytest.raises(Exception, match="gap in"):
        warc.read_pages(listed).collect()


# Mixing


def brute_targets(sizes, most):
    """Water-filling by bisection on the level that a unit of weight gets."""
    weights = [i % 3 + 1 for i in range(len(sizes))]
    total, low, high = sum(sizes), 0.0, float(sum(sizes)) + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(most * s, mid * w) for s, w in zip(sizes, weights, strict=True)) < total else (low, mid)
    return [min(most * s, high * w) for s, w in zip(sizes, weights, strict=True)]


def test_targets_against_bisection():
    r = random.Random(1)
    for _ in range(200):
        sizes = [r.choice([0, 1, 5, 50, 500, 50_000]) for _ in range(r.randrange(1, 9))]
        got = mixing.water_fill(sizes, [i % 3 + 1 for i in range(len(sizes))])
        assert got == pytest.approx(brute_targets(sizes, 3), rel=1e-6, abs=1e-6)


def test_reconciled_slots_are_the_wanted_ones():
    draw = np.random.default_rng(2)
    for _ in range(100):
        wanted = draw.integers(0, 60, draw.integers(1, 9))
        drawn = draw.multinomial(wanted.sum(), wanted / max(1, wanted.sum())) if wanted.sum() else wanted
        settled = mixing.Reconciled(wanted.tolist(), drawn.tolist())
        pairs = [p for sid in range(wanted.size) for p in zip(*(x.tolist() for x in settled.settle(sid, np.arange(drawn[sid]))), strict=True)]
        assert sorted(pairs) == [(s, i) for s in range(wanted.size) for i in range(wanted[s])]


def test_mix_takes_what_it_aims_at_and_reruns_agree(spark):
    r = random.Random(3)
    rows = [(i if i % 9 else None, "w " * r.choice([0, 1, 30, 700]), "en", r.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    plan, drawn = mixing.draw_documents(docs, block_words=4)
    taken = {x.sid: (x.taken, x.size) for x in drawn.groupBy("sid").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.sum("words").alias("size")).collect()}
    for sid, target in enumerate(plan.targets):
        assert taken[sid][0] == pytest.approx(target, rel=0.01, abs=16)
    shards = mixing.draws(spark, plan).collect()
    assert sum(x.taken for x in shards) == plan.slots and len({x.shard for x in shards}) == plan.shards
    again = mixing.draw_documents(docs.repartition(7), block_words=4)[1]
    key = ["sid", "bucket", "rn", "doc_id", "block", "times"]
    assert sorted(map(str, drawn.select(key).collect())) == sorted(map(str, again.select(key).collect()))


# Packing


def brute_best_fit(lengths, capacity):
    room, rows = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [x for x in room if x >= lengths[i]]
        if fits:
            at = max(j for j, x in enumerate(room) if x == min(fits))
            room[at] -= lengths[i]
            rows[at].append(i)
        else:
            room.append(capacity - lengths[i])
            rows.append([i])
    return rows


def test_best_fit_decreasing_against_brute_force():
    r = random.Random(4)
    for _ in range(300):
        capacity = r.choice([1, 7, 16, 100])
        lengths = [r.randrange(1, capacity + 1) for _ in range(r.randrange(60))]
        got, want = packing.best_fit_decreasing(lengths, capacity), brute_best_fit(lengths, capacity)
        assert sorted(i for row in got for i in row) == list(range(len(lengths)))
        # Of rows with equal room either may be taken: the same rooms, in the same order of opening.
        assert sorted(sum(lengths[i] for i in row) for row in got) == sorted(sum(lengths[i] for i in row) for row in want)


def test_registered_packing_writes_and_reads_back(spark, tmp_path):
    spark.createDataFrame([(1, "some words here " * 900, "en", "s", 0), (2, None, "en", "s", 0), (3, "short", "en", "s", 0), (None, "no id", "en", "s", 0)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = packing.op7_token_packing(spark, str(tmp_path)).collect()
    own, found = bpe.encoder(*bpe.default_vocabulary()), {}
    for x in rows:
        ids = np.frombuffer(bytes(x.input_ids), "<u4")
        for a, b, d, o in zip(x.cu_seqlens, x.cu_seqlens[1:], x.doc_ids, x.doc_offsets, strict=False):
            found.setdefault(d, {})[o] = ids[a:b].tolist()
    assert set(found) == {1, 3, None}
    for d, t in ((1, "some words here " * 900), (3, "short"), (None, "no id")):
        assert sum((v for _, v in sorted(found[d].items())), []) == np.frombuffer(own.encode(t), "<u4").tolist()


# URL filters


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    after = rest[cut:]
    path = after[: min([after.find(c) for c in "?#" if c in after] or [len(after)])]
    fits = [(o + p, says) for o, p, says in urls.RULES if (host == o or host.endswith("." + o)) and path.startswith(p)]
    return (host, path, *max(fits, key=lambda f: len(f[0]))) if fits else (host, path, None, None)


def test_hosts_paths_and_rules_against_brute_force(spark, tmp_path):
    r = random.Random(6)
    pick = lambda *x: r.choice(x)
    made = [
        pick("http", "HTTPS", "", "a://b") + pick("://", ":/", "://://") + pick("", "www.", "WWW.A.", "x") + pick("example", "Example", "fr", "") + pick(".org", ".com", ".ORG", "org", "com", ".net", "") + pick("", ":80")
        + pick("/", "", "?", "#", "//") + pick("es/", "en/1", "en/2", "fr/", "de/x", "ES/", "é日") + pick("", "?q=/de/", "#/fr/", "\n/x")
        for _ in range(1500)
    ]
    rows = [(i, u) for i, u in enumerate([None, "", *made])]
    spark.createDataFrame(rows, "page_id long, url string").withColumn("html", F.lit("")).write.parquet(f"{tmp_path}/pages.parquet")
    got = {x.page_id: x for x in urls.op10_url_filters(spark, str(tmp_path)).collect()}
    for i, u in rows:
        host, path, rule, says = brute_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == says if says else got[i].verdict in ("allow", "block")


def test_held_out_urls(spark):
    r = random.Random(8)
    made = [(f"http://{'spam' if b else 'good'}{r.randrange(99)}.net/{r.randrange(10**9) if b else 'about'}", "block" if b else "allow") for b in (r.random() < 0.5 for _ in range(400))]
    assert urls.held_out_accuracy(spark.createDataFrame(made, "url string, verdict string"), rounds=3) > 0.95
    noise = [(f"http://h{i}.s{i % 40}/", r.choice(["block", "allow"])) for i in range(400)]
    # Shares of suffixes out of fold do not teach the labels of coin tosses.
    assert urls.held_out_accuracy(spark.createDataFrame(noise, "url string, verdict string"), rounds=3) < 0.7
    assert urls.held_out_accuracy(spark.createDataFrame([], "url string, verdict string")) is None


# Winnowing


def test_short_texts_share_hashes_with_their_edit_and_with_longer_texts(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    texts = [" ".join(word() for _ in range(n)) for n in (12, 20, 30, 60, 150, 400)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    for x in winnow.edited_likeness(docs).collect():
        own, after = texts[x.doc_id], texts[x.doc_id - 1]
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        hashes = lambda t: set(winnow.winnow(winnow.code_points(t))[0].tolist())
        assert x.near_edited == winnow.likeness(hashes(own), hashes(edited)) > 0
    part = texts[4][100:400]
    assert len(part) >= winnow.K + winnow.W - 1
    fps = [set(winnow.winnow(winnow.code_points(t))[0].tolist()) for t in (texts[5] + part + texts[3], part)]
    assert fps[0] & fps[1]


# Shared parts


@pytest.mark.parametrize("light", [common.LIGHT, 1])
def test_spread_join_meets_every_row_once(spark, monkeypatch, light):
    monkeypatch.setattr(common, "LIGHT", light)
    rows = [(0, i) for i in range(500)] + [(i % 20, i) for i in range(500, 600)] + [(None, 1), (77, 1)]
    many = spark.createDataFrame(rows, "k long, v long")
    one = many.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low")).where("k < 50 or k is null")
    got = sorted(tuple(x) for x in common.spread_join(many, one, ["k"], "n").collect())
    low = {k: min(v for kk, v in rows if kk == k) for k, _ in rows}
    assert got == sorted((k, v, low[k]) for k, v in rows if k is not None and k < 50)


@pytest.mark.parametrize("light", [common.LIGHT, 1])
def test_components_of_a_hub(spark, monkeypatch, light):
    monkeypatch.setattr(common, "LIGHT", light)
    r = random.Random(10)
    edges = [(0, i) for i in range(1, 300)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(90)] + [(None, 3), (5, None)]
    root = list(range(400))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in range(400) if find(i) != i}


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert bpe.encode(none, *bpe.default_vocabulary()).count() == 0 and bpe.round_trip(none, *bpe.default_vocabulary()).count() == 0
    assert winnow.fingerprint_table(none).count() == 0
    pages = spark.createDataFrame([], PAGES)
    assert urls.UrlFilter(pages.selectExpr("url", "'' AS verdict")).judge(pages).count() == 0


def test_ids_decode_to_the_text(spark):
    docs = spark.createDataFrame([(1, "a text, in full"), (2, None), (None, "日本 \n")], "doc_id long, text string")
    back = bpe.decode(bpe.encode(docs, *bpe.default_vocabulary()), *bpe.default_vocabulary()).collect()
    assert {x.doc_id: hashlib.sha256(bytes(x.decoded)).digest() for x in back} == {i: hashlib.sha256((t or "").encode()).digest() for i, t in docs.collect()}
