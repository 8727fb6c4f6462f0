"""TF-IDF vectors, kept sparse.

Words are found by Unicode's rules after decomposition (NFKD) has parted letters and marks, for which Spark has no
function; so texts are read in Arrow batches, and the words of many are cut at once. Most terms are pairs of words that
occur once or twice, so a first pass counts occurrences by hash alone, which bounds each term's frequency from above, and a
second one counts the terms that can be among the most frequent. The vocabulary is bounded by max_features, and with it at
hand each document's vector is made within its row.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieve import sparse_top_k

MAX_FEATURES = 4096
#: The most terms a vocabulary may have: it is held by the driver and each worker.
MOST_FEATURES = 1 << 20
#: Terms that a task adds up before it sends its counts on.
HELD_TERMS = 1 << 20
#: Bytes of texts whose words are cut at once.
PIECE = 1 << 20
#: Buckets of hashes by which occurrences are counted, and so many of them sent together.
BUCKETS, SLICE = 1 << 18, 1 << 14
#: The English stop list of the usual text analyzer.
STOP_WORDS = """
a about above across after afterwards again against all almost alone along already also although always am
among amongst amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at back
be became because become becomes becoming been before beforehand behind being below beside besides between
beyond bill both bottom but by call can cannot cant co con could couldnt cry de describe detail do done down
due during each eg eight either eleven else elsewhere empty enough etc even ever every everyone everything
everywhere except few fifteen fifty fill find fire first five for former formerly forty found four from front
full further get give go had has hasnt have he hence her here hereafter hereby herein hereupon hers herself
him himself his how however hundred i ie if in inc indeed interest into is it its itself keep last latter
latterly least less ltd made many may me meanwhile might mill mine more moreover most mostly move much must my
myself name namely neither never nevertheless next nine no nobody none noone nor not nothing now nowhere of
off often on once one only onto or other others otherwise our ours ourselves out over own part per perhaps
please put rather re same see seem seemed seeming seems serious several she should show side since sincere six
sixty so some somehow someone something sometime sometimes somewhere still such system take ten than that the
their them themselves then thence there thereafter thereby therefore therein thereupon these they thick thin
third this those though three through throughout thru thus to together too top toward towards twelve twenty
two un under until up upon us very via was we well were what whatever when whence whenever where whereafter
whereas whereby wherein whereupon wherever whether which while whither who whoever whole whom whose why will
with within without would yet you your yours yourself yourselves
""".split()


_STOPS = frozenset(STOP_WORDS)
_words = re.compile(r"\w\w+").findall


def _plain(text: str | None, blank: bool = False) -> str:
    """Lower-cased text without its accents; with blank, characters beyond ASCII that no word has become blanks."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        for c in set(text.encode().translate(None, _ASCII).decode()):
            if unicodedata.combining(c):
                text = text.replace(c, "")
            elif blank and not c.isalnum():
                text = text.replace(c, " ")
    return text


def words(text: str | None) -> list[str]:
    """Lower-cased words of two characters at least without their accents, stop words left out."""
    return [w for w in _words(_plain(text)) if w not in _STOPS]


def terms(text: str | None) -> list[str]:
    """The words, then the pairs of neighbours among them."""
    own = words(text)
    return own + [f"{a} {b}" for a, b in zip(own, own[1:], strict=False)]


class _Piece:
    """The words(text) of some texts, in order: of each its string, its hash (the same in every task) and the number of its text.

    Words are cut and told apart for all texts at once, without a Python object for any of them.
    """

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
        inside = _WORD_BYTES[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        first = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
        data, ends = data[inside], np.concatenate([[0], np.cumsum(sizes)])
        strings = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
        hashes = _hashes(data, ends)
        keep = pc.utf8_length(strings).to_numpy() > 1
        maybe = np.flatnonzero(_STOP_MARKS[hashes >> np.uint64(52)])
        keep[maybe[pc.is_in(strings.take(pa.array(maybe)), value_set=pa.array(STOP_WORDS)).to_numpy(zero_copy_only=False)]] = False
        self.n = len(texts)
        self.strings, self.hashes = strings.filter(pa.array(keep)), hashes[keep]
        self.of = np.repeat(np.arange(len(texts)), np.diff(first))[keep]
        #: Places of the words that another one of the same text follows.
        self.pairs = np.flatnonzero(self.of[1:] == self.of[:-1])

    def buckets(self) -> np.ndarray:
        """The bucket of each word, then of each pair."""
        first, second = self.hashes * np.uint64(0x9E3779B97F4A7C15), self.hashes * np.uint64(0xD6E8FEB86659FD93)
        mixed = np.concatenate([self.hashes, first[self.pairs] + second[self.pairs + 1]]) * np.uint64(0xFF51AFD7ED558CCD)
        return ((mixed ^ mixed >> np.uint64(32)) & np.uint64(BUCKETS - 1)).astype(np.int64)

    def counts(self, some: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """term, df, tf, of the words and pairs at some places of buckets(), or of all."""
        encoded = self.strings.dictionary_encode()
        word, names = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
        codes, of = np.concatenate([word, word[self.pairs] + 1 << 32 | word[self.pairs + 1]]), np.concatenate([self.of, self.of[self.pairs]])
        if some is not None:
            codes, of = codes[some], of[some]
        found = pa.array(codes).dictionary_encode()
        at, own, n = found.indices.to_numpy().astype(np.int64), found.dictionary.to_numpy(), len(found.dictionary)
        once = pc.unique(pa.array(of * n + at)).to_numpy()
        df, tf = np.bincount(once % max(1, n), minlength=n), np.bincount(at, minlength=n)
        one, two = np.flatnonzero(own < 1 << 32), np.flatnonzero(own >= 1 << 32)
        pairs = pc.binary_join_element_wise(names.take(pa.array((own[two] >> 32) - 1)), names.take(pa.array(own[two] & 0xFFFFFFFF)), " ")
        order = np.concatenate([one, two])
        return pa.concat_arrays([names.take(pa.array(own[one])), pairs]), df[order], tf[order]


#: Bytes of words; in UTF-8, those of characters beyond ASCII among them.
_WORD_BYTES = np.array([c >= 128 or chr(c).isalnum() or c == 95 for c in range(256)])
_ASCII = bytes(range(128))
#: Bytes hashed at once, of one word at most so many.
_SPAN = 1 << 16
_BASE = 0x9FB21C651E98DF25
_POWERS = np.cumprod(np.array([1] + [_BASE] * (2 * _SPAN), np.uint64))
_INVERSES = np.cumprod(np.array([1] + [pow(_BASE, -1, 1 << 64)] * (2 * _SPAN), np.uint64))


def _hashes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: its bytes as a polynomial, by sums up to its two ends."""
    made = np.empty(len(ends) - 1, np.uint64)
    cuts = np.unique(np.concatenate([np.searchsorted(ends[:-1], np.arange(0, int(ends[-1]), _SPAN)), [len(made)]]))
    for i, j in zip(cuts, cuts[1:], strict=False):
        own = ends[i : j + 1] - ends[i]
        stop = np.minimum(own[1:], own[:-1] + _SPAN)
        size = int(stop[-1])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data[ends[i] : ends[i] + size] * _POWERS[:size])])
        made[i:j] = (sums[stop] - sums[own[:-1]]) * _INVERSES[own[:-1]]
    made *= np.uint64(0xC2B2AE3D27D4EB4F)
    return made ^ made >> np.uint64(29)


def _marked_stops() -> np.ndarray:
    own = [w.encode() for w in STOP_WORDS]
    marks = np.zeros(1 << 12, bool)
    marks[_hashes(np.frombuffer(b"".join(own), np.uint8), np.cumsum([0] + [len(w) for w in own])) >> np.uint64(52)] = True
    return marks


#: Which upper bits of a hash a stop word has.
_STOP_MARKS = _marked_stops()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[_Piece]:
    """The texts of the first column, in pieces of PIECE bytes or one text."""
    for batch in batches:
        own, size = [], 0
        for value in batch.column(0).to_pylist():
            own.append(_plain(value, True).encode())
            size += len(own[-1])
            if size >= PIECE:
                yield _Piece(own)
                own, size = [], 0
        if own:
            yield _Piece(own)


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often the terms of each bucket occur, together: no term of the bucket occurs more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for piece in _read(batches):
            counts += np.bincount(piece.buckets(), minlength=BUCKETS)
        if counts.any():
            yield _sliced({at: counts[at : at + SLICE] for at in range(0, BUCKETS, SLICE)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(own, "<i8")
        yield _sliced(sums)

    schema = "at int, n binary"
    made = np.zeros(BUCKETS, np.int64)
    for row in docs.select(text).mapInArrow(run, schema).repartition(BUCKETS // SLICE, "at").mapInArrow(add, schema).collect():
        made[row["at"] : row["at"] + SLICE] = np.frombuffer(row["n"], "<i8")
    return made


def _sliced(counts: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in counts.values()], pa.binary())], ["at", "n"])


def term_counts(docs: DataFrame, text: str = "text", among: np.ndarray | None = None) -> DataFrame:
    """term, df, tf of all terms, or of those whose bucket is marked; the row of a null term has the number of documents."""
    marked = None if among is None else docs.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for piece in _read(batches):
            n += piece.n
            held.append(piece.counts(None if marked is None else np.flatnonzero(marked.value[piece.buckets()])))
            if sum(len(x[0]) for x in held) > HELD_TERMS:
                held = [_added(held)]
                if 2 * len(held[0][0]) > HELD_TERMS:
                    yield from _rows(*held.pop())
        if held:
            yield from _rows(*_added(held))
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([n], pa.int64()), pa.array([0], pa.int64())], ["term", "df", "tf"])

    return docs.select(text).mapInArrow(run, "term string, df long, tf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def _added(held: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Counts of several pieces, added up by term."""
    terms, df, tf = pa.concat_arrays([x[0] for x in held]).dictionary_encode(), np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
    made = np.zeros((2, len(terms.dictionary)), np.int64)
    np.add.at(made[0], terms.indices.to_numpy(), df)
    np.add.at(made[1], terms.indices.to_numpy(), tf)
    return terms.dictionary, made[0], made[1]


def _rows(terms: pa.Array, df: np.ndarray, tf: np.ndarray) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([terms, pa.array(df), pa.array(tf)], ["term", "df", "tf"])
    for at in range(0, len(terms), 1 << 16):
        yield whole.slice(at, 1 << 16)


class TfidfModel:
    """A fitted vocabulary: terms in order, their document and term frequencies, and the inverse document frequencies."""

    name = "tfidf-word-1-2"

    def __init__(self, terms: list[str], df: list[int], tf: list[int], n_docs: int):
        if len(terms) > MOST_FEATURES:
            raise ValueError(f"a vocabulary has {MOST_FEATURES} terms at most")
        self.terms, self.df, self.tf, self.n_docs = terms, df, tf, n_docs
        self.idf = np.log((1.0 + n_docs) / (1.0 + np.array(df, np.float64))) + 1.0

    @classmethod
    def fit(cls, docs: DataFrame, text: str = "text", max_features: int = MAX_FEATURES) -> TfidfModel:
        """The most frequent terms of the texts; of equally frequent ones those that sort first. No documents raise."""
        if not 0 < max_features <= MOST_FEATURES:
            raise ValueError(f"max_features must be 1 to {MOST_FEATURES}")
        first = lambda among: term_counts(docs, text, among).orderBy(F.col("term").isNull().desc(), F.desc("tf"), "term").limit(max_features + 1).collect()
        if 2 * max_features > BUCKETS // 8:
            rows = first(None)
        else:
            counts = bucket_counts(docs, text)
            least = max(1, int(np.partition(counts, -2 * max_features)[-2 * max_features]))
            rows = first(counts >= least)
            nth = rows[-1]["tf"] if len(rows) > max_features else 1
            if least > nth:  # a term that was left out might be as frequent as the last
                rows = first(counts >= nth)
        if not rows or not rows[0]["df"]:
            raise ValueError("cannot fit a vocabulary on no documents")
        own = sorted(rows[1:], key=lambda r: r["term"])
        return cls([r["term"] for r in own], [r["df"] for r in own], [r["tf"] for r in own], rows[0]["df"])

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        """term, idx, df, tf, idf."""
        rows = [(t, i, d, f, float(x)) for i, (t, d, f, x) in enumerate(zip(self.terms, self.df, self.tf, self.idf, strict=True))]
        return spark.createDataFrame(rows, "term string, idx int, df long, tf long, idf double")

    def embed(self, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
        """key, indices, weights: unit vectors; terms outside the vocabulary are dropped, a text without any has no entries."""
        held = docs.sparkSession.sparkContext.broadcast((self.terms, self.idf))  # bounded by MOST_FEATURES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, idf = held.value
            place = {t: i for i, t in enumerate(names)}
            for batch in batches:
                indices, weights = [], []
                for value in batch.column(1).to_pylist():
                    found = Counter(map(place.get, terms(value)))
                    found.pop(None, None)
                    at = np.array(sorted(found), np.int32)
                    w = (1.0 + np.log(np.array([found[i] for i in at.tolist()], np.float64))) * idf[at]
                    indices.append(at)
                    weights.append(w / np.sqrt((w * w).sum()) if at.size else w)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(indices, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float64()))], [key, "indices", "weights"])

        kind = docs.schema[key].dataType.simpleString()
        return docs.select(key, text).mapInArrow(run, f"{key} {kind}, indices array<int>, weights array<double>")

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the vocabulary, over one that is there."""
        self.vocabulary(spark).withColumn("n_docs", F.lit(self.n_docs)).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TfidfModel:
        rows = spark.read.parquet(path).orderBy("idx").limit(MOST_FEATURES + 1).collect()
        return cls([r["term"] for r in rows], [r["df"] for r in rows], [r["tf"] for r in rows], rows[0]["n_docs"] if rows else 0)

    def search(self, queries: DataFrame, query_key: str, docs: DataFrame, key: str, k: int, text: str = "text") -> DataFrame:
        """query_key, key, score, rank: the k documents of largest cosine for each query; those that share no term score 0 and fill up."""
        return sparse_top_k(self.embed(queries, query_key, text), self.embed(docs, key, text), query_key, key, k)
