"""Dense vectors from a hosted model, and the retries that calls to it need."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .retrieve import exact_top_k


def backoff(attempt: int, first: float = 1.0) -> float:
    """Seconds to wait after an attempt, the first of which is 1: twice as long each time."""
    return first * 2 ** (attempt - 1)


def with_retries(call: Callable, attempts: int = 3, first: float = 1.0, wait: Callable[[float], None] = time.sleep):
    """The outcome of call(); it is tried `attempts` times, and the last failure raises."""
    if attempts < 1:
        raise ValueError("at least one attempt is needed")
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Exception as error:
            if attempt == attempts:
                raise RuntimeError(f"failed after {attempts} attempts: {error}") from error
            wait(backoff(attempt, first))


class DenseModel:
    """A model that gives a text a fixed vector, whatever the corpus.

    generate(texts, task) returns a vector for each text; task says whether they are documents or queries. Texts go in
    one request for each `batch` of them, with retries; vectors are brought to length one.
    """

    DOCUMENT, QUERY = "RETRIEVAL_DOCUMENT", "RETRIEVAL_QUERY"

    def __init__(self, name: str, generate: Callable[[list[str], str], list], batch: int = 100, attempts: int = 3, first_wait: float = 1.0):
        self.name, self.generate, self.batch, self.attempts, self.first_wait = name, generate, batch, attempts, first_wait

    def embed(self, docs: DataFrame, key: str, text: str = "text", task: str = DOCUMENT) -> DataFrame:
        """key, vector of every row; a null text counts as empty."""
        generate, size, attempts, first_wait = self.generate, self.batch, self.attempts, self.first_wait

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    texts = [t or "" for t in part.column(1).to_pylist()]
                    made = np.array(with_retries(lambda: generate(texts, task), attempts, first_wait), np.float32)  # noqa: B023
                    if made.shape[0] != len(texts):
                        raise ValueError("the model returned another number of vectors")
                    length = np.linalg.norm(made, axis=1, keepdims=True)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array((made / np.where(length == 0, 1, length)).tolist(), pa.list_(pa.float32()))], [key, "vector"])

        return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, vector array<float>")

    def search(self, queries: DataFrame, query_key: str, docs: DataFrame, key: str, k: int, text: str = "text") -> DataFrame:
        """query_key, key, score, rank of the k best documents of each query."""
        return exact_top_k(self.embed(queries, query_key, text, self.QUERY), self.embed(docs, key, text), query_key, key, "vector", k)
