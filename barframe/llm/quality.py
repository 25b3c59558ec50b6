"""Quality by compression: what good text and bad text teach a zstandard dictionary.

Two dictionaries are built from labelled text, one from good and one from bad documents. Every whole
text is compressed with both; the normalised difference of the two sizes, with the sizes a byte,
becomes a probability by a logistic regression fitted on the same labelled rows.

Defined results: a null or empty text scores as an empty text does (a number in [0, 1]); repeated
rows score alike; an empty table gives an empty result; without both labels among the training rows
there is nothing to learn, and every text scores ``DEFAULT``, which keeps it. Other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.llm.common import free_name, map_arrow
from barframe.llm.fitting import Logistic, labelled_sample

#: The fit uses at most so many labelled documents of each class, whole ones; the rest of the labels isn't read.
SAMPLE_ROWS = 2000
DICTIONARY_BYTES = 112 * 1024
#: Dictionary trainers want many short samples: sampled texts are dealt in pieces of this size.
PIECE_BYTES = 2048
LEVEL = 3
DEFAULT = 0.99
THRESHOLD = 0.7


@dataclass
class Model:
    good: bytes
    bad: bytes
    fit: Logistic | None


def train(sample: list[tuple[str, int]]) -> Model:
    texts = {k: [t.encode() for t, y in sample if y == k and t] for k in (0, 1)}
    if not texts[0] or not texts[1]:
        return Model(b"", b"", None)
    # Half of the rows make the dictionaries, the other half calibrates: a text that is in the dictionary tells nothing.
    made = {k: v[: max(1, len(v) // 2)] for k, v in texts.items()}
    held = {k: v[len(v) // 2 :] for k, v in texts.items()}
    model = Model(_dictionary(made[1]), _dictionary(made[0]), None)
    sizes = _Sizes(model)
    x = np.array([sizes(t) for k in (0, 1) for t in held[k]])
    y = np.array([float(k) for k in (0, 1) for _ in held[k]])
    model.fit = Logistic(ridge=0.1).fit(_features(x), y)
    return model


def _dictionary(texts: list[bytes]) -> bytes:
    pieces = [t[i : i + PIECE_BYTES] for t in texts for i in range(0, len(t), PIECE_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, k=200, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples for the trainer: their bytes are the dictionary
        return b"".join(pieces)[-DICTIONARY_BYTES:].ljust(8, b" ")


class _Sizes:
    """Compressed sizes of a text with either dictionary, and its plain size."""

    def __init__(self, model: Model):
        self.pair = [
            zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            for d in (zstandard.ZstdCompressionDict(model.good), zstandard.ZstdCompressionDict(model.bad))
        ]

    def __call__(self, text: bytes) -> tuple[int, int, int]:
        return len(self.pair[0].compress(text)), len(self.pair[1].compress(text)), len(text)


def _features(sizes: np.ndarray) -> np.ndarray:
    good, bad, plain = sizes.astype(float).T
    difference = (good - bad) / (good + bad)
    a, b, length = good / (plain + 16), bad / (plain + 16), np.log1p(plain)
    return np.column_stack([difference, difference**2, a, b, a * a, b * b, length, length * a, length * difference, 1 / (1 + plain)])


def fit(documents: DataFrame, labels: DataFrame, training: Column, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the labelled rows for which ``training`` (a condition on doc_id) holds.

    At most ``rows`` of each class come to the driver. Since that evens the classes out, the odds are set
    right again by the classes' counts over all of these labels.
    """
    learn = labels.where(training)
    counts = {r[label]: r["count"] for r in learn.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    sample = []
    for value in (0, 1):
        part = labelled_sample(learn.where(F.col(label) == value), documents, label, rows)
        sample += [(r["text"], r["label"]) for r in part.orderBy("doc_id", "text").collect()]
    model = train(sample)
    if model.fit:
        taken = [sum(y == k for _, y in sample) for k in (0, 1)]
        model.fit.weights[0] += np.log(counts[1] / counts[0]) - np.log(taken[1] / taken[0])
    return model


def with_score(documents: DataFrame, model: Model, text: str = "text", column: str = "quality_score") -> DataFrame:
    """All columns and rows, and the probability that the text is good. One pass, no shuffle."""
    column = free_name(documents, column)
    schema = T.StructType([*documents.schema.fields, T.StructField(column, T.DoubleType())])
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        known = shared.value
        sizes = _Sizes(known) if known.fit else None
        for batch in batches:
            if not batch.num_rows:
                continue
            if sizes is None:
                p = np.full(batch.num_rows, DEFAULT)
            else:
                texts = batch.column(batch.schema.get_field_index(text))
                p = known.fit.predict(_features(np.array([sizes((t.as_py() or "").encode()) for t in texts])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, column])

    return map_arrow(documents, score, schema)
