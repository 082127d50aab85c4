"""Compression classifier: which of two zstandard dictionaries, of good and of bad text, makes a text smaller?

``fit`` builds both dictionaries from a bounded sample of labelled training texts (``dict_docs`` per class, at most
``dict_pieces`` evenly spaced pieces of each) and calibrates on ``calibration_docs`` labelled training texts: a logistic model of the
difference of both compressed sizes per byte, the good size per byte and how short the text is, with their products.
Both samples are the labelled rows with the smallest hash of their id, so their size does not grow with the corpus; a model is
some 70 kB.  ``score`` compresses every whole text in pieces of ``PIECE`` bytes, so that no part of a long text is
out of reach of the dictionary.  No shuffle of texts.

Defined cases: a null text counts as empty; an empty text has size 0 and gets the share of label 1;
labels that are null do not count, an id labelled twice counts once per label; without labels of both classes the score of
every text is the share of label 1 (0.5 without any label); null ids are scored and never held out; rows that repeat an
id are scored each on their own; extra columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PIECE, LEVEL, DICT_BYTES, SHORT = 1024, 3, 32768, 200
SIZES = "good_bytes long, bad_bytes long, n_bytes long"


@dataclass
class Model:
    """Both dictionaries and the calibration; ``weights`` None stands for a constant score."""

    good: bytes
    bad: bytes
    mean: list[float]
    scale: list[float]
    weights: list[float] | None
    share: float


class Sizes:
    """Compressed sizes of a text under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.compressors = []
        for content in (good, bad):
            dictionary = zstandard.ZstdCompressionDict(content)
            dictionary.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False))

    def of(self, text: str | None) -> tuple[int, int, int]:
        data = (text or "").encode()
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        good, bad = (sum(len(c.compress(p)) for p in pieces) for c in self.compressors)
        return good, bad, len(data)


def design(sizes: np.ndarray) -> np.ndarray:
    """Rows of (good, bad, bytes) as the columns of the logistic model."""
    good, bad, n = sizes.T.astype(float)
    n1 = np.maximum(n, 1)
    base = [(bad - good) / n1, np.minimum(good / n1, 1.5), np.exp(-n / SHORT)]
    return np.stack([np.ones(len(n)), *base, *(base[i] * base[j] for i in range(3) for j in range(i, 3))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights of a ridge logistic regression (Newton steps); the first column is the constant."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[0], scale[0] = 0, 1
    z = (x - mean) / scale
    w, pull = np.zeros(z.shape[1]), ridge * len(y) * np.r_[0, np.ones(z.shape[1] - 1)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + np.diag(pull)
        w = w + np.linalg.solve(hessian, z.T @ (y - p) - pull * w)
    return mean, scale, w


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """The texts (text, quality) of the n labelled rows with the smallest hash of their id."""
    chosen = labels.orderBy(F.md5(F.col("doc_id").cast("string")), "quality").limit(n)  # n rows: small enough to broadcast
    return documents.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select("text", "quality")


def pieces_of(text: str | None, most: int) -> list[bytes]:
    """At most ``most`` pieces, evenly spaced over the whole text."""
    data = (text or "").encode()
    starts = list(range(0, len(data), PIECE))
    return [data[i : i + PIECE] for i in starts[:: -(-len(starts) // most) or 1]]


def train_dictionary(texts: list[str | None], most: int) -> bytes:
    pieces = [p for t in sorted(texts, key=lambda t: t or "") for p in pieces_of(t, most) if p]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their content itself
        return b"".join(pieces)[-DICT_BYTES:]


def fit(
    documents: DataFrame, labels: DataFrame, dict_docs: int = 600, dict_pieces: int = 8, calibration_docs: int = 6000,
) -> Model:
    """Train on labelled rows that are not held out; ``labels`` has doc_id and quality (0 or 1)."""
    usable = labels.where("quality IN (0, 1)").where(~held_out()).select("doc_id", F.col("quality").cast("int"))
    texts = {}
    for quality in (1, 0):
        rows = sample(documents, usable.where(F.col("quality") == quality), dict_docs)
        texts[quality] = [r.text for r in rows.select("text").mapInArrow(thinned(dict_pieces), "text string").collect()]
    good, bad = (train_dictionary(texts[q], dict_pieces) for q in (1, 0))
    shares = usable.groupBy("quality").count().collect()
    counts = {r["quality"]: r["count"] for r in shares}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if not (good and bad):
        return Model(good, bad, [], [], None, share)
    rows = with_sizes(sample(documents, usable, calibration_docs), good, bad).select("good_bytes", "bad_bytes", "n_bytes", "quality").collect()
    data = np.array([tuple(r) for r in rows], dtype=float).reshape(-1, 4)
    data = data[np.lexsort(data.T)]  # rows come in any order
    if len(set(data[:, 3])) < 2:
        return Model(good, bad, [], [], None, share)
    mean, scale, weights = logistic(design(data[:, :3]), data[:, 3])
    return Model(good, bad, mean.tolist(), scale.tolist(), weights.tolist(), share)


def thinned(most: int):
    """Texts cut down to the pieces a dictionary is trained on, before they travel to the driver."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [b"".join(pieces_of(t, most)).decode("utf-8", "ignore") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], names=["text"])

    return cut


def with_sizes(documents: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """Add good_bytes, bad_bytes and n_bytes."""
    columns = [c for c in documents.columns if c not in ("good_bytes", "bad_bytes", "n_bytes")]
    plain = documents.select(*[F.col(c).cast("string") if c == "text" else F.col(c) for c in columns])
    schema = StructType(list(plain.schema))
    for name in ("good_bytes", "bad_bytes", "n_bytes"):
        schema = schema.add(name, "long")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for batch in batches:
            found = np.array([sizes.of(t.as_py()) for t in batch.column("text")], dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array(x) for x in found.T)], names=schema.names)

    return plain.mapInArrow(measure, schema)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """The documents with their sizes and ``score`` (0 to 1, higher: label 1 likelier)."""
    sized = with_sizes(documents.drop("score"), model.good, model.bad)
    if model.weights is None:
        return sized.withColumn("score", F.lit(float(model.share)))
    n = F.greatest(F.col("n_bytes"), F.lit(1)).cast("double")
    base = [
        (F.col("bad_bytes") - F.col("good_bytes")) / n,
        F.least(F.col("good_bytes") / n, F.lit(1.5)),
        F.exp(-F.col("n_bytes") / F.lit(float(SHORT))),
    ]
    terms = [F.lit(1.0), *base, *(base[i] * base[j] for i in range(3) for j in range(i, 3))]
    z = sum(((t - m) / s * w for t, m, s, w in zip(terms, model.mean, model.scale, model.weights)), F.lit(0.0))
    # Nothing is known about an empty text, and the fit holds for sizes it has seen only.
    return sized.withColumn("score", F.when(F.col("n_bytes") == 0, float(model.share)).otherwise(1 / (1 + F.exp(-z))))
