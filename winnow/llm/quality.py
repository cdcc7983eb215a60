"""Quality classifier: hashed word, word-pair and character n-gram vectors, averaged and fed to a softmax.

The vectors are learned by stochastic gradient descent in numpy on a bounded sample of labelled documents; a vector's step is
that of the mean times 20, at most that of the hidden vector itself, as shares of long texts are tiny. As the
output is linear in the average, a trained model folds into one number per hash bucket, so that scoring a document
means adding up numbers: no matrix leaves the driver but that vector (`2 ** bits` floats).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_REPEATED = 0  # bucket of the bigram "the same word twice"
_SEGMENT = 1 << 20  # bytes that are hashed at once
_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_PLACES = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class Settings:
    """max_per_class bounds the labelled rows that are fitted on: those with the smallest hash of doc_id."""

    bits: int = 17
    dim: int = 8
    epochs: int = 8
    rate: float = 0.5
    max_per_class: int = 2000
    seed: int = 7


def _segments(data: bytes) -> Iterator[bytes]:
    """The text in pieces that end between words, so that memory does not follow the longest text."""
    start = 0
    while len(data) - start > _SEGMENT:
        cut = data.rfind(b" ", start, start + _SEGMENT)
        cut = cut if cut > start else start + _SEGMENT
        yield data[start:cut]
        start = cut
    yield data[start:]


def buckets_of(data: bytes, bits: int) -> np.ndarray:
    """Hash buckets of a text's words, word pairs, and 3- and 4-grams of bytes (a space marks the ends of words)."""
    b = np.frombuffer(b" %b " % data, np.uint8)
    space = _SPACE[b]
    at = np.flatnonzero(~space)
    if not len(at):
        return np.empty(0, np.uint32)
    x = np.where(space, np.uint8(32), b).astype(np.uint32)
    shift = np.uint32(32 - bits)
    three = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    four = (three[:-1] << np.uint32(8)) | x[3:]
    first = np.flatnonzero(space[at - 1])  # in `at`, where words start
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    words = np.add.reduceat(x[at].astype(np.uint64) * _PLACES[place & 63], first)
    words ^= words >> np.uint64(29)
    pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    up = np.uint64(64 - bits)
    return np.concatenate(
        [
            (three * np.uint32(0x9E3779B1)) >> shift,
            (four * np.uint32(0x85EBCA6B)) >> shift,
            ((words * np.uint64(0x165667B19E3779F9)) >> up).astype(np.uint32),
            np.where(words[:-1] == words[1:], np.uint64(_REPEATED), pairs >> up).astype(np.uint32),
        ]
    )


def featurise(data: bytes | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, shares that sum to 1) of a text."""
    counts = np.zeros(1 << bits, np.int64)
    for part in _segments(data or b""):
        counts += np.bincount(buckets_of(part, bits), minlength=1 << bits)
    found = np.flatnonzero(counts)
    return found.astype(np.int32), (counts[found] / max(1, counts.sum())).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], settings: Settings) -> tuple[np.ndarray, float]:
    """Train on (buckets, shares, label 0 or 1); return the number for each bucket and the intercept of the logit."""
    rng = np.random.default_rng(settings.seed)
    size = 1 << settings.bits
    vectors = rng.uniform(-0.5, 0.5, (size, settings.dim)) / settings.dim
    out, bias = np.zeros((settings.dim, 2)), np.zeros(2)
    steps, done = max(1, settings.epochs * len(rows)), 0
    for _ in range(settings.epochs):
        for i in rng.permutation(len(rows)):
            buckets, shares, label = rows[i]
            rate = settings.rate * (1 - done / steps)
            done += 1
            if not len(buckets):
                continue
            own = vectors[buckets]
            hidden = shares @ own
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= rate * p
            # the average hands each feature its share; scaled up as shares are tiny
            vectors[buckets] = own - rate * np.outer(np.minimum(1, shares * 20), back)
    weights = vectors @ (out[:, 1] - out[:, 0])
    return weights.astype(np.float64), float(bias[1] - bias[0])


def _sample(documents: DataFrame, labels: DataFrame, settings: Settings) -> list[tuple[np.ndarray, np.ndarray, int]]:
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held).select("doc_id", "quality")
    parts = [
        known.where(F.col("quality") == q).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_per_class)
        for q in (0, 1)
    ]
    chosen = parts[0].unionByName(parts[1]).select(F.col("doc_id").alias("_id"), F.col("quality").alias("_label"))
    # at most two rows of two numbers for each of 2 * max_per_class documents: its size is bounded
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # rows that share a doc_id teach by one text, so that the sample stays bounded whatever repeats
    found = found.groupBy("doc_id", "_label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    bits = settings.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [featurise(x, bits) for x in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("_label"), *[pa.array([zlib.compress(x.tobytes(), 1) for x in c], pa.binary()) for c in (list(zip(*made, strict=True)) or [(), ()])]],
                names=["doc_id", "label", "buckets", "shares"],
            )

    rows = found.mapInArrow(run, "doc_id long, label int, buckets binary, shares binary").collect()
    unpacked = [(r.doc_id, r.label, zlib.decompress(r.buckets), zlib.decompress(r.shares)) for r in rows]
    unpacked.sort(key=lambda r: r[:3])
    return [(np.frombuffer(buckets, np.int32), np.frombuffer(shares, np.float32), label) for _, label, buckets, shares in unpacked]


def _scores(texts: list[bytes | None], weights: np.ndarray, bias: float) -> np.ndarray:
    bits = len(weights).bit_length() - 1
    logits = []
    for data in texts:
        total, n = 0.0, 0
        for part in _segments(data or b""):
            found = buckets_of(part, bits)
            total += float(weights[found].sum(dtype=np.float64))
            n += len(found)
        logits.append(total / max(1, n) + bias)
    return 1 / (1 + np.exp(-np.clip(np.array(logits, float), -500, 500)))


def score(documents: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id and `score`, the probability of label 1, of every document. One pass, no shuffle."""
    weights = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _scores(b.column("text").cast(pa.binary()).to_pylist(), weights, bias)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def accepted(documents: DataFrame, labels: DataFrame, settings: Settings = Settings(), least: float = 0.5) -> DataFrame:
    """The rows of documents whose score is `least` or more, all columns as they are; see `quality` for odd rows."""
    weights, bias = fit(_sample(documents, labels, settings), settings)
    weights = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _scores(b.column("text").cast(pa.binary()).to_pylist(), weights, bias)
            yield b.filter(pa.array(p >= least))

    return documents.mapInArrow(run, documents.schema)


def quality(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Labels with a null doc_id, or a quality other than 0 and 1, teach nothing; without labels every score is 0.5. Where
    rows share a labelled doc_id, the text of smallest hash teaches. A null or empty text gets the score of the intercept alone. Repeated rows are scored each, ties need no rule, extra columns
    are ignored. crc32(doc_id as text) mod 3 = 1 marks held-out rows, which are never fitted on; for a null doc_id
    held_out is false.
    """
    weights, bias = fit(_sample(documents, labels, settings), settings)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return score(documents, weights, bias).select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
