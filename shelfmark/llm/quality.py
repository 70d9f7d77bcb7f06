"""Quality classifier by compression.

Two zstandard dictionaries are built from labelled good and bad texts. A text is compressed with
each of them and without one; the normalised size differences (bad minus good per byte, and against
the plain size) are calibrated to a probability by a logistic fit on labelled rows that did not go
into the dictionaries. Every text is compressed whole. Where a class has too few texts to train a
dictionary on, its joined texts are the dictionary.

The fit uses a bounded sample of labelled rows: at most ``sample_rows`` of each class, those with the
smallest hash of their text, of texts up to ``sample_text_bytes`` long. Scores cover all rows.

Defined results: a null text is empty, and an empty text gets the share of good rows in the sample;
labels other than 0 and 1 and labels without a text are not used; without labels of both classes
every score is that share (0.5 without any); repeated rows score alike; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..runtime import cut_lineage
from .common import raw_texts, schema_with, text_column, with_columns

SAMPLE_ROWS = 4000
SAMPLE_TEXT_BYTES = 32 << 10
DICTIONARY_BYTES = 112 << 10
PIECE_BYTES = 2 << 10
LEVEL = 1


@dataclass
class Model:
    prior: float = 0.5
    good: bytes = b""
    bad: bytes = b""
    weights: np.ndarray | None = None
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))


class Sizes:
    """Compressed sizes of a text: with the good dictionary, with the bad one, without."""

    def __init__(self, model: Model):
        kinds = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO) for d in (model.good, model.bad)]
        for k in kinds:
            k.precompute_compress(level=LEVEL)
        options = {"level": LEVEL, "write_content_size": False, "write_dict_id": False}
        self.compressors = [zstandard.ZstdCompressor(dict_data=k, write_content_size=False, write_dict_id=False) for k in kinds]
        self.compressors.append(zstandard.ZstdCompressor(**options))

    def __call__(self, raws: list[bytes]) -> np.ndarray:
        return np.array([[*(len(c.compress(r)) for c in self.compressors), len(r)] for r in raws], float).reshape(-1, 4)


def features(sizes: np.ndarray) -> np.ndarray:
    good, bad, plain, length = sizes.T
    length = np.maximum(length, 1)
    difference = bad - good
    base = np.stack([difference / length, difference / np.minimum(good, bad).clip(1), plain / length,
                     good / length, good / plain.clip(1), np.log(length)], axis=1)
    crossed = base[:, :, None] * base[:, None, :]
    return np.concatenate([base, crossed[:, *np.triu_indices(base.shape[1])]], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights (last: intercept) by Newton steps with a ridge."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - y @ z + (penalty * v * v).sum() / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-8:
            step /= 2
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(raws: list[bytes]) -> bytes:
    parts = [r[i:i + PIECE_BYTES] for r in raws for i in range(0, len(r), PIECE_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few texts to train on: the texts themselves are the dictionary
        return b"".join(raws)[-DICTIONARY_BYTES:]


def _halves(raws: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Texts for the dictionary and texts for the calibration; a single text is cut in two."""
    if len(raws) == 1:
        raws = [raws[0][:len(raws[0]) // 2] or raws[0], raws[0][len(raws[0]) // 2:]]
    return raws[::2], raws[1::2]


def draw(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, float]:
    """(text, quality) rows for ``fit`` from documents and their labels, and the share of good labels.

    Of each class the ``2 * sample_rows`` labels with the smallest hash of their id are drawn, so the
    side that is broadcast has at most ``4 * sample_rows`` rows of an id and a number. An id with both
    labels counts as bad.
    """
    usable = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality")).filter(
        F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    drawn = [usable.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample_rows) for q in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")
    total = sum(counts.values())
    return cut_lineage(sample.select("text", "quality")), counts.get(1, 0) / total if total else 0.5


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_text_bytes: int = SAMPLE_TEXT_BYTES,
        prior: float | None = None) -> Model:
    """``labelled``: text, quality (1 good, 0 bad); ``prior``: the share of good rows where it is not theirs."""
    usable = labelled.select(F.col("text").cast("string").alias("text"), F.col("quality").cast("int").alias("quality")) \
        .filter((F.octet_length("text") > 0) & (F.octet_length("text") <= sample_text_bytes) & F.col("quality").isin(0, 1))
    counts = {r["quality"]: r["n"] for r in labelled.groupBy(F.col("quality").cast("int").alias("quality"))
              .agg(F.count("text").alias("n")).collect() if r["quality"] in (0, 1)}
    total = sum(counts.values())
    own = counts.get(1, 0) / total if total else 0.5
    model = Model(prior=min(max(own if prior is None else prior, 1e-3), 1 - 1e-3))
    sample = {}
    for quality in (0, 1):
        table = usable.filter(F.col("quality") == quality).select("text").orderBy(
            F.xxhash64("text"), "text").limit(sample_rows).toArrow()
        sample[quality] = raw_texts(table["text"].combine_chunks()) if len(table) else []
    if not sample[0] or not sample[1]:
        return model
    halves = {q: _halves(sample[q]) for q in (0, 1)}
    model.good, model.bad = (_dictionary(halves[q][0]) for q in (1, 0))
    rest = [(r, q) for q in (0, 1) for r in halves[q][1]]
    x = features(Sizes(model)([r for r, _ in rest]))
    y = np.array([q for _, q in rest], float)
    model.centre, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights = _logistic((x - model.centre) / model.scale, y)
    # the sample has as many of each class as it can; back to the share of all labelled rows
    share = y.mean()
    model.weights[-1] += np.log(model.prior / (1 - model.prior)) - np.log(share / (1 - share))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: good likelier)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model) if model.weights is not None else None
        for batch in batches:
            raws = raw_texts(text_column(batch))
            if sizes is None:
                p = np.full(len(raws), model.prior)
            else:
                x = (features(sizes(raws)) - model.centre) / model.scale
                p = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))
                p[[not r for r in raws]] = model.prior
            yield with_columns(batch, score=pa.array(p, pa.float64()))

    return docs.mapInArrow(run, schema_with(docs, "score double"))


def keep_good(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The documents that score ``threshold`` or more, with their own columns."""
    packed = docs.select(F.struct("*").alias("_row"))
    return score(packed, model).filter(F.col("score") >= threshold).select("_row.*")
