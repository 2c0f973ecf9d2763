"""Quality scores from compression.

One zstandard dictionary is built from good and one from bad labelled texts. A
text is compressed with each; the difference of the two sizes, over the size of
the text itself, says which it resembles, and a logistic curve fitted on labelled texts that are
in neither dictionary turns it into a probability.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, functions as F

from scriptorium.llm.common import fold, text_of

# Executors need not have this package on their path.
register_pickle_by_value(sys.modules[__name__])

DICTIONARY_BYTES = 110_000
LEVEL = 3
# Compressed in pieces: within a piece the dictionary is always in reach.
PIECE_BYTES = 1024
# Added to the size of a text, so that a few words alone say little.
SIZE_PRIOR = 200
# Learned from at most so many labelled documents of each class, each of at most so many characters.
SAMPLE_PER_CLASS = 1500
SAMPLE_CHARS = 32_768


@dataclass
class CompressionModel:
    """Two dictionaries and a logistic curve; without both classes only a constant."""

    good: bytes = b""
    bad: bytes = b""
    slope: float = 0.0
    intercept: float = 0.0

    def differences(self, texts: list[bytes]) -> np.ndarray:
        """(bad - good) of the compressed sizes over (size + SIZE_PRIOR); 0 for an empty text."""
        if not self.good or not self.bad:
            return np.zeros(len(texts))
        coders = []
        for content in (self.bad, self.good):
            dictionary = zstandard.ZstdCompressionDict(content)
            dictionary.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))
        out = np.zeros(len(texts))
        for row, text in enumerate(texts):
            sizes = [0, 0]
            for start in range(0, len(text), PIECE_BYTES):
                piece = text[start : start + PIECE_BYTES]
                for which, coder in enumerate(coders):
                    sizes[which] += len(coder.compress(piece))
            out[row] = (sizes[0] - sizes[1]) / (len(text) + SIZE_PRIOR)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.differences(texts) + self.intercept, -30, 30)))


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; the texts themselves where there is too little to train on."""
    pieces = [t[i : i + PIECE_BYTES] for t in texts for i in range(0, len(t), PIECE_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a small penalty on the slope."""
    scale = x.std() or 1.0
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    penalty = np.diag([1e-2, 1e-6])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - penalty @ beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + penalty
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 5,
    per_class: int = SAMPLE_PER_CLASS,
) -> CompressionModel:
    """Learn from labelled documents outside fold 0.

    A bounded sample: of each class the ``per_class`` ids with the least hash
    whose texts have at most SAMPLE_CHARS characters. Half of it builds the
    dictionaries, half fits the curve, weighted to the shares of the classes
    among all labels. Null labels, ids and texts are not learned from; of
    repeated labels the least counts; of repeated documents each is a text.
    """
    known = (
        labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__quality"))
        .where("__id IS NOT NULL AND __quality IN (0, 1)")
        .where(fold("__id", folds) != 0)
        .groupBy("__id")
        .agg(F.min("__quality").alias("__quality"))
    )
    sizes = {r["__quality"]: r["n"] for r in known.groupBy("__quality").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return CompressionModel(intercept={0: -30.0, 1: 30.0}[next(iter(sizes))] if sizes else 0.0)
    order = F.xxhash64("__id")
    picked = [known.where(F.col("__quality") == q).orderBy(order, "__id").limit(per_class) for q in (0, 1)]
    # At most 2 * per_class rows, so the broadcast is small.
    sample = (
        docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
        .where(F.length("text").between(1, SAMPLE_CHARS))
        .join(F.broadcast(picked[0].union(picked[1])), "__id")
        .select("__quality", F.encode("text", "UTF-8").alias("raw"), F.xxhash64("__id", F.lit(1)).alias("h"))
        .orderBy("h", "raw")
        .limit(4 * per_class)
        .collect()
    )
    texts = {q: [bytes(r["raw"]) for r in sample if r["__quality"] == q] for q in (0, 1)}
    if min(map(len, texts.values())) < 2:
        share = sizes[1] / (sizes[0] + sizes[1])
        return CompressionModel(intercept=float(np.log(share / (1 - share))))
    model = CompressionModel(good=_dictionary(texts[1][::2]), bad=_dictionary(texts[0][::2]))
    x = [model.differences(texts[q][1::2]) for q in (0, 1)]
    y = np.repeat([0.0, 1.0], [len(x[0]), len(x[1])])
    weight = np.repeat([sizes[0] / len(x[0]), sizes[1] / len(x[1])], [len(x[0]), len(x[1])])
    model.slope, model.intercept = _logistic(np.concatenate(x), y, weight * len(y) / weight.sum())
    return model


def score_quality(
    docs: DataFrame,
    model: CompressionModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 5,
    threshold: float = 0.3,
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row, in one narrow stage.

    Whole texts are read, however long. Null and empty texts get the curve's
    value at no difference. Ids are only copied; other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [s for i in range(0, batch.num_rows, 256) for s in model.scores(batch.column(2).slice(i, 256).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"]
            )

    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (fold(id_col, folds) == 0).alias("held_out"),
        F.encode(text_of(text_col), "UTF-8").alias("raw"),
    )
    scored = rows.mapInArrow(work, f"doc_id {id_type}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: CompressionModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, all columns kept, in one narrow stage."""
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = pc.fill_null(batch.column(at), "").cast(pa.large_binary())
            scores = [s for i in range(0, batch.num_rows, 256) for s in model.scores(raw.slice(i, 256).to_pylist())]
            yield batch.filter(pa.array([score >= threshold for score in scores], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
