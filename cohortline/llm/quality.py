"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features say which character n-grams (case and marks kept) and which n-grams of word
shapes a text holds; a word shape says how a word is written and whether it repeats one of the
two words before it. Every indicator is scaled by the log ratio of its smoothed counts in the
two classes, rows are scaled to length one, and a linear hinge-loss model is fitted by dual
coordinate descent. A logistic curve from a separate part of the sample gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cohortline.llm.common import Cache, id_and_text, remainder
from cohortline.llm.sampling import fit_sigmoid, labelled_sample, sigmoid

#: Hashed character n-grams, longest n-gram of characters and of words, rows per class.
BITS, LONGEST, WORDS, SAMPLE = 17, 3, 4, 4000
PENALTY, PASSES, SMOOTHING, THRESHOLD = 1.0, 12, 1.0, 0.3
SLICE = 1 << 20
SHAPES = 16
FEATURES = (1 << BITS) + sum(SHAPES**n for n in range(1, WORDS + 1))


def word_shape(word: str) -> int:
    """0-7: marks inside or around, upper case only, or no letter at all."""
    marked = not word[-1].isalnum() and word[-1] not in ".,;:?"
    return marked + 2 * word.isupper() + 4 * (not any(map(str.isalpha, word)))


# The hash without its last three bits, which hold the shape.
_words = Cache(lambda w: xxhash.xxh64_intdigest(w) & ~7 | word_shape(w))


def features(text: str) -> np.ndarray:
    """Sorted indexes of the features the whole text holds."""
    flags = np.zeros(FEATURES, bool)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for first in range(0, len(points), SLICE):
        part = points[first : first + SLICE + LONGEST - 1].astype(np.uint64)
        mixed = np.zeros(len(part), np.uint64)
        for n in range(1, LONGEST + 1):
            size = len(part) - n + 1
            if size <= 0:
                break
            mixed = (mixed[:size] + part[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            flags[mixed >> np.uint64(64 - BITS)] = True
    words = text.split()
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    repeats = np.zeros(len(words), bool)
    repeats[1:] = hashes[1:] == hashes[:-1]
    repeats[2:] |= hashes[2:] == hashes[:-2]
    symbols = (hashes & np.uint64(7)).astype(np.int64) + 8 * repeats
    base, mixed = 1 << BITS, np.zeros(len(words), np.int64)
    for n in range(1, WORDS + 1):
        size = len(words) - n + 1
        if size <= 0:
            break
        mixed = mixed[:size] * SHAPES + symbols[n - 1 :]
        flags[base + mixed] = True
        base += SHAPES**n
    return np.flatnonzero(flags)


@dataclass
class Model:
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        r = self.ratios[found]
        length = np.sqrt((r * r).sum()) or 1.0
        return float((r * self.weights[found]).sum() / length + self.bias)


def log_count_ratios(rows: list, labels: np.ndarray) -> np.ndarray:
    counts = np.full((2, FEATURES), SMOOTHING)
    for found, label in zip(rows, labels):
        counts[label, found] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def dual_descent(rows: list, labels: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model (Hsieh et al. 2008), in a fixed order.

    A class with fewer rows has a larger penalty, so both weigh the same.
    """
    data = []
    for found in rows:
        r = ratios[found]
        data.append(r / (np.sqrt((r * r).sum()) or 1.0))
    y = np.where(labels == 1, 1.0, -1.0)
    limit = np.where(labels == 1, (labels == 0).sum(), (labels == 1).sum())
    limit = PENALTY * limit / max(limit.max(), 1)
    weights, bias, alpha = np.zeros(FEATURES), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(PASSES):
        for i in order.permutation(len(rows)):
            found, x = rows[i], data[i]
            slope = y[i] * ((weights[found] * x).sum() + bias) - 1
            new = min(max(alpha[i] - slope / 2, 0.0), limit[i])
            step, alpha[i] = (new - alpha[i]) * y[i], new
            if step:
                weights[found] += step * x
                bias += step
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame, learn, bound: int = SAMPLE, label_col: str = "quality") -> Model | float:
    """A model, or the one class (0.5 without any labels) if there are not two to tell apart."""
    sample, stands_for = labelled_sample(docs, labels, label_col, learn, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t).astype(np.int32).tobytes() for t in batch.column("text").to_pylist()]
            columns = [batch.column(c) for c in ("doc_id", "label", "calibrates")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(found, pa.binary())], names=["doc_id", "label", "calibrates", "found"]
            )

    schema = "doc_id long, label int, calibrates boolean, found binary"
    table = sample.repartition(16).mapInArrow(run, schema).toArrow()
    label = table.column("label").to_numpy()
    if len(set(label)) < 2:
        return float(label[0]) if len(label) else 0.5
    order = np.lexsort((label, table.column("doc_id").to_numpy()))
    rows = [np.frombuffer(f, np.int32) for f in table.column("found").to_pylist()]
    rows, label = [rows[i] for i in order], label[order]
    aside = table.column("calibrates").to_numpy(zero_copy_only=False)[order]
    if len(set(label[aside])) < 2 or len(set(label[~aside])) < 2:
        aside = np.zeros(len(label), bool)
    fits = np.flatnonzero(~aside)
    chosen = [rows[i] for i in fits]
    ratios = log_count_ratios(chosen, label[fits])
    weights, bias = dual_descent(chosen, label[fits], ratios)
    model = Model(ratios, weights, bias, 1.0, 0.0)
    tests = np.flatnonzero(aside) if aside.any() else fits
    margins = np.array([model.margin(rows[i]) for i in tests])
    weight = np.array([stands_for[int(x)] for x in label[tests]])
    model.slope, model.offset = fit_sigmoid(margins, label[tests], weight / weight.mean())
    return model


def score(docs: DataFrame, model: Model | float, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Columns ``keep`` with ``score`` and ``predicted``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if isinstance(model, float):
                scores = np.full(len(texts), model)
            else:
                margins = np.array([model.margin(features(t)) for t in texts], float)
                scores = sigmoid(margins, model.slope, model.offset)
            columns = [batch.column(name) for name in keep]
            columns += [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "score", "predicted"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(run, f"{kept}, score double, predicted int")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    modulus: int = 5,
    held: int = 0,
    bound: int = SAMPLE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Labels are learned from about ``bound`` rows of each class whose crc32 of the id,
    modulo ``modulus``, is not ``held``. Null and empty texts hold no features and get
    the score of the bias. One class only: its value for all rows; no labels: 0.5. A
    null id is not held out and never learned from; repeated rows keep one row each.
    """
    part = remainder(F.col("doc_id"), modulus)
    model = fit(docs, labels, part != held, bound)
    read = id_and_text(docs).withColumn("held_out", F.coalesce(part == held, F.lit(False)))
    return score(read, model, ["doc_id", "held_out"], threshold)
