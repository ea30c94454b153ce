"""Language identification: sparse multinomial logistic regression on character n-grams.

TF-IDF of hashed character n-grams; document frequencies come from all rows that may be
learned from. Weights are trained by follow-the-regularised-leader with L1 and L2
penalties on a bounded sample, so most weights are exactly zero. A temperature fitted on
a part of the sample that training does not see turns scores into calibrated probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from cohortline.core.workspace import frugal, materialise
from cohortline.llm.common import id_and_text, quoted, remainder, slices, text_key
from cohortline.llm.sampling import FOLDS, below

#: Hashed features (a power of two), longest n-gram, sampled documents over all languages.
BITS, LONGEST, SAMPLE = 16, 3, 8000
EPOCHS, ALPHA, BETA, L1, L2 = 2, 1.0, 1.0, 0.002, 0.001
SLICE = 1 << 20
UNKNOWN = "und"
_letter = regex.compile(r"\p{L}")


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the whole text (lower-cased) and how often each occurs."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros(1 << BITS, np.int64) if len(points) > 2000 else None
    parts = []
    for first in range(0, len(points), SLICE):
        part = points[first : first + SLICE + LONGEST - 1].astype(np.uint64)
        mixed = np.zeros(len(part), np.uint64)
        for n in range(1, LONGEST + 1):
            size = min(SLICE, len(part) - n + 1)
            if size <= 0:
                break
            mixed = (mixed[:size] + part[n - 1 : n - 1 + size] + np.uint64(n)) * np.uint64(
                0x9E3779B97F4A7C15
            )
            bucket = (mixed >> np.uint64(64 - BITS)).astype(np.int64)
            if total is None:
                parts.append(bucket)
            else:
                total += np.bincount(bucket, minlength=1 << BITS)
            if n < LONGEST:
                mixed = mixed[: max(0, len(part) - n)]
    if total is not None:
        found = np.flatnonzero(total)
        return found, total[found]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(np.concatenate(parts), return_counts=True)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[found]
        return x / max(np.sqrt((x * x).sum()), 1e-12)

    def logits(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(found, counts) @ self.weights[found] + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list, idf: np.ndarray, languages: list[str]) -> Model:
    """``rows``: (n-grams, counts, language index), in the order they are learned from."""
    k = len(languages)
    model = Model(languages, idf, np.zeros((len(idf), k)), np.zeros(k))
    z, n = np.zeros((len(idf) + 1, k)), np.zeros((len(idf) + 1, k))
    for _ in range(EPOCHS):
        for found, counts, own in rows:
            # One feature more, always on, is the bias.
            at = np.r_[found, len(idf)]
            x = np.r_[model.vector(found, counts), 1.0]
            zi, ni = z[at], n[at]
            w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
            w[np.abs(zi) <= L1] = 0
            slope = softmax(x @ w)
            slope[own] -= 1
            g = x[:, None] * slope[None, :]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    w[np.abs(z) <= L1] = 0
    model.weights, model.bias = w[:-1], w[-1]
    return model


def fit_temperature(logits: np.ndarray, own: np.ndarray) -> float:
    """Temperature of the least negative log likelihood, by golden-section search."""
    if not len(own):
        return 1.0

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(own)), own]).mean())

    low, high, ratio = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _frequencies(learn: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the rows each n-gram occurs, and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros((1 << BITS) + 1, np.int64), 0
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                found, _ = gram_counts(text)
                seen[found] += 1
                rows += 1
        seen[-1] = rows
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], names=["f", "n"])

    counted = learn.select("text").mapInArrow(run, "f long, n long").groupBy("f")
    with frugal(learn.sparkSession):
        table = counted.agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros((1 << BITS) + 1, np.int64)
    seen[table.column("f").to_numpy()] = table.column("n").to_numpy()
    return seen[:-1], int(seen[-1])


def fit(docs: DataFrame, learn: Column | None = None, sample: int = SAMPLE) -> Model | None:
    """Train on rows with a language (and ``learn``); None if there are none.

    Document frequencies count all those rows. Weights come from about ``sample`` rows,
    spread evenly over the languages and picked by a hash of id and text; a fifth of them
    only fits the temperature.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col("lang").cast("string").alias("lang"),
    ).filter("lang is not null")
    if learn is not None:
        rows = rows.filter(learn)
    per = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not per:
        return None
    languages = sorted(per)
    seen, n = _frequencies(rows)
    idf = np.log((1 + n) / (1 + seen)) + 1
    picked = F.lit(False)
    for language, count in per.items():
        share = min(1.0, sample / len(per) / count)
        picked = picked | ((F.col("lang") == language) & below(share, F.col("doc_id"), F.col("text")))
    order = F.xxhash64(F.lit("order"), "doc_id", "text")
    chosen = rows.filter(picked).withColumn("o", order).orderBy("o", "doc_id", "lang").limit(2 * sample)
    # Bounded by the sample: only n-gram counts, not texts, reach the driver.
    table = _grams(chosen).toArrow()
    place = {language: i for i, language in enumerate(languages)}
    # Counts are read where they lie: copies of them would stay in the driver's memory.
    grams = zip(table.column("found"), table.column("counts"))
    order = table.column("o").to_numpy()
    data = [
        (np.frombuffer(f.as_buffer(), np.int32), np.frombuffer(c.as_buffer(), np.int32), place[language])
        for (f, c), language in zip(grams, table.column("lang").to_pylist())
    ]
    data = [data[i] for i in np.argsort(order, kind="stable")]
    fits = [row for i, row in enumerate(data) if i % FOLDS] or data
    tests = [row for i, row in enumerate(data) if i % FOLDS == 0]
    model = train(fits, idf, languages)
    if len(languages) > 1:
        logits = np.array([model.logits(f, c) for f, c, _ in tests])
        model.temperature = fit_temperature(logits, np.array([own for *_, own in tests]))
    return model


def _grams(chosen: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [gram_counts(text) for text in batch.column("text").to_pylist()]
            found = [f.astype(np.int32).tobytes() for f, _ in pairs]
            counts = [c.astype(np.int32).tobytes() for _, c in pairs]
            yield pa.RecordBatch.from_arrays(
                [batch.column("o"), batch.column("lang"), pa.array(found), pa.array(counts)],
                names=["o", "lang", "found", "counts"],
            )

    return chosen.mapInArrow(run, "o long, lang string, found binary, counts binary")


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default ``doc_id``) with ``lang_pred`` and ``score``."""
    keep = keep or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches):
            languages, scores = [], []
            for text in batch.column("text").to_pylist():
                language, score = UNKNOWN, 0.0
                if model is not None and text and _letter.search(text):
                    p = softmax(model.logits(*gram_counts(text)) / model.temperature)
                    best = int(p.argmax())
                    language, score = model.languages[best], float(p[best])
                languages.append(language)
                scores.append(score)
            columns = [batch.column(name) for name in keep]
            columns += [pa.array(languages, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(run, f"{kept}, lang_pred string, score double")


def identify(
    docs: DataFrame,
    modulus: int = 3,
    held: int = 1,
    sample: int = SAMPLE,
    with_key: bool = False,
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs``.

    ``with_key`` adds ``text_key``, by which a row finds its text's result: it depends on the
    text only, while ids may be null or repeat.

    Learns from rows whose crc32 of the id, modulo ``modulus``, is not ``held`` and whose
    language is not null; a null id is never learned from and counts as not held out. A
    null text or one without a letter gives ``und`` with score 0, as does every text if
    nothing can be learned; with one language all other texts get it with score 1. Ties
    go to the first language by name. Repeated rows each keep a result row.
    """
    learn = remainder(F.col("doc_id"), modulus) != held
    model = fit(docs, learn, sample)
    out = F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False))
    read = id_and_text(docs).withColumns({"held_out": out, "text_key": text_key(F.col("text"))})
    return predict(read, model, ["doc_id", "held_out", *["text_key"] * with_key])
