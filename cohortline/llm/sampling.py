"""Bounded, repeatable samples of labelled rows, and score calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortline.core.workspace import materialise
from cohortline.llm.common import id_and_text, local_roots, quoted
from cohortline.llm.simhash import shingle_hashes

#: A hash below ``share * SCALE`` is in the sample; one fold in ``FOLDS`` calibrates.
SCALE, FOLDS = 1 << 40, 5


def below(share: float, *columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SCALE)) < F.lit(int(share * SCALE))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, bound: int
) -> tuple[DataFrame, dict[int, float]]:
    """About ``bound`` documents of each class (0, 1), picked by a hash of their id.

    Returns the stored ``doc_id, text, label, calibrates`` and, by class, how many
    labelled rows one sample row stands for. An id whose labels differ, or one without a
    label, is left out. ``learn`` is a condition on ``doc_id``. At most twice the bound of
    rows a class is ever kept, whatever repeats.
    """
    label = quoted(label_col).cast("int")
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.alias("label"))
    own = own.filter(learn & F.col("label").isin(0, 1)).groupBy("doc_id")
    own = own.agg(F.min("label").alias("label"), F.max("label").alias("other"))
    own = materialise(own.filter("label = other").select("doc_id", "label"), "labels")
    counts = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    picked = F.lit(False)
    for value, count in counts.items():
        chosen = below(min(1.0, bound / count), F.lit(label_col), F.col("doc_id"))
        picked = picked | ((F.col("label") == value) & chosen)
    order = F.xxhash64("doc_id", F.lit(0))
    ids = own.filter(picked).orderBy(order, "doc_id").limit(4 * bound)
    read = id_and_text(docs).join(F.broadcast(ids), "doc_id")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)) == 0
    read = read.withColumn("calibrates", fold)
    read = materialise(read.orderBy(order, "doc_id", F.xxhash64("text")).limit(4 * bound), "sample")
    got = {r["label"]: r["count"] for r in read.groupBy("label").count().collect()}
    return read, {value: counts[value] / n for value, n in got.items()}


#: Min-hashes of a document; those with an equal consecutive pair are one family.
FAMILY_HASHES = 20


def one_per_family(sample: DataFrame) -> DataFrame:
    """One row of each family of near copies in a bounded sample (the one of smallest id).

    Copies of one document would otherwise pass for independent evidence. Rows are in a family if
    min-hashes of their three-word runs agree in a pair; texts without words stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = np.random.default_rng(1).integers(1 << 62, size=FAMILY_HASHES, dtype=np.uint64) * 2 + 1
        for batch in batches:
            signs = []
            for text in batch.column("text").to_pylist():
                hashes = np.array(shingle_hashes(text), np.uint64)
                low = [(hashes * a).min() for a in odd] if len(hashes) else []
                signs.append(np.array(low, np.uint64).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(signs, pa.binary())], names=["doc_id", "sign"]
            )

    table = sample.select("doc_id", "text").mapInArrow(run, "doc_id long, sign binary").toArrow()
    ids = table.column("doc_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, signs = ids[order], [table.column("sign")[int(i)].as_py() for i in order]
    a, b, seen = [], [], {}
    for i, sign in enumerate(signs):
        for band in range(0, len(sign), 16):
            first = seen.setdefault((band, sign[band : band + 16]), i)
            a.append(first)
            b.append(i)
    root = local_roots(len(ids), np.array(a, np.int64), np.array(b, np.int64))
    leads = [(int(ids[i]),) for i in np.unique(root)]
    listed = sample.sparkSession.createDataFrame(leads, "doc_id long").distinct()
    return materialise(sample.join(F.broadcast(listed), "doc_id"), "families")


def fit_sigmoid(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through weighted scores (Platt's targets)."""
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, offset = 0.0, 0.0
    x = np.stack([raw, np.ones(len(raw))], axis=1)

    def loss(a, b):
        z = a * raw + b
        return (weight * (np.logaddexp(0, z) - target * z)).sum()

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * raw + offset, -40, 40)))
        gradient = x.T @ (weight * (p - target))
        curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        size, now = 1.0, loss(slope, offset)
        while size > 1e-6 and loss(slope - size * step[0], offset - size * step[1]) > now:
            size /= 2
        slope, offset = slope - size * step[0], offset - size * step[1]
        if np.abs(size * step).max() < 1e-7:
            break
    return float(slope), float(offset)


def sigmoid(raw: np.ndarray, slope: float, offset: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * raw + offset, -500, 500)))
