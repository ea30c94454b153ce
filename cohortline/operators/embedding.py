"""Coordinates from distances: classical scaling fitted on all rows.

Classical scaling of the distance d = 1 - s needs the doubly centred kernel s - s²/2 of every
two rows. Here each row is described by its kernel values with a bounded number of landmark
rows (Nyström), and the axes are those of the sums over *all* rows: every row adds its products
to one landmarks × landmarks matrix, which is merged as a tree. Landmarks only span the space.
They are chosen in rounds, each time among all rows, by how badly the ones so far describe a
row. With as many landmarks as rows this is classical scaling itself (Gower 1966).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortline.core.workspace import materialise
from cohortline.operators.distance import _weighted_jaccard

#: Landmark rows, and rounds in which they are chosen. More give a closer fit; the sums of a
#: task take 8 bytes for every two landmarks.
LANDMARKS, ROUNDS = 2048, 4
#: Partial sums merged at once.
MERGED = 8
#: Smallest share of a matrix's largest eigenvalue that counts as more than rounding; and as
#: more than what the landmarks leave out, unless that is less itself.
RANK, FIT_RANK = 1e-10, 1e-3
#: Rows that meet all landmarks at once, and rows of a sum that are sent and merged as one.
SLICE_ROWS, STRIP_ROWS = 1000, 128


@dataclass(frozen=True)
class Landmarks:
    """Landmark rows, the spectrum over all rows, and the map from kernels to coordinates.

    ``total`` is the sum of all eigenvalues (the trace), ``unexplained`` the mean share of a
    row's similarity to itself that the landmarks do not span (0: the fit is exact).
    """

    rows: np.ndarray
    eigenvalues: np.ndarray
    total: float
    unexplained: float
    mean: np.ndarray
    project: np.ndarray


def _similarity() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Weighted Jaccard similarity, for use inside tasks."""
    measure = _weighted_jaccard()
    return lambda a, b: 1.0 - measure(a, b)


def _spectrum(matrix: np.ndarray, rank: float = RANK) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix above a share of the largest, and their vectors."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    kept = np.abs(values) > rank * np.abs(values).max(initial=0.0)
    return values[kept], vectors[:, kept]


def _unspanned(vectors: DataFrame, rows: np.ndarray) -> DataFrame:
    """(client_id, x, left): what the landmark rows leave of each row's similarity of 1 to itself."""
    similarity = _similarity()
    values, turn = _spectrum(similarity(rows, rows)) if len(rows) else (np.zeros(0), np.zeros((0, 0)))
    inverse = (turn / values) @ turn.T
    kind, slice_rows = vectors.schema["client_id"].dataType.simpleString(), SLICE_ROWS

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            for start in range(0, len(batch), slice_rows):
                part = batch.iloc[start : start + slice_rows]
                x = np.stack(part["x"].to_numpy())
                near = similarity(x, rows) if len(rows) else np.zeros((len(x), 0))
                rest = 1.0 - ((near @ inverse) * near).sum(axis=1)
                # Rounded, so that batches of other sizes choose the same rows.
                yield part.assign(left=np.maximum(rest, 0.0).round(9))

    return vectors.select("client_id", "x").mapInPandas(
        left, f"client_id {kind}, x array<double>, left double"
    )


def pick_landmarks(
    vectors: DataFrame, count: int = LANDMARKS, rounds: int = ROUNDS, seed: str = ""
) -> tuple[np.ndarray, float]:
    """Up to ``count`` rows that span the others, and the mean share that they leave.

    Every round scores all rows and takes some with a chance in proportion to what is left of
    them (Deshpande et al. 2006). The draw is a hash of the id, so it does not depend on the
    layout; copies of a landmark are never taken, and of equal rows in one round only one counts.
    """
    chosen: list[list[float]] = []
    rounds = max(1, min(rounds, count))
    for turn in range(rounds):
        scored = _unspanned(vectors, np.array(chosen, dtype=float))
        draw = F.xxhash64(F.lit(f"{seed}/{turn}"), F.col("client_id"))
        chance = (F.shiftrightunsigned(draw, 11).cast("double") + 1) / F.lit(float(1 << 53))
        # The smallest of these keys are a sample without replacement, in proportion to ``left``.
        keyed = scored.filter("left > 1e-9").withColumn("key", -F.ln(chance) / F.col("left"))
        wanted = -(-(count - len(chosen)) // (rounds - turn))
        found = keyed.orderBy("key", "client_id").limit(wanted).select("x").collect()
        chosen += [x for x in dict.fromkeys(tuple(r["x"]) for r in found) if list(x) not in chosen]
        chosen = [list(x) for x in chosen]
        if not found:
            break
    rows = np.array(chosen, dtype=float)
    rest = _unspanned(vectors, rows).agg(F.avg("left")).first()[0]
    return rows, float(rest or 0.0)


def _kernel() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Minus half the squared distance, up to what centring removes; for use inside tasks."""
    measure = _weighted_jaccard()
    return lambda a, b: 0.5 - 0.5 * measure(a, b) ** 2


def kernel_sums(vectors: DataFrame, rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Over all rows: their number, the sum of their kernel values with ``rows``, and the sum of
    the products of these. Every task sends its sums in strips of ``STRIP_ROWS`` rows, and those of
    one strip are merged ``MERGED`` at a time until one is left, so a merge holds a few strips only."""
    kernel, slice_rows, strip_rows = _kernel(), SLICE_ROWS, STRIP_ROWS
    m = len(rows)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        n, first, second = 0, np.zeros(m), np.zeros((m, m))
        for batch in batches:
            for start in range(0, len(batch), slice_rows):
                near = kernel(np.stack(batch["x"].iloc[start : start + slice_rows].to_numpy()), rows)
                n, first = n + len(near), first + near.sum(axis=0)
                for strip in range(0, m, strip_rows):
                    second[strip : strip + strip_rows] += near[:, strip : strip + strip_rows].T @ near
        for strip in range(0, m if n else 0, strip_rows):
            held = {"first": [first[strip : strip + strip_rows].tobytes()]}
            held["second"] = [second[strip : strip + strip_rows].tobytes()]
            yield pd.DataFrame({"strip": [strip], "n": [n], **held})

    def merged(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        # In one order, whatever order the parts come in.
        parts = parts.sort_values("part")
        first, second = (sum(map(np.frombuffer, parts[c])) for c in ("first", "second"))
        held = {"part": [int(key[1])], "strip": [int(key[0])], "n": [int(parts["n"].sum())]}
        return pd.DataFrame({**held, "first": [first.tobytes()], "second": [second.tobytes()]})

    schema = "strip int, n long, first binary, second binary"
    sums = vectors.select("x").mapInPandas(partial, schema)
    sums = materialise(sums.withColumn("part", F.spark_partition_id().cast("long")), "kernel-sums")
    while sums.count() > -(-m // strip_rows):
        groups = sums.withColumn("to", F.floor(F.col("part") / MERGED)).groupBy("strip", "to")
        sums = materialise(groups.applyInPandas(merged, f"part long, {schema}"), "kernel-sums")
    n, first, second = 0, np.zeros(m), np.zeros((m, m))
    # As many rows as the matrix has strips.
    for held in sums.toLocalIterator():
        place = slice(held["strip"], held["strip"] + strip_rows)
        n, first[place] = held["n"], np.frombuffer(held["first"])
        second[place] = np.frombuffer(held["second"]).reshape(-1, m)
    return n, first, second


def fit_landmarks(vectors: DataFrame, rows: np.ndarray, k: int, unexplained: float = 0.0) -> Landmarks:
    """The leading axes of the centred kernel of all ``vectors``, spanned by ``rows``."""
    if not len(rows):
        return Landmarks(rows, np.zeros(0), 0.0, unexplained, np.zeros(0), np.zeros((0, 0)))
    n, first, second = kernel_sums(vectors, rows)
    own = _kernel()(rows, rows)
    values, turn = _spectrum(own, max(RANK, min(FIT_RANK, unexplained)))
    # Features whose signed products give the kernel; a few may count negatively.
    sign, scale = np.sign(values), turn / np.sqrt(np.abs(values))
    mean = first / n
    spread = scale.T @ (second - n * np.outer(mean, mean)) @ scale
    sizes, axes = np.linalg.eigh((spread + spread.T) / 2)
    root = (axes * np.sqrt(np.maximum(sizes, 0.0))) @ axes.T
    found, inner = np.linalg.eigh(root @ (sign[:, None] * root))
    found, inner = found[::-1], inner[:, ::-1]
    # The kernel of a row with itself is 1/2.
    total = n * float(0.5 - (sign * (mean @ scale) ** 2).sum())
    kept = [i for i in range(min(k, len(found))) if found[i] > 1e-9 * max(found[0], 0.0)]
    project = scale @ (sign[:, None] * (root @ inner[:, kept])) / np.sqrt(found[kept])
    if kept:
        # The sign of an axis is free: make the largest coordinate of a landmark positive.
        placed = (own - mean) @ project
        project = project * np.sign(placed[np.abs(placed.round(6)).argmax(axis=0), range(len(kept))])
    return Landmarks(rows, found, total, unexplained, mean, project)


def place(vectors: DataFrame, landmarks: Landmarks) -> DataFrame:
    """(client_id, x): coordinates of every row, computed batch by batch."""
    kernel = _kernel()
    rows, mean, project = landmarks.rows, landmarks.mean, landmarks.project
    kind, slice_rows = vectors.schema["client_id"].dataType.simpleString(), SLICE_ROWS

    def coordinates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        for batch in batches:
            for start in range(0, len(batch), slice_rows):
                part = batch.iloc[start : start + slice_rows]
                placed = (kernel(np.stack(part["x"].to_numpy()), rows) - mean) @ project
                yield pd.DataFrame({"client_id": part["client_id"], "x": list(placed)})

    return vectors.mapInPandas(coordinates, f"client_id {kind}, x array<double>")


def landmark_mds(
    vectors: DataFrame, k: int = 8, landmarks: int = LANDMARKS, seed: str = ""
) -> tuple[DataFrame, Landmarks]:
    """Coordinates of every row on up to ``k`` axes, and the fit; ``vectors`` is read in a few passes.

    No rows give no coordinates; a single row, or equal rows, have no axis.
    """
    vectors = materialise(vectors.select("client_id", "x"), "vectors")
    rows, unexplained = pick_landmarks(vectors, landmarks, seed=seed)
    fitted = fit_landmarks(vectors, rows, k, unexplained)
    return place(vectors, fitted), fitted


def scree(spark: SparkSession, fitted: Landmarks, first: int = 15) -> DataFrame:
    """(axis, eigenvalue, share) of the leading axes over all rows, largest first.

    ``share`` is a part of the sum of all eigenvalues.
    """
    values = [
        (i + 1, float(v), float(v) / fitted.total if fitted.total else None)
        for i, v in enumerate(fitted.eigenvalues[:first])
    ]
    return spark.createDataFrame(values, "axis int, eigenvalue double, share double")
