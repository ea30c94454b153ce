"""From the patient table to clusters of care trajectories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from cohortline.core.workspace import materialise
from cohortline.operators.clustering import (
    COARSE,
    FINE,
    MICRO,
    Micro,
    assign,
    choose_k,
    fit_micro,
    silhouette_sweep,
)
from cohortline.operators.embedding import LANDMARKS, Landmarks, landmark_mds
from cohortline.operators.labels import canonical_labels
from cohortline.operators.profile import as_vector, drop_constant, profile_matrix, rescale

AXES = 8
SWEEP = list(range(2, 21))


@dataclass(frozen=True)
class Trajectories:
    """Stored coordinates, the merges, and (client_id, cluster)."""

    coordinates: DataFrame
    landmarks: Landmarks
    micro: Micro
    clusters: DataFrame


def embed_patients(
    patients: DataFrame,
    axes: int = AXES,
    landmarks: int = LANDMARKS,
    mode: str = "identity",
) -> tuple[DataFrame, Landmarks]:
    """Stored coordinates of the patients' activity profiles."""
    profile = drop_constant(rescale(profile_matrix(patients), mode))
    placed, fitted = landmark_mds(as_vector(profile), axes, landmarks)
    return materialise(placed, "coordinates"), fitted


def trajectory_clusters(
    patients: DataFrame,
    k: int | str = FINE,
    coarse: int = COARSE,
    axes: int = AXES,
    landmarks: int = LANDMARKS,
    micro: int = MICRO,
) -> Trajectories:
    """Cluster patients by activity profile; ``k="auto"`` picks 2…20 by silhouette.

    ``patients`` should be a stored table: it is read several times.
    """
    coordinates, fitted = embed_patients(patients, axes, landmarks)
    reduced = fit_micro(coordinates, micro)
    if k == "auto":
        k = choose_k(silhouette_sweep(coordinates, reduced, SWEEP))
    # A cut cannot have more clusters than there are points.
    fine = min(int(k), reduced.merges.count)
    labelled = assign(coordinates, reduced, {"c3": min(coarse, fine), "ck": fine})
    with_measure = labelled.drop("x").join(patients.select("client_id", "mins"), "client_id")
    stored = materialise(with_measure, "labelled")
    named = canonical_labels(stored, "c3", "ck", "mins")
    return Trajectories(coordinates, fitted, reduced, named.select("client_id", "cluster"))


def attach_clusters(patients: DataFrame, clusters: DataFrame) -> DataFrame:
    return patients.join(clusters, "client_id")


def patients_with_clusters(patients: DataFrame, **settings) -> DataFrame:
    """The patient table with its ``cluster`` column."""
    return attach_clusters(patients, trajectory_clusters(patients, **settings).clusters)
