import linkage as li
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortline.operators import clustering as cl
from cohortline.operators import distance as ds
from cohortline.operators import embedding as em
from cohortline.operators import labels as la
from cohortline.operators import merging as mg
from cohortline.operators import profile as pf
from cohortline.operators import silhouette as si
from cohortline.plans import trajectories as tr


def make(spark, points):
    data = [(i, [float(v) for v in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(data, "client_id long, x array<double>").repartition(5)


def jaccard(a, b):
    high = np.maximum(a, b).sum()
    return 0.0 if high == 0 else 1 - np.minimum(a, b).sum() / high


def all_jaccard(points):
    return np.array([[jaccard(a, b) for b in points] for a in points])


@pytest.fixture(scope="module")
def points():
    random = np.random.default_rng(5)
    found = random.exponential(3, (40, 5)) * (random.random((40, 5)) > 0.3)
    found[3] = found[4] = 0.0  # rows without any care
    found[10] = found[11]  # copies
    return found


# --- profiles -----------------------------------------------------------------


@pytest.fixture(scope="module")
def patients(spark):
    data = [(1, 600.0, 60.0, 0.0, 5.0, 9.0), (2, 60.0, 120.0, 0.0, 5.0, 1.0), (3, 90.0, 0.0, 0.0, 5.0, 3.0)]
    return spark.createDataFrame(
        data, "client_id long, mins double, mins_a double, `mins_<na>` double, mins_c double, mins_prev double"
    )


def test_profile_is_in_hours_by_category(patients):
    profile = pf.profile_matrix(patients)
    assert profile.columns == ["client_id", "a", "<na>", "c"]
    assert sorted(r["a"] for r in profile.collect()) == [0.0, 1.0, 2.0]
    assert pf.to_long(profile).count() == 9


def test_constant_columns_are_dropped(patients):
    assert pf.drop_constant(pf.profile_matrix(patients)).columns == ["client_id", "a"]


def values(df):
    return [tuple(r)[1:] for r in df.orderBy("client_id").collect()]


def test_rescale_modes(spark):
    profile = spark.createDataFrame([(1, 0.0, 3.0), (2, 9.0, 3.0), (3, 99.0, 3.0)], "client_id long, a double, b double")
    assert values(pf.rescale(profile)) == values(profile)
    assert np.allclose(values(pf.rescale(profile, "log_minmax")), [(0, 0.5), (0.5, 0.5), (1, 0.5)])
    assert np.allclose(values(pf.rescale(profile, "max")), [(0, 1 / 33), (1 / 11, 1 / 33), (1, 1 / 33)])
    assert values(pf.rescale(profile, "over_one")) == [(0.0, 1.0), (1.0, 1.0), (1.0, 1.0)]
    assert values(pf.rescale(profile, "minus_one"))[0] == (-1.0, 2.0)
    unit = spark.createDataFrame([(i, x) for i, x in enumerate([0.0, 0.05, 0.1, 0.95, 1.0, 1.5])], "client_id long, a double")
    assert [v[0] for v in values(pf.rescale(unit, "bins"))] == [1.0, 2.0, 2.0, 11.0, 11.0, None]
    with pytest.raises(ValueError):
        pf.rescale(profile, "other")


# --- distances ------------------------------------------------------------------


@pytest.mark.parametrize("block", [1000, 4])
def test_anchor_distances_equal_the_definition(spark, points, block, monkeypatch):
    monkeypatch.setattr(ds, "ANCHORS", block)
    table = make(spark, points)
    given = table.filter("client_id % 3 = 0").select(F.col("client_id").alias("anchor_id"), "x")
    found = ds.anchor_distances(table, given).collect()
    want = all_jaccard(points)
    assert len(found) == 40 * 14
    for r in found:
        assert r["dist"] == pytest.approx(want[r["client_id"], r["anchor_id"]])
    assert ds.anchor_distances(table, given.limit(0)).count() == 0
    slots = np.minimum(np.floor(np.round(want[:, 3], 12) * 20), 19).astype(int)
    counted = {r["bin"]: r["rows"] for r in ds.anchor_histogram(table, given).filter("anchor_id = 3").collect()}
    assert counted == dict(zip(*np.unique(slots, return_counts=True)))


@pytest.mark.parametrize("most", [0.05, 0.3, 0.7])
@pytest.mark.parametrize("whole", [False, True])
def test_similar_profiles_equal_brute_force(spark, most, whole):
    profiles = crowd(250, seed=9) * (np.random.default_rng(1).random((250, 7)) > 0.3)
    profiles = np.concatenate([profiles, profiles[:5], profiles[:5] * (1 - most), np.zeros((4, 7))])
    profiles = np.rint(profiles * 20) if whole else profiles
    table = make(spark, profiles)
    classes = {r["client_id"]: r["class_id"] for r in ds.profile_classes(table).collect()}
    first = {}
    for i, p in enumerate(profiles):
        assert classes[i] == first.setdefault(tuple(p), i)
    dist = all_jaccard(profiles)
    heads = sorted(set(classes.values()))
    size = {h: sum(c == h for c in classes.values()) for h in heads}
    want = {(a, b): (size[a], size[b]) for a in heads for b in heads if a < b and dist[a, b] <= most + 1e-12}
    found = ds.similar_profiles(table, most).collect()
    assert {(r["a"], r["b"]): (r["rows_a"], r["rows_b"]) for r in found} == want and len(found) == len(want)
    assert all(r["dist"] == pytest.approx(dist[r["a"], r["b"]]) for r in found)


def test_similar_profiles_meet_in_parts(spark, monkeypatch):
    """Frequent prefixes are dealt in parts, and no exploded profiles are sent to all tasks."""
    table = make(spark, crowd(200, seed=4))
    want = sorted(ds.similar_profiles(table, 0.4).collect())
    monkeypatch.setattr(ds, "PART_ROWS", 9)
    found = ds.similar_profiles(table, 0.4)
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(found.collect()) == want and want


def test_similar_profiles_are_compared_by_parts(spark, monkeypatch):
    """Parts meet as one row each, not pair by pair; ids of any type, one of them missing."""
    monkeypatch.setattr(ds, "PART_ROWS", 30)
    table = make(spark, crowd(200, seed=4))
    want = sorted((str(r["a"]), str(r["b"]), r["dist"]) for r in ds.similar_profiles(table, 0.4).collect())
    text = table.withColumn("client_id", F.concat(F.lit("c"), F.lpad(F.col("client_id").cast("string"), 4, "0")))
    found = ds.similar_profiles(text, 0.4)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    found = [(str(int(r["a"][1:])), str(int(r["b"][1:])), r["dist"]) for r in found.collect()]
    assert sorted(found) == want and want
    missing = table.withColumn("client_id", F.when(F.col("client_id") != 7, F.col("client_id")))
    found = ds.similar_profiles(missing, 0.4).collect()
    assert len(found) == len(want)
    assert sum(r["a"] is None or r["b"] is None for r in found) == sum("7" in pair[:2] for pair in want) > 0
    near = ds._near_pairs(2, 0.5)
    rows = [{"id": i, "rows": 1, "x": [float(i + 1), 1.0], "total": i + 2.0, "places": [0, 1]} for i in range(300)]
    cells = pa.RecordBatch.from_pylist([{"place": place, "held_1": rows, "held_2": rows} for place in (1, 0)])
    pairs = pa.Table.from_batches(near(iter([cells])))
    want = sum(1 - (min(i, j) + 2) / (max(i, j) + 2) <= 0.5 + 1e-12 for i in range(300) for j in range(i, 300))
    assert pairs.num_rows == want


def test_similar_profiles_of_odd_tables(spark):
    table = make(spark, np.zeros((3, 2)))
    assert ds.similar_profiles(table, 0.5).count() == 0
    assert ds.similar_profiles(table.limit(0), 0.5).count() == 0
    with pytest.raises(ValueError):
        ds.similar_profiles(table, 1.0)


@pytest.mark.parametrize("block_rows", [1000, 6])
def test_histogram_counts_every_pair_once(spark, points, block_rows):
    copied = np.concatenate([points, np.repeat(points[:1], 30, axis=0)])
    found = ds.distance_histogram(make(spark, copied), 10, block_rows).orderBy("bin").collect()
    want = all_jaccard(copied)[np.triu_indices(len(copied), 1)]
    slots = np.minimum(np.floor(np.round(want, 12) * 10), 9).astype(int)
    assert [r["pairs"] for r in found] == list(np.bincount(slots, minlength=10))


# --- embedding --------------------------------------------------------------------


def classical(distances, k):
    n = len(distances)
    centre = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ distances**2 @ centre)
    order = np.argsort(values)[::-1][:k]
    return values[order], vectors[:, order] * np.sqrt(values[order])


def test_all_rows_as_landmarks_give_classical_scaling(spark, points):
    placed, fitted = em.landmark_mds(make(spark, points), k=4, landmarks=500)
    got = np.array([r["x"] for r in placed.orderBy("client_id").collect()])
    values, want = classical(all_jaccard(points), 4)
    assert np.allclose(fitted.eigenvalues[:4], values)
    assert np.allclose(li.euclidean(got), li.euclidean(want), atol=1e-7)
    assert list(fitted.eigenvalues) == sorted(fitted.eigenvalues, reverse=True)


def test_fewer_landmarks_still_place_every_row(spark, points):
    placed, fitted = em.landmark_mds(make(spark, points), k=3, landmarks=15)
    found = placed.collect()
    assert len(found) == 40 and all(len(r["x"]) == 3 for r in found)
    got = np.array([r["x"] for r in sorted(found, key=lambda r: r["client_id"])])
    assert np.allclose(got[3], got[4]) and np.allclose(got[10], got[11])


def test_scree_lists_leading_axes(spark, points):
    _, fitted = em.landmark_mds(make(spark, points), k=3)
    found = em.scree(spark, fitted).collect()
    assert [r["axis"] for r in found] == list(range(1, 16))
    trace = np.trace(-0.5 * (np.eye(40) - 1 / 40) @ all_jaccard(points) ** 2 @ (np.eye(40) - 1 / 40))
    assert fitted.total == pytest.approx(trace)
    assert [r["share"] for r in found] == pytest.approx([r["eigenvalue"] / trace for r in found])


def crowd(n=600, seed=3):
    random = np.random.default_rng(seed)
    centres = random.exponential(8, (6, 7)) * (random.random((6, 7)) > 0.4)
    return centres[random.integers(0, 6, n)] + random.exponential(1.0, (n, 7))


def test_axes_come_from_all_rows(spark):
    """A fit spanned by a tenth of the rows against classical scaling of all of them."""
    points = crowd()
    placed, fitted = em.landmark_mds(make(spark, points), k=4, landmarks=60)
    got = np.array([r["x"] for r in placed.orderBy("client_id").collect()])
    values, want = classical(all_jaccard(points), 4)
    assert np.allclose(fitted.eigenvalues[:4], values, rtol=0.03)
    a, b = li.euclidean(got), li.euclidean(want)
    assert np.corrcoef(a.ravel(), b.ravel())[0, 1] > 0.995
    assert abs(got.mean(axis=0)).max() < 1e-9 and 0 < fitted.unexplained < 0.2


def test_axes_do_not_depend_on_partitions(spark):
    table = make(spark, crowd(200))
    found = []
    for parts in (1, 3, 16):
        placed, _ = em.landmark_mds(table.repartition(parts), k=4, landmarks=40)
        found.append(np.array([r["x"] for r in placed.orderBy("client_id").collect()]))
    assert np.allclose(found[0], found[1], atol=1e-8) and np.allclose(found[0], found[2], atol=1e-8)


@pytest.mark.parametrize("strip, parts", [(128, 1), (7, 40)])
def test_kernel_sums_merge_by_strips(spark, monkeypatch, strip, parts):
    """No row of sums holds more than one strip, and slices of any size give the same sums."""
    points, stored = crowd(300), []
    monkeypatch.setattr(em, "STRIP_ROWS", strip)
    monkeypatch.setattr(em, "SLICE_ROWS", 13)
    keep = em.materialise
    monkeypatch.setattr(em, "materialise", lambda df, name: stored.append(keep(df, name)) or stored[-1])
    near = em._kernel()(points, points[:30])
    n, first, second = em.kernel_sums(make(spark, points).repartition(parts), points[:30])
    assert n == 300 and np.allclose(first, near.sum(axis=0)) and np.allclose(second, near.T @ near)
    for sums in stored:
        assert sums.agg(F.max(F.octet_length("second"))).first()[0] <= strip * 30 * 8


def test_equal_rows_and_no_rows_have_no_axis(spark):
    equal = make(spark, np.ones((5, 3)))
    placed, fitted = em.landmark_mds(equal, k=2)
    assert [list(r["x"]) for r in placed.collect()] == [[]] * 5 and len(fitted.rows) == 1
    placed, fitted = em.landmark_mds(equal.limit(0), k=2)
    assert placed.count() == 0 and fitted.total == 0
    assert em.scree(spark, fitted).count() == 0


# --- tree ----------------------------------------------------------------------------


def brute_ward(gap):
    """Merge the closest pair again and again, with the update rule spelled out."""
    groups = {i: [i] for i in range(len(gap))}
    d = {(i, j): gap[i, j] for i in groups for j in groups if i < j}
    heights = []
    while len(groups) > 1:
        (a, b), h = min(d.items(), key=lambda e: (e[1], e[0]))
        na, nb = len(groups[a]), len(groups[b])
        for c in groups:
            if c in (a, b):
                continue
            nc = len(groups[c])
            ac, bc = d[min(a, c), max(a, c)], d[min(b, c), max(b, c)]
            d[min(a, c), max(a, c)] = ((na + nc) * ac + (nb + nc) * bc - nc * h) / (na + nb + nc)
        groups[a] = groups[a] + groups.pop(b)
        d = {k: v for k, v in d.items() if b not in k}
        heights.append(h)
    return heights


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_tree_equals_brute_force():
    points = np.random.default_rng(1).normal(size=(28, 3))
    gap = li.euclidean(points)
    tree = li.ward_tree(gap)
    assert np.allclose(tree.height, sorted(brute_ward(gap)))
    assert list(tree.height) == sorted(tree.height) and tree.size[-1] == 28


def test_sizes_stand_for_coincident_rows():
    random = np.random.default_rng(2)
    points, sizes = random.normal(size=(9, 2)), np.array([1, 4, 2, 1, 7, 1, 3, 1, 2])
    rows = np.repeat(points, sizes, axis=0)
    full, small = li.ward_tree(li.euclidean(rows)), li.ward_tree(li.euclidean(points), sizes)
    assert np.allclose(full.height[-8:], small.height, atol=1e-5)
    for k in range(2, 9):
        assert same_partition(li.labels_at(full, k), np.repeat(li.labels_at(small, k), sizes))


def merged(spark, points, sizes=None):
    sizes = np.ones(len(points)) if sizes is None else np.asarray(sizes, dtype=float)
    leaves = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "node long, rows long")
    return mg.ward_merges(leaves, mg.point_sums(spark, points, sizes, 2.0**30), 2.0**30)


def label_array(merges, k):
    return [r["c"] for r in mg.labels(merges, {"c": k}).orderBy("node").collect()]


@pytest.fixture(scope="module")
def tree(spark):
    points = np.random.default_rng(4).normal(size=(40, 2))
    return li.ward_tree(li.euclidean(points)), merged(spark, points)


def test_merges_equal_the_tree_built_one_by_one(tree):
    want, got = tree
    found = mg.merge_table(got).orderBy("step").collect()
    assert [r["step"] for r in found] == list(range(1, 40))
    assert np.allclose([r["height"] for r in found], want.height, atol=1e-6)
    assert [(r["left_node"], r["right_node"], r["size"]) for r in found] == list(zip(want.left, want.right, want.size))


def test_merged_sizes_stand_for_coincident_rows(spark):
    random = np.random.default_rng(2)
    points, sizes = random.normal(size=(9, 2)), np.array([1, 4, 2, 1, 7, 1, 3, 1, 2])
    want = li.ward_tree(li.euclidean(points), sizes)
    found = merged(spark, points, sizes).table.orderBy("step").collect()
    assert np.allclose([r["height"] for r in found], want.height, atol=1e-6)
    assert [r["size"] for r in found] == list(want.size)


def test_ties_merge_to_the_end(spark):
    corners = np.array([[x, y] for x in (0.0, 1.0, 2.0) for y in (0.0, 1.0, 2.0)])
    got = merged(spark, corners)
    found = got.table.orderBy("step").collect()
    assert [r["step"] for r in found] == list(range(1, 9)) and found[-1]["size"] == 9
    assert [r["height"] for r in found] == sorted(r["height"] for r in found)
    assert merged(spark, corners[:1]).table.count() == 0 and merged(spark, corners[:0]).count == 0
    assert label_array(merged(spark, corners[:1]), 1) == [1]


def test_cuts_are_nested_and_numbered_by_appearance(tree):
    for k in (1, 2, 3, 9, 40):
        assert label_array(tree[1], k) == list(li.labels_at(tree[0], k))
    both = mg.labels(tree[1], {"c3": 3, "c9": 9})
    assert both.select("c3", "c9").distinct().count() == 9
    with pytest.raises(ValueError):
        mg.labels(tree[1], {"c": 41})


def test_cluster_order_follows_the_leaves(tree):
    for k in (2, 5, 40):
        along = li.labels_at(tree[0], k)[li.leaf_order(tree[0])]
        found = mg.cluster_order(tree[1], k).orderBy("place").collect()
        assert [r["cluster"] for r in found] == list(dict.fromkeys(along.tolist()))


def test_cut_by_height_counts_from_the_top(tree):
    heights = [r["height"] for r in tree[1].table.orderBy(F.desc("step")).collect()]
    assert mg.clusters_for(tree[1], h=heights[2]) == 4
    assert mg.clusters_for(tree[1], h=heights[0] + 1) == 2
    assert mg.clusters_for(tree[1], k=6) == 6


@pytest.mark.parametrize("arguments", [{}, {"k": 3, "h": 1.0}, {"k": 1}, {"k": 40}, {"h": -1.0}])
def test_cut_arguments_are_checked(tree, arguments):
    with pytest.raises(ValueError):
        mg.clusters_for(tree[1], **arguments)


# --- silhouettes ------------------------------------------------------------------


def brute_silhouette(points, labels, power):
    gap = np.array([[np.linalg.norm(a - b) ** power for b in points] for a in points])
    widths = []
    for i, own in enumerate(labels):
        mine = labels == own
        if mine.sum() < 2:
            widths.append(0.0)
            continue
        a = gap[i, mine].sum() / (mine.sum() - 1)
        b = min(gap[i, labels == c].mean() for c in set(labels) if c != own)
        widths.append((b - a) / max(a, b))
    return widths


@pytest.fixture(scope="module")
def labelled(spark):
    random = np.random.default_rng(6)
    points, labels = random.normal(size=(50, 3)), random.integers(0, 4, 50)
    labels[0] = 9  # a cluster of one row
    data = [(i, [float(v) for v in p], int(c)) for i, (p, c) in enumerate(zip(points, labels))]
    return points, labels, spark.createDataFrame(data, "id long, x array<double>, label int").repartition(6)


def widths(df):
    return [r["width"] for r in df.orderBy("id").collect()]


def test_squared_silhouette_equals_brute_force(labelled):
    points, labels, df = labelled
    assert np.allclose(widths(si.squared_silhouette(df, "id", "label")), brute_silhouette(points, labels, 2))


def test_distances_by_products_equal_differences():
    """Copies, near copies far from the origin, huge, missing and infinite numbers."""
    random = np.random.default_rng(8)
    a = random.normal(size=(40, 5)) + 1e6
    a[5], a[6], a[7, 2], a[8, 3], a[9] = a[4], a[4] + 1e-7, np.nan, np.inf, 1e200
    b = np.concatenate([a[::-1], random.normal(size=(9, 5))])
    with np.errstate(all="ignore"):
        want = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    for rows in (slice(0, 49), slice(38, 49), slice(33, 36)):
        found = si._euclidean()(a, b[rows])
        assert np.allclose(found, want[:, rows], rtol=1e-9, atol=0, equal_nan=True)


def test_euclidean_silhouette_meets_every_two_blocks_once(spark, monkeypatch):
    """Wide vectors and many labels make blocks small, and no two blocks meet twice."""
    random = np.random.default_rng(2)
    points, labels = random.normal(size=(90, 3)), random.integers(0, 4, 90)
    data = [(i, [float(v) for v in p], int(c)) for i, (p, c) in enumerate(zip(points, labels))]
    df = spark.createDataFrame(data, "id long, x array<double>, label int")
    given, blocks = [], si.in_blocks
    monkeypatch.setattr(si, "in_blocks", lambda *a, **k: given.append((a, k)) or blocks(*a, **k))
    monkeypatch.setattr(si, "PAIRED_SUMS", 100)
    monkeypatch.setattr(si, "PAIRED_NUMBERS", 75)
    found = si.euclidean_silhouette(df, "id", "label")
    assert np.allclose(widths(found), brute_silhouette(points, labels, 1))
    assert given[0][0][4] == 25 and not given[0][1].get("both_sides")


@pytest.mark.parametrize("block_rows", [1000, 7])
def test_euclidean_silhouette_equals_brute_force(labelled, block_rows):
    points, labels, df = labelled
    found = si.euclidean_silhouette(df, "id", "label", block_rows=block_rows)
    assert np.allclose(widths(found), brute_silhouette(points, labels, 1))
    assert all(-1 <= w <= 1 for w in widths(found))
    assert found.count() == len(points)


@pytest.mark.parametrize("block", [1, 2, 3])
def test_labels_come_in_blocks(labelled, block):
    points, labels, df = labelled
    found = si.squared_silhouette(df, "id", "label", block_labels=block)
    assert np.allclose(widths(found), brute_silhouette(points, labels, 2))
    whole = si.squared_silhouette(df, "id", "label").select("id", "neighbour").collect()
    assert sorted(found.select("id", "neighbour").collect()) == sorted(whole)


def test_twenty_thousand_labels(spark):
    """Two rows a label, far from all others: every width is near 1."""
    rows = spark.range(40_000).select(
        "id",
        F.floor(F.col("id") / 2).cast("int").alias("label"),
        F.array(F.floor(F.col("id") / 2) * 10.0, (F.col("id") % 2).cast("double")).alias("x"),
    )
    found = si.squared_silhouette(rows, "id", "label").agg(F.count("*"), F.min("width"), F.max("width")).first()
    assert found[0] == 40_000 and found[1] > 0.98 and found[2] < 1


def test_one_label_has_no_neighbour(labelled):
    df = labelled[2].withColumn("label", F.lit(1))
    assert {(r["neighbour"], r["width"]) for r in si.squared_silhouette(df, "id", "label").collect()} == {(None, 0.0)}


def test_nested_silhouettes_equal_one_per_cut(spark, labelled):
    points, labels, df = labelled
    levels = {4: {0: 0, 1: 1, 2: 2, 3: 2, 9: 3}, 2: {0: 0, 1: 0, 2: 1, 3: 1, 9: 1}, 5: {v: v for v in (0, 1, 2, 3, 9)}}
    rows = [(finest, k, cut) for k, to in levels.items() for finest, cut in to.items()]
    cuts = spark.createDataFrame([(f, k, c) for f, k, c in rows], "label int, k int, cut int")
    found = {r["k"]: r["mean_silhouette"] for r in si.nested_silhouettes(df, "label", cuts).collect()}
    assert set(found) == {2, 4, 5}
    for k, to in levels.items():
        joined = np.array([to[v] for v in labels])
        assert found[k] == pytest.approx(np.mean(brute_silhouette(points, joined, 2)))
    with pytest.raises(ValueError):
        si.nested_silhouettes(df, "label", cuts, most=10)


# --- clusters -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def blobs(spark):
    random = np.random.default_rng(8)
    centres = np.array([[0, 0], [0, 9], [30, 0], [30, 9], [60, 60]])
    truth = random.integers(0, 5, 300)
    points = centres[truth] + random.normal(size=(300, 2))
    return truth, points, make(spark, points).cache()


def labels_of(df, column):
    return [r[column] for r in df.orderBy("client_id").collect()]


def test_exact_clusters_equal_the_full_tree(blobs):
    truth, points, df = blobs
    fitted = cl.fit_micro(df)
    assert fitted.exact and len(fitted.points) == 300
    got = labels_of(cl.assign(df, fitted, {"c": 5}), "c")
    assert same_partition(got, li.labels_at(li.ward_tree(li.euclidean(points)), 5))
    assert same_partition(got, truth)


def test_micro_clusters_find_the_same_groups(blobs):
    truth, _, df = blobs
    fitted = cl.fit_micro(df, micro=30)
    assert not fitted.exact and len(fitted.points) <= 30 and fitted.sizes.sum() == 300
    placed = cl.assign(df, fitted, {"c3": 3, "c5": 5})
    assert same_partition(labels_of(placed, "c5"), truth)
    assert placed.select("c3", "c5").distinct().count() == 5


@pytest.mark.parametrize("method", ["euclidean", "squared"])
def test_sweep_equals_one_silhouette_per_cut(blobs, method):
    _, points, df = blobs
    fitted = cl.fit_micro(df)
    sweep = cl.silhouette_sweep(df, fitted, [2, 5, 8, 400], method).collect()
    assert [r["k"] for r in sorted(sweep)] == [2, 5, 8] and {r["method"] for r in sweep} == {method}
    for r in sweep:
        labels = np.array(labels_of(cl.assign(df, fitted, {"c": r["k"]}), "c"))
        want = np.mean(brute_silhouette(points, labels, 1 if method == "euclidean" else 2))
        assert r["mean_silhouette"] == pytest.approx(want, abs=1e-6)


def test_sweep_over_micro_points_is_close_and_finds_the_groups(blobs):
    _, points, df = blobs
    fitted = cl.fit_micro(df, micro=60)
    sweep = cl.silhouette_sweep(df, fitted, list(range(2, 9)))
    assert cl.choose_k(sweep) in (3, 5)
    labels = np.array(labels_of(cl.assign(df, fitted, {"c": 5}), "c"))
    found = sweep.filter("k = 5").first()["mean_silhouette"]
    assert found == pytest.approx(np.mean(brute_silhouette(points, labels, 1)), abs=0.02)
    with pytest.raises(ValueError):
        cl.silhouette_sweep(df, fitted, [2], "other")


def test_tree_order_gives_extents_of_whole_clusters(spark, blobs):
    fitted = cl.fit_micro(blobs[2], micro=30)
    placed = cl.assign(blobs[2], fitted, {"cluster": 5})
    order = cl.tree_order(fitted, 5)
    extents = la.cluster_extents(la.cluster_sizes(placed).join(order, "cluster"), "cluster", "place")
    found = extents.orderBy("position").collect()
    built = li.ward_tree(li.euclidean(fitted.points), fitted.sizes)
    along = li.labels_at(built, 5)[li.leaf_order(built)]
    assert [r["cluster"] for r in found] == list(dict.fromkeys(along))
    assert found[0]["first"] == 1 and found[-1]["last"] == 300


def test_rows_carry_the_distance_to_their_point(blobs):
    exact = cl.assign(blobs[2], cl.fit_micro(blobs[2]), {})
    near = cl.assign(blobs[2], cl.fit_micro(blobs[2], micro=30), {})
    assert exact.agg(F.max("dist")).first()[0] < 1e-5 < near.agg(F.max("dist")).first()[0]


def test_micro_table_lists_every_point(spark, blobs):
    fitted = cl.fit_micro(blobs[2], micro=30)
    found = cl.micro_table(fitted, {"c3": 3})
    assert found.agg(F.sum("rows")).first()[0] == 300
    assert mg.merge_table(fitted.merges).count() == len(fitted.points) - 1


def test_labels_rank_by_median_inside_parents(spark):
    data = [("p", "p1", 10.0), ("p", "p1", 12.0), ("p", "p2", 1.0), ("q", "q1", 5.0), ("q", "q2", 5.0)]
    df = spark.createDataFrame(data, "c string, f string, m double")
    found = {r["f"]: r["cluster"] for r in la.canonical_labels(df, "c", "f", "m").collect()}
    # Medians: q 5, p 10; inside q a tie goes to the lower label.
    assert found == {"q1": "1.1", "q2": "1.2", "p2": "2.1", "p1": "2.2"}


@pytest.fixture(scope="module")
def extents(spark):
    sizes = spark.createDataFrame([("b", 3), ("a", 2), ("c", 4)], "cluster string, n long")
    return la.cluster_extents(sizes, "cluster", "cluster")


def test_extents_run_on(extents, rows):
    assert rows(extents) == [(1, "a", 2, 1, 2), (2, "b", 3, 3, 5), (3, "c", 4, 6, 9)]


def test_extents_by_position_and_by_row(extents):
    def chosen(**arguments):
        return sorted(r["cluster"] for r in la.select_extents(extents, **arguments).collect())

    assert chosen() == ["a", "b", "c"] and chosen(which=[3, 1]) == ["a", "c"]
    assert chosen(x=[2.0, 2.5]) == ["a", "b"] and chosen(x=[9]) == ["c"]
    for wrong in ({"which": [4]}, {"x": [9.5]}, {"x": [0]}, {"which": [1], "x": [1]}):
        with pytest.raises(ValueError):
            chosen(**wrong)


def test_members_are_the_rows_of_chosen_clusters(spark, extents):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(9)], "client_id long, cluster string")
    assert la.members(df, "cluster", la.select_extents(extents, which=[2])).count() == 3


def test_profile_shows_shares_above_one_percent(spark):
    data = [(c, 100.0 * (i + 1), 99.5 * (i + 1), 0.5 * (i + 1)) for c in ("x", "y") for i in range(5)]
    data = [(c, m * (2 if c == "x" else 1), a * (2 if c == "x" else 1), b) for c, m, a, b in data]
    df = spark.createDataFrame(data, "cluster string, mins double, mins_a double, mins_b double")
    found = la.cluster_profile(df, "cluster", ["a", "b"]).collect()
    assert [(r["cluster"], r["cluster_rank"], r["dim"]) for r in sorted(found)] == [("x", 2, "a"), ("y", 1, "a")]
    assert {r["cluster"]: (r["mins"], r["hours"]) for r in found} == {"x": (600.0, 10.0), "y": (300.0, 5.0)}


def test_spread_uses_positive_values_only(spark):
    df = spark.createDataFrame([("x", m, m) for m in (0.0, 60.0, 120.0, 180.0)], "cluster string, mins double, costs double")
    found = la.hours_by_cluster(df, "cluster").first()
    assert (found["n"], found["p50"]) == (3, 2.0)
    assert la.costs_by_cluster(df, "cluster").first()["p50"] == pytest.approx(0.12)


@pytest.fixture(scope="module")
def care(spark):
    random = np.random.default_rng(9)
    kinds = random.integers(0, 3, 120)
    base = np.array([[500, 5, 0], [5, 500, 0], [0, 5, 900]])[kinds]
    minutes = np.round(base * random.uniform(0.5, 1.5, (120, 3)))
    data = [(i, float(m.sum()), *[float(v) for v in m], 7.0) for i, m in enumerate(minutes)]
    return kinds, spark.createDataFrame(
        data, "client_id long, mins double, mins_a double, mins_b double, mins_c double, mins_prev double"
    )


def test_trajectories_give_every_patient_one_nested_label(care):
    kinds, df = care
    found = tr.patients_with_clusters(df).collect()
    assert len(found) == 120
    labels = [r["cluster"] for r in sorted(found, key=lambda r: r["client_id"])]
    assert len(set(labels)) == 9 and {c.split(".")[0] for c in labels} == {"1", "2", "3"}
    assert same_partition([c.split(".")[0] for c in labels], kinds)


def test_trajectories_do_not_depend_on_partitions(care):
    _, df = care
    one = tr.trajectory_clusters(df.coalesce(1)).clusters
    many = tr.trajectory_clusters(df.repartition(7)).clusters
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_automatic_number_of_clusters(care):
    found = tr.trajectory_clusters(care[1], k="auto").clusters
    assert found.select("cluster").distinct().count() == 3


@pytest.mark.parametrize("minutes", [[5.0], [5.0, 5.0], [5.0, 9.0]])
def test_very_few_patients_still_get_a_cluster(spark, minutes):
    data = [(i, m, m, 1.0) for i, m in enumerate(minutes)]
    df = spark.createDataFrame(data, "client_id long, mins double, mins_a double, mins_b double")
    found = tr.trajectory_clusters(df).clusters
    assert found.count() == len(minutes)
    assert found.select("cluster").distinct().count() == len(set(minutes))


def test_points_do_not_depend_on_the_layout(spark):
    from cohortline.operators import clustering as cl

    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(700)]
    found = []
    for parts in (1, 3, 16):
        mixed = spark.createDataFrame(rows[::-1] if parts == 3 else rows, "client_id long, x array<double>")
        fitted = cl.fit_micro(mixed.repartition(parts), 40)
        labels = cl.assign(mixed, fitted, {"c": 5}).select("client_id", "c").collect()
        found.append((fitted.points.tolist(), fitted.sizes.tolist(), sorted(map(tuple, labels))))
    assert found[0] == found[1] == found[2]
    assert len(found[0][0]) <= 40 and sum(found[0][1]) == 700
