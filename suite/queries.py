"""One query per operator, over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cohortline.core.workspace import materialise, scratch_dir
from cohortline.functions import columns as fc
from cohortline.functions import distribution as di
from cohortline.operators import clustering as cl
from cohortline.operators import cohort as co
from cohortline.operators import distance as ds
from cohortline.operators import embedding as em
from cohortline.operators import labels as la
from cohortline.operators import merging as mg
from cohortline.operators import postcode as pc
from cohortline.operators import privacy as pr
from cohortline.operators import profile as pf
from cohortline.operators import scoring as sc
from cohortline.operators import silhouette as si
from cohortline.operators import slots as sl
from cohortline.operators import summaries as su
from cohortline.operators import timeline as tl
from cohortline.plans import extract as ex
from cohortline.plans import patients as pl
from cohortline.plans import trajectories as tr
from cohortline.sources.tables import read_semicolon_csv, read_sheet, read_tables, write_tables
from suite import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _cohort(spark: SparkSession, folder: str) -> DataFrame:
    return pl.stored_cohort(b.care_tables(spark, folder), b.SPEC)


def _timeline(spark: SparkSession, folder: str, categories: bool = True) -> DataFrame:
    care = b.care_tables(spark, folder)
    return pl.cohort_timeline(care, pl.stored_cohort(care, b.SPEC), b.SPEC, categories)


def _categories(spark: SparkSession, folder: str) -> list[str]:
    return tl.category_values(b.intervention_types(spark, folder))


def _study(spark: SparkSession, folder: str) -> pl.Study:
    return pl.start_study(b.care_tables(spark, folder), b.SPEC)


# --- cohort -----------------------------------------------------------------


@query
def target_codes(spark: SparkSession, folder: str) -> DataFrame:
    return co.target_codes(b.dx_codes(spark, folder), b.SPEC.code_pattern)


@query
def target_codes_of_group(spark: SparkSession, folder: str) -> DataFrame:
    """Target codes of one major group only; the first character stands for the group."""
    codes = b.dx_codes(spark, folder).withColumn("major_nl", F.substring("dx_code", 1, 1))
    return co.target_codes(codes, b.SPEC.code_pattern, "1")


@query
def first_diagnosis(spark: SparkSession, folder: str) -> DataFrame:
    return co.first_diagnosis(b.dx(spark, folder), b.SPEC)


@query
def index_event(spark: SparkSession, folder: str) -> DataFrame:
    return co.index_event(b.dx(spark, folder), b.dx_codes(spark, folder), b.SPEC)


@query
def index_cohort(spark: SparkSession, folder: str) -> DataFrame:
    care = b.care_tables(spark, folder)
    return co.newest_first(co.index_cohort(care.dx, care.dx_codes, care.clients, b.SPEC))


@query
def attrition(spark: SparkSession, folder: str) -> DataFrame:
    care = b.care_tables(spark, folder)
    index = materialise(co.index_event(care.dx, care.dx_codes, b.SPEC), "index")
    follow_up = su.post_index_summary(pl.cohort_timeline(care, index, b.SPEC, False))
    costs = co.episode_costs(care.dbc, index)
    return co.attrition(care.dx, care.dx_codes, care.clients, costs, follow_up, b.SPEC)


@query
def episode_costs(spark: SparkSession, folder: str) -> DataFrame:
    costs = co.episode_costs(b.dbc(spark, folder), _cohort(spark, folder))
    return costs.select("client_id", F.round("costs", 2).alias("costs"))


@query
def episode_costs_of_type(spark: SparkSession, folder: str) -> DataFrame:
    """Costs of one type of episode; expensive ones stand for a type."""
    kind = F.when(F.col("claimed") > 100000, "long").otherwise("short")
    episodes = b.dbc(spark, folder).withColumn("GGZ_type", kind)
    costs = co.episode_costs(episodes, _cohort(spark, folder), "long")
    return costs.select("client_id", F.round("costs", 2).alias("costs"))


# --- care before and after the index date ------------------------------------


@query
def event_timeline(spark: SparkSession, folder: str) -> DataFrame:
    return _timeline(spark, folder)


@query
def compact_timeline(spark: SparkSession, folder: str) -> DataFrame:
    return tl.compact(_timeline(spark, folder))


@query
def prior_care_summary(spark: SparkSession, folder: str) -> DataFrame:
    return su.prior_care_summary(_timeline(spark, folder, False))


@query
def post_index_summary(spark: SparkSession, folder: str) -> DataFrame:
    return su.post_index_summary(_timeline(spark, folder, False))


@query
def activity_long(spark: SparkSession, folder: str) -> DataFrame:
    return su.activity_long(tl.in_periods(_timeline(spark, folder), (tl.FOLLOW_UP,)))


@query
def activity_mins_wide(spark: SparkSession, folder: str) -> DataFrame:
    return su.activity_features(_timeline(spark, folder), _categories(spark, folder), True)


@query
def activity_n_wide(spark: SparkSession, folder: str) -> DataFrame:
    return su.activity_features(_timeline(spark, folder), _categories(spark, folder), False)


@query
def activity_totals(spark: SparkSession, folder: str) -> DataFrame:
    return su.activity_totals(_timeline(spark, folder))


@query
def client_month_summary(spark: SparkSession, folder: str) -> DataFrame:
    return su.client_month_summary(_timeline(spark, folder, False))


@query
def client_month_features(spark: SparkSession, folder: str) -> DataFrame:
    return su.client_month_features(_timeline(spark, folder), _categories(spark, folder))


@query
def team_minutes(spark: SparkSession, folder: str) -> DataFrame:
    return su.team_minutes(_timeline(spark, folder, False))


@query
def dominant_team(spark: SparkSession, folder: str) -> DataFrame:
    return su.dominant_team(_timeline(spark, folder, False), b.teams(spark, folder))


@query
def patients(spark: SparkSession, folder: str) -> DataFrame:
    table = pl.assemble_patients(_study(spark, folder))
    return table.withColumn("costs", F.round("costs", 2))


@query
def demo_extract(spark: SparkSession, folder: str) -> DataFrame:
    """All diagnoses of ten clients of the cohort: the bundle for demonstrations."""
    drawn = pl.demo_clients(_cohort(spark, folder))
    return pl.case_bundle({"dx": b.dx(spark, folder)}, drawn)["dx"]


@query
def activity_maps(spark: SparkSession, folder: str) -> DataFrame:
    """Events by category as maps, written out as text in the order of the categories."""
    maps = su.activity_maps(tl.in_periods(_timeline(spark, folder), (tl.FOLLOW_UP,)))
    entry = lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    written = F.array_join(F.transform(F.array_sort(F.map_entries("n")), entry), ";")
    return maps.select("client_id", F.size("n").cast("long").alias("categories"), written.alias("events"))


@query
def activity_from_maps(spark: SparkSession, folder: str) -> DataFrame:
    """The wide counts of every category, taken from the maps."""
    maps = su.activity_maps(tl.in_periods(_timeline(spark, folder), (tl.FOLLOW_UP,)))
    categories = _categories(spark, folder)
    return su.widen_maps(maps, categories).select("client_id", *[fc.named(f"n_{c}") for c in categories])


@query
def category_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return su.category_catalogue(b.intervention_types(spark, folder))


def _bundle(spark: SparkSession, folder: str, name: str) -> DataFrame:
    cohort = _cohort(spark, folder)
    tables: dict[str, Callable[[], DataFrame]] = {
        "dx": lambda: b.dx(spark, folder),
        "clients": lambda: b.clients(spark, folder),
        "dbc": lambda: b.dbc(spark, folder),
        "interventions": lambda: b.interventions(spark, folder, cohort.select("client_id")),
    }
    return pl.case_bundle({name: tables[name]()}, cohort)[name]


@query
def case_bundle_dx(spark: SparkSession, folder: str) -> DataFrame:
    return _bundle(spark, folder, "dx")


@query
def case_bundle_clients(spark: SparkSession, folder: str) -> DataFrame:
    return _bundle(spark, folder, "clients")


@query
def case_bundle_dbc(spark: SparkSession, folder: str) -> DataFrame:
    return _bundle(spark, folder, "dbc")


@query
def case_bundle_interventions(spark: SparkSession, folder: str) -> DataFrame:
    return _bundle(spark, folder, "interventions")


# --- scores, slots and diagnoses ----------------------------------------------


@query
def score_union(spark: SparkSession, folder: str) -> DataFrame:
    return sc.score_union(b.score_tables(spark, folder))


@query
def slot_occupancy(spark: SparkSession, folder: str) -> DataFrame:
    return sl.slot_occupancy(b.scores(spark, folder), ["client_id", "year", "month"])


@query
def score_months_wide(spark: SparkSession, folder: str) -> DataFrame:
    return sl.score_months_wide(b.scores(spark, folder), ("ts", "event_id"))


@query
def score_days_wide(spark: SparkSession, folder: str) -> DataFrame:
    table = b.scores(spark, folder)
    return sl.score_months_wide(table, ("ts", "event_id"), 6, ("client_id", "date"))


@query
def any_non_null(spark: SparkSession, folder: str) -> DataFrame:
    return sl.with_content(b.dx(spark, folder))


@query
def diagnosis_months_wide(spark: SparkSession, folder: str) -> DataFrame:
    return sl.diagnosis_months_wide(b.dx(spark, folder), ("date", "o_orderkey"))


@query
def raw_scores(spark: SparkSession, folder: str) -> DataFrame:
    raw = sc.raw_scores(b.items(spark, folder), b.rules(spark))
    return raw.withColumn("raw", F.round("raw", 4))


@query
def score_instruments(spark: SparkSession, folder: str) -> DataFrame:
    scored = sc.score_instruments(b.items(spark, folder), b.rules(spark), b.norms(spark))
    return scored.withColumn("score", F.round("score", 4))


@query
def score_instrument(spark: SparkSession, folder: str) -> DataFrame:
    """Every instrument scored from its own item table, one call each."""
    items, rules, norms = b.items(spark, folder), b.rules(spark), b.norms(spark)
    parts = [
        sc.score_instrument(items.filter(F.col("rom") == rom).drop("rom"), rules, norms, rom)
        for rom in b.INSTRUMENTS
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("score", F.round("score", 4))


@query
def score_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """Item tables of all instruments, scored in one aggregate."""
    items = b.items(spark, folder)
    tables = {rom: items.filter(F.col("rom") == rom).drop("rom") for rom in b.INSTRUMENTS}
    scored = sc.score_bundle(tables, b.rules(spark), b.norms(spark))
    return scored.withColumn("score", F.round("score", 4))


# --- postcodes, keys, text and files --------------------------------------------


def _postcode(spark: SparkSession, folder: str) -> DataFrame:
    return pc.postcode_dimension(
        b.postcode_statistics(spark, folder), b.liveability(spark, folder)
    )


@query
def postcode_dimension(spark: SparkSession, folder: str) -> DataFrame:
    return _postcode(spark, folder)


@query
def numeric_min_check(spark: SparkSession, folder: str) -> DataFrame:
    return fc.numeric_minimum(_postcode(spark, folder))


@query
def enrich_by_postcode(spark: SparkSession, folder: str) -> DataFrame:
    people = b.clients(spark, folder).withColumnRenamed("date", "enroll_date")
    return pc.enrich_by_postcode(people, materialise(_postcode(spark, folder), "postcode"))


@query
def decimal_comma_csv(spark: SparkSession, folder: str) -> DataFrame:
    customers = b.table(spark, folder, "customer")
    path = f"{scratch_dir(spark)}/cohortline/csv-{uuid.uuid4().hex}"
    text = F.regexp_replace(F.col("c_acctbal").cast("string"), r"\.", ",")
    customers.select("c_custkey", "c_name", text.alias("c_acctbal")).write.option(
        "sep", ";"
    ).option("header", True).csv(path)
    schema = T.StructType(
        [
            T.StructField("c_custkey", T.LongType()),
            T.StructField("c_name", T.StringType()),
            T.StructField("c_acctbal", T.DoubleType()),
        ]
    )
    return read_semicolon_csv(spark, path, schema)


@query
def null_sentinel_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Customers written as a sheet in which one segment stands as ``-``, and read back."""
    path = f"{scratch_dir(spark)}/cohortline/sheet-{uuid.uuid4().hex}"
    segment = F.col("c_mktsegment")
    sheet = b.table(spark, folder, "customer").select(
        "c_custkey", F.when(segment == "HOUSEHOLD", "-").otherwise(segment).alias("c_mktsegment"), "c_acctbal"
    )
    sheet.write.option("header", True).csv(path)
    return read_sheet(spark, path, sheet.schema, "-")


@query
def saved_patients(spark: SparkSession, folder: str) -> DataFrame:
    """The patient table written under its name and loaded again."""
    path = f"{scratch_dir(spark)}/cohortline/saved-{uuid.uuid4().hex}"
    table = pl.assemble_patients(_study(spark, folder)).withColumn("costs", F.round("costs", 2))
    write_tables({"patients": table}, path)
    return read_tables(spark, path, ["patients"])["patients"]


@query
def clean_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    documents = b.table(spark, folder, "documents")
    return tl.clean_descriptions(documents, "text").select("doc_id", "text")


@query
def pseudonymise_patients(spark: SparkSession, folder: str) -> DataFrame:
    table = _patients(spark, folder).withColumn("costs", F.round("costs", 2))
    return pr.pseudonymise(table, b.client_keys(spark, folder))


@query
def pseudonymise_months(spark: SparkSession, folder: str) -> DataFrame:
    months = su.client_month_summary(_timeline(spark, folder, False))
    return pr.pseudonymise(months, b.client_keys(spark, folder))


@query
def pseudonymise_scores(spark: SparkSession, folder: str) -> DataFrame:
    wide = sl.score_months_wide(b.scores(spark, folder), ("ts", "event_id"))
    return pr.pseudonymise(wide, b.client_keys(spark, folder))


@query
def pseudonymise_diagnoses(spark: SparkSession, folder: str) -> DataFrame:
    wide = sl.diagnosis_months_wide(b.dx(spark, folder), ("date", "o_orderkey"))
    return pr.pseudonymise(wide, b.client_keys(spark, folder), "drop")


# --- profiles and distances -----------------------------------------------------

def _patients(spark: SparkSession, folder: str) -> DataFrame:
    """The patient table, built anew by every query that starts from it."""
    return materialise(pl.assemble_patients(_study(spark, folder)), "patients")


def _profile(spark: SparkSession, folder: str) -> DataFrame:
    return pf.profile_matrix(_patients(spark, folder))


def _minutes(spark: SparkSession, folder: str, patients: DataFrame | None = None) -> DataFrame:
    """Profile vectors in whole minutes: the distance has no unit, and sums are exact."""
    patients = patients or _patients(spark, folder)
    columns = [fc.named(f"mins_{d}").alias(d) for d in pf.profile_dims(patients)]
    return pf.as_vector(patients.select("client_id", *columns))


@query
def profile_long(spark: SparkSession, folder: str) -> DataFrame:
    return pf.to_long(_profile(spark, folder))


@query
def zero_variance_filter(spark: SparkSession, folder: str) -> DataFrame:
    profile = _profile(spark, folder).withColumn("never", F.lit(0.0))
    return pf.to_long(pf.drop_constant(profile))


@query
def rescale_log_minmax(spark: SparkSession, folder: str) -> DataFrame:
    scaled = pf.rescale(_profile(spark, folder), "log_minmax")
    return pf.to_long(scaled, "value").withColumn("value", F.round("value", 9))


@query
def rescale_bins(spark: SparkSession, folder: str) -> DataFrame:
    scaled = pf.rescale(pf.rescale(_profile(spark, folder), "log_minmax"), "bins")
    return pf.to_long(scaled, "value")


@query
def rescale_max(spark: SparkSession, folder: str) -> DataFrame:
    return pf.to_long(pf.rescale(_profile(spark, folder), "max"), "value")


@query
def rescale_over_one(spark: SparkSession, folder: str) -> DataFrame:
    return pf.to_long(pf.rescale(_profile(spark, folder), "over_one"), "value")


@query
def rescale_minus_one(spark: SparkSession, folder: str) -> DataFrame:
    return pf.to_long(pf.rescale(_profile(spark, folder), "minus_one"), "value")


def _to_genders(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All profiles, and the mean profile of each gender as the table that they are compared with."""
    patients = _patients(spark, folder)
    return _minutes(spark, folder, patients), b.gender_profiles(patients, pf.profile_dims(patients))


@query
def anchor_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Every patient against the mean profile of each gender."""
    return ds.anchor_distances(*_to_genders(spark, folder)).withColumn("dist", F.round("dist", 9))


@query
def anchor_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return ds.anchor_histogram(*_to_genders(spark, folder))


@query
def profile_classes(spark: SparkSession, folder: str) -> DataFrame:
    return ds.profile_classes(_minutes(spark, folder))


@query
def similar_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of profiles at a distance of at most 0.25."""
    return ds.similar_profiles(_minutes(spark, folder), 0.25).withColumn("dist", F.round("dist", 9))


@query
def distance_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return ds.distance_histogram(_minutes(spark, folder))


# --- clusters that are given ------------------------------------------------------


@query
def silhouette_squared(spark: SparkSession, folder: str) -> DataFrame:
    widths = si.squared_silhouette(b.labelled_vectors(spark, folder), "vec_id", "label")
    return widths.withColumn("width", F.round("width", 6))


@query
def silhouette_euclidean(spark: SparkSession, folder: str) -> DataFrame:
    widths = si.euclidean_silhouette(b.labelled_vectors(spark, folder), "vec_id", "label")
    return widths.withColumn("width", F.round("width", 6))


@query
def silhouette_by_label(spark: SparkSession, folder: str) -> DataFrame:
    widths = si.squared_silhouette(b.labelled_vectors(spark, folder), "vec_id", "label")
    means = si.mean_silhouette(widths, "label")
    return means.withColumn("mean_width", F.round("mean_width", 6))


@query
def nested_silhouettes(spark: SparkSession, folder: str) -> DataFrame:
    """Mean widths of three nested cuts that are given."""
    known = b.labelled_vectors(spark, folder).filter("label is not null")
    means = si.nested_silhouettes(known, "label", b.nested_cuts(spark, folder))
    return means.withColumn("mean_silhouette", F.round("mean_silhouette", 6))


@query
def best_nested_cut(spark: SparkSession, folder: str) -> DataFrame:
    """The number of clusters that the widths of the given cuts speak for."""
    return nested_silhouettes(spark, folder).orderBy(F.desc("mean_silhouette"), "k").limit(1)


@query
def canonical_labels(spark: SparkSession, folder: str) -> DataFrame:
    people = b.labelled_customers(spark, folder)
    return la.canonical_labels(people, "coarse", "fine", "measure").select("client_id", "cluster")


@query
def cluster_names(spark: SparkSession, folder: str) -> DataFrame:
    return la.cluster_names(b.labelled_customers(spark, folder), "coarse", "fine", "measure")


@query
def cluster_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return la.cluster_sizes(b.labelled_customers(spark, folder), "fine")


@query
def cluster_extents(spark: SparkSession, folder: str) -> DataFrame:
    sizes = la.cluster_sizes(b.labelled_customers(spark, folder), "fine")
    return la.cluster_extents(sizes, "fine", "fine")


@query
def cluster_members(spark: SparkSession, folder: str) -> DataFrame:
    people = b.labelled_customers(spark, folder)
    extents = la.cluster_extents(la.cluster_sizes(people, "fine"), "fine", "fine")
    return la.members(people, "fine", la.select_extents(extents, which=[1, 4]))


@query
def median_by_group(spark: SparkSession, folder: str) -> DataFrame:
    lines = b.table(spark, folder, "lineitem")
    return di.group_medians(lines, ["l_returnflag"], "l_extendedprice")


@query
def trimmed_mean_by_group(spark: SparkSession, folder: str) -> DataFrame:
    lines = b.table(spark, folder, "lineitem")
    means = la.trimmed_mean_by_group(
        lines, "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount"]
    )
    return means.withColumn("score", F.round("score", 6))


@query
def cluster_profile(spark: SparkSession, folder: str) -> DataFrame:
    patients = _patients(spark, folder)
    table = la.cluster_profile(patients, "gender", pf.profile_dims(patients))
    return table.withColumns({"score": F.round("score", 6), "mins": F.round("mins", 6)})


def _rounded(table: DataFrame) -> DataFrame:
    return table.withColumns({c: F.round(c, 8) for c in la.SPREAD})


@query
def hours_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(la.hours_by_cluster(_patients(spark, folder), "gender"))


@query
def cost_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(la.costs_by_cluster(_patients(spark, folder), "gender"))


# --- clusters that are found (no SQL: eigenvectors and linkage) --------------------


def _embedded(spark: SparkSession, folder: str) -> tuple[DataFrame, em.Landmarks]:
    return tr.embed_patients(_patients(spark, folder))


@query
def landmark_mds(spark: SparkSession, folder: str) -> DataFrame:
    return _embedded(spark, folder)[0]


@query
def scree(spark: SparkSession, folder: str) -> DataFrame:
    return em.scree(spark, _embedded(spark, folder)[1])


@query
def ward_labels(spark: SparkSession, folder: str) -> DataFrame:
    coordinates, _ = _embedded(spark, folder)
    return cl.assign(coordinates, cl.fit_micro(coordinates), {"c3": 3, "ck": 9}).drop("x")


@query
def merge_tree(spark: SparkSession, folder: str) -> DataFrame:
    return mg.merge_table(cl.fit_micro(_embedded(spark, folder)[0]).merges)


@query
def cut_by_height(spark: SparkSession, folder: str) -> DataFrame:
    coordinates, _ = _embedded(spark, folder)
    fitted = cl.fit_micro(coordinates)
    sixth = fitted.merges.table.orderBy(F.desc("step")).limit(6).agg(F.min("height")).first()[0]
    k = mg.clusters_for(fitted.merges, h=sixth)
    return la.cluster_sizes(cl.assign(coordinates, fitted, {"cluster": k}))


@query
def tree_extents(spark: SparkSession, folder: str) -> DataFrame:
    coordinates, _ = _embedded(spark, folder)
    fitted = cl.fit_micro(coordinates)
    sizes = la.cluster_sizes(cl.assign(coordinates, fitted, {"cluster": 9}))
    placed = sizes.join(cl.tree_order(fitted, 9), "cluster")
    return la.cluster_extents(placed, "cluster", "place")


@query
def silhouette_sweep(spark: SparkSession, folder: str) -> DataFrame:
    coordinates, _ = _embedded(spark, folder)
    return cl.silhouette_sweep(coordinates, cl.fit_micro(coordinates), list(range(2, 51)))


@query
def choose_k(spark: SparkSession, folder: str) -> DataFrame:
    coordinates, _ = _embedded(spark, folder)
    sweep = cl.silhouette_sweep(coordinates, cl.fit_micro(coordinates), tr.SWEEP)
    return sweep.orderBy(F.desc("mean_silhouette"), "k").limit(1)


@query
def trajectory_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return tr.trajectory_clusters(_patients(spark, folder)).clusters


@query
def trajectory_silhouette(spark: SparkSession, folder: str) -> DataFrame:
    found = tr.trajectory_clusters(_patients(spark, folder))
    placed = found.coordinates.join(found.clusters, "client_id")
    return si.euclidean_silhouette(placed, "client_id", "cluster")


@query
def attached_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Patients with the readable name of a cluster that is given: by gender and decade of birth."""
    people = _patients(spark, folder)
    decade = F.floor(F.col("year_of_birth") / 10).cast("string")
    given = people.select("client_id", F.concat_ws(".", "gender", decade).alias("cluster"))
    attached = tr.attach_clusters(people, materialise(given, "clusters"))
    return attached.select("client_id", "cluster", "n", "mins")


@query
def extract_order(spark: SparkSession, folder: str) -> DataFrame:
    """Where each client-month stands in the extract."""
    months = su.client_month_summary(_timeline(spark, folder, False))
    return ex.with_position(months).select("position", "client_id", "year", "month", "n")


@query
def column_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of the month summary's columns, as they come back from a saved table."""
    path = f"{scratch_dir(spark)}/cohortline/labels-{uuid.uuid4().hex}"
    write_tables({"months": su.client_month_summary(_timeline(spark, folder, False))}, path)
    return fc.label_table(read_tables(spark, path, ["months"])["months"])


def _extract(spark: SparkSession, folder: str, name: str) -> DataFrame:
    tables = ex.build_extract(
        b.care_tables(spark, folder),
        b.scores(spark, folder).drop("ts", "event_id"),
        materialise(_postcode(spark, folder), "postcode"),
        b.client_keys(spark, folder),
        b.SPEC,
        ("date", "o_orderkey"),
    )
    return tables[name]


@query
def extract_patients(spark: SparkSession, folder: str) -> DataFrame:
    return _extract(spark, folder, "patients")


def _extract_months(spark: SparkSession, folder: str, name: str) -> DataFrame:
    study = _study(spark, folder)
    selected = materialise(pl.assemble_patients(study), "patients")
    scores = b.scores(spark, folder).drop("ts", "event_id")
    tables = ex.month_tables(study, selected, scores, ("date", "o_orderkey"))
    return pr.pseudonymise(tables[name], b.client_keys(spark, folder))


@query
def extract_months(spark: SparkSession, folder: str) -> DataFrame:
    return _extract_months(spark, folder, "patient_months_interventions")


@query
def extract_diagnoses(spark: SparkSession, folder: str) -> DataFrame:
    return _extract_months(spark, folder, "patient_months_diagnoses")


@query
def extract_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _extract_months(spark, folder, "patient_months_romscores")
