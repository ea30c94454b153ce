import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortline.core.spec import CohortSpec
from cohortline.operators import cohort as co
from cohortline.operators import summaries as su
from cohortline.operators import timeline as tl
from cohortline.sources.roles import bind, check_role

D = dt.date
SPEC = CohortSpec(tie_break=("dx_id",))


@pytest.fixture(scope="module")
def codes(spark):
    data = [("dep1", "296.23"), ("dep2", "296x31"), ("dep1", "296.20"), ("anx", "300.02"), ("nul", None)]
    return spark.createDataFrame(data, "dx_code string, icd9cm_code string")


@pytest.fixture(scope="module")
def dx(spark):
    data = [
        (1, D(2010, 1, 1), "admission", "dep1", 1),
        (1, D(2009, 1, 1), "final", "anx", 2),  # other phase
        (2, D(2009, 1, 1), "admission", "anx", 3),  # first qualifying is no target
        (2, D(2010, 1, 1), "admission", "dep1", 4),
        (3, D(2007, 12, 31), "admission", "anx", 5),  # too early
        (3, D(2008, 1, 1), "intermediate", "dep2", 6),
        (4, D(2018, 1, 1), "admission", "dep1", 7),  # follow-up too short
        (5, D(2010, 1, 1), "admission", "dep1", 9),  # tie on the date
        (5, D(2010, 1, 1), "admission", "anx", 8),
        (6, None, "admission", "dep1", 10),
        (7, D(2010, 1, 1), None, "dep1", 11),
        (8, D(2010, 1, 1), "admission", "dep1", 12),  # enrolled later
        (9, D(2010, 1, 1), "admission", "dep1", 13),  # enrolment unknown
        (10, D(2015, 10, 14), "admission", "dep1", 14),  # exactly 1825 days
        (11, D(2015, 10, 15), "admission", "dep1", 15),  # one day short
        (12, D(2010, 1, 1), "admission", None, 16),
    ]
    return spark.createDataFrame(data, "client_id long, date date, phase string, ax_1_1 string, dx_id long")


@pytest.fixture(scope="module")
def clients(spark):
    data = [(i, D(2005, 1, 1), "f", 1980, "1011") for i in (1, 2, 3, 4, 5, 6, 7, 10, 11, 12)]
    data += [(8, D(2010, 1, 2), "m", 1970, "1012"), (9, None, "m", 1960, None)]
    return spark.createDataFrame(
        data, "client_id long, date date, gender string, year_of_birth int, zip string"
    )


def test_target_codes_match_as_an_unanchored_pattern(codes, rows):
    # The dot is a wildcard, so 296x31 matches; a missing code does not.
    assert rows(co.target_codes(codes, SPEC.code_pattern)) == [("dep1",), ("dep2",)]


def test_optional_filters(spark, codes, rows):
    major = codes.selectExpr("*", "if(dx_code = 'dep1', 'mood', 'other') as major_nl")
    assert rows(co.target_codes(major, SPEC.code_pattern, "mood")) == [("dep1",)]
    index = spark.createDataFrame([(1, D(2010, 1, 1))], "client_id long, dx_date date")
    dbc = spark.createDataFrame(
        [(1, D(2011, 1, 1), 5.0, "SGGZ"), (1, D(2011, 1, 1), 7.0, "BGGZ")],
        "client_id long, date_stop date, claimed double, GGZ_type string",
    )
    assert rows(co.episode_costs(dbc, index, "SGGZ")) == [(1, 5.0)]
    assert rows(co.episode_costs(dbc, index)) == [(1, 12.0)]


def test_code_is_tested_after_the_first_diagnosis(dx, codes, rows):
    found = co.index_event(dx, codes, SPEC)
    assert [r[0] for r in rows(found)] == sorted([1, 3, 4, 8, 9, 10, 11], key=lambda i: repr((i,)))


def test_index_cohort_applies_follow_up_and_enrolment(dx, codes, clients, rows):
    found = co.index_cohort(dx, codes, clients, SPEC)
    assert found.columns == ["client_id", "gender", "year_of_birth", "enroll_date", "dx", "dx_date", "zip"]
    assert sorted(r["client_id"] for r in found.collect()) == [1, 3, 10]


def test_newest_first_orders_by_enrolment(dx, codes, clients):
    found = co.newest_first(co.index_cohort(dx, codes, clients, SPEC)).collect()
    dates = [r["enroll_date"] for r in found]
    assert dates == sorted(dates, reverse=True)


def test_result_does_not_depend_on_partitions(dx, codes, clients, rows):
    one = co.index_cohort(dx.coalesce(1), codes, clients, SPEC)
    many = co.index_cohort(dx.repartition(9), codes, clients, SPEC)
    assert rows(one) == rows(many)


def test_costs_count_episodes_ending_after_the_index_date(spark, rows):
    index = spark.createDataFrame([(1, D(2010, 1, 1)), (2, D(2010, 1, 1)), (3, D(2010, 1, 1))], "client_id long, dx_date date")
    data = [
        (1, D(2010, 1, 1), 5.0),  # same day is not after
        (1, D(2010, 1, 2), 7.0),
        (1, None, 100.0),
        (2, D(2011, 1, 1), None),  # unknown cost counts as nothing
        (3, D(2009, 1, 1), 9.0),
        (4, D(2011, 1, 1), 9.0),
    ]
    dbc = spark.createDataFrame(data, "client_id long, date_stop date, claimed double")
    assert rows(co.episode_costs(dbc, index)) == [(1, 7.0), (2, 0.0)]


def test_attrition_counts_each_step(spark, dx, codes, clients):
    costs = spark.createDataFrame([(1, 1.0), (3, 1.0)], "client_id long, costs double")
    care = spark.createDataFrame(
        [(1, 10, 5, 60.0), (3, 10, 5, None), (2, 9, 9, 99.0)], "client_id long, days int, n long, mins double"
    )
    found = co.attrition(dx, codes, clients, costs, care, SPEC)
    counts = {r["name"]: r["remaining"] for r in found.collect()}
    assert counts == {
        "in_phase": 14,
        "in_years": 12,
        "first_diagnosis": 10,
        "target_code": 7,
        "followed_up": 5,
        "enrolled": 3,
        "closed_episode": 2,
        "care_after_index": 2,
        "enough_care": 1,
    }


# --- timeline and summaries -------------------------------------------------------

INDEX = D(2010, 1, 1)


def day(n):
    return INDEX + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def events(spark):
    data = [
        (1, day(-731), 1, 10.0, 1.0, 1, 5),
        (1, day(-730), -1, 10.5, 0.0, 1, 5),
        (1, day(-1), None, 10.0, 1.0, 2, 5),
        (1, day(0), -1, 20.0, 0.5, 1, 5),
        (1, day(1825), 1, 30.0, 2.0, 2, 6),
        (1, day(1826), 1, 99.0, 9.0, 1, 5),  # beyond follow-up
        (2, day(3), 1, None, 4.0, 9, None),  # unknown minutes, type and team
        (2, day(4), -1, 6.0, 0.0, 3, 8),
        (2, day(5), 1, 6.0, 0.0, 3, 7),  # ties with team 8
        (2, day(-5), 1, None, 1.0, 1, 8),
        (3, None, 1, 1.0, 1.0, 1, 1),
        (4, day(1), 1, 1.0, 1.0, 1, 1),  # not in the cohort
    ]
    return spark.createDataFrame(
        data,
        "client_id long, date date, dbc_id long, mins_direct_staff double,"
        " mins_indirect_staff double, intervention_type_id long, team_id long",
    )


@pytest.fixture(scope="module")
def types(spark):
    return spark.createDataFrame(
        [(1, "Talk"), (2, "TALK"), (3, "Test")], "intervention_type_id long, description_cat string"
    )


@pytest.fixture(scope="module")
def timeline(spark, events, types):
    index = spark.createDataFrame([(i, INDEX) for i in (1, 2, 3)], "client_id long, dx_date date")
    return tl.event_timeline(events, types, index, SPEC).cache()


def as_dicts(df, key="client_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_large_sides_give_the_same_timeline(timeline, events, types, spark, rows, monkeypatch):
    from cohortline.core import skew

    monkeypatch.setattr(skew, "BROADCAST_BYTES", -1)
    index = spark.createDataFrame([(i, INDEX) for i in (1, 2, 3)], "client_id long, dx_date date")
    spread = tl.event_timeline(events.repartition(3), types, index, SPEC, derived=True)
    assert rows(spread) == rows(timeline)


def test_summaries_need_no_category(timeline, events, spark, rows):
    index = spark.createDataFrame([(i, INDEX) for i in (1, 2, 3)], "client_id long, dx_date date")
    bare = tl.event_timeline(events, None, index, SPEC)
    for summary in (su.prior_care_summary, su.post_index_summary, su.client_month_summary, su.team_minutes):
        assert rows(summary(bare)) == rows(summary(timeline))


def test_any_category_name_can_be_a_column(spark, events, tmp_path):
    from cohortline.core.workspace import materialise
    from cohortline.operators import profile as pf

    name = "Gesprek (kort), v.1;2 `x`"
    odd = spark.createDataFrame([(1, name)], "intervention_type_id long, description_cat string")
    index = spark.createDataFrame([(1, INDEX), (2, INDEX)], "client_id long, dx_date date")
    table = su.client_overview(
        tl.event_timeline(events, odd, index, SPEC), tl.category_values(odd)
    )
    stored = materialise(table, "odd")
    column = f"mins_{name.lower()}"
    assert column in stored.columns
    long = pf.to_long(pf.profile_matrix(stored))
    assert {r["dim"] for r in long.collect()} == {name.lower(), "<na>"}


def test_windows_are_closed_and_separate(timeline):
    found = {(r["client_id"], r["day_first"]): r["period"] for r in timeline.collect()}
    assert found[1, -731] == "history" and found[1, -730] == "look_back"
    assert found[1, -1] == "look_back" and found[1, 0] == "follow_up"
    assert found[1, 1825] == "follow_up" and (1, 1826) not in found
    assert {client for client, _ in found} == {1, 2}


def test_categories_merge_by_case_and_keep_the_unmatched(timeline, types):
    assert {r[0] for r in timeline.select("category").distinct().collect()} == {"talk", "test", "<na>"}
    assert tl.category_values(types) == ["talk", "test", "<na>"]


def test_prior_summary_reads_all_history(timeline):
    found = as_dicts(su.prior_care_summary(timeline))
    assert found[1] == {"client_id": 1, "days_prev": 731, "n_prev": 3, "mins_prev": 32.0}
    # Rows exist but minutes are unknown: zero, not missing.
    assert found[2] == {"client_id": 2, "days_prev": 5, "n_prev": 1, "mins_prev": 0.0}


def test_post_summary_propagates_unknown_minutes(timeline):
    found = as_dicts(su.post_index_summary(timeline))
    assert found[1] == dict(client_id=1, days=1825, n=2, nb=1, ns=1, mins=52.0, minsb=20.0, minss=32.0)
    assert (found[2]["n"], found[2]["nb"], found[2]["mins"], found[2]["minsb"]) == (3, 1, None, None)


def test_features_skip_unknown_minutes_and_fill_zero(timeline, types):
    values = tl.category_values(types)
    minutes = as_dicts(su.activity_features(timeline, values, True))
    counts = as_dicts(su.activity_features(timeline, values, False))
    assert minutes[2] == {"client_id": 2, "mins_talk": 0.0, "mins_test": 12.0, "mins_<na>": 4.0}
    assert counts[1] == {"client_id": 1, "n_talk": 2, "n_test": 0, "n_<na>": 0}


def test_month_table_covers_look_back_and_follow_up(timeline, types):
    found = su.client_month_features(timeline, tl.category_values(types)).collect()
    assert {(r["client_id"], r["year"], r["month"]) for r in found} == {
        (1, 2008, 1),
        (1, 2009, 12),
        (1, 2010, 1),
        (1, 2014, 12),
        (2, 2009, 12),
        (2, 2010, 1),
    }


def test_totals_are_conserved_between_grains(timeline):
    long = su.activity_long(tl.in_periods(timeline, tl.MONTHS), su.MONTH_KEYS)
    totals = su.activity_totals(timeline)
    assert long.agg({"mins": "sum"}).first()[0] == totals.agg({"total": "sum"}).first()[0]
    assert [r["total"] for r in totals.collect()] == sorted(
        (r["total"] for r in totals.collect()), reverse=True
    )


def test_compacted_rows_give_the_same_summaries(timeline, types, rows):
    cells, values = tl.compact(timeline), tl.category_values(types)
    for summary in (
        su.prior_care_summary,
        su.post_index_summary,
        su.client_month_summary,
        su.team_minutes,
        lambda t: su.client_month_features(t, values),
        lambda t: su.client_overview(t, values),
    ):
        assert rows(summary(cells)) == rows(summary(timeline))


def test_overview_joins_the_separate_summaries(timeline, types, rows):
    values = tl.category_values(types)
    joined = (
        su.post_index_summary(timeline)
        .join(su.prior_care_summary(timeline), "client_id", "left")
        .join(su.activity_features(timeline, values, False), "client_id")
        .join(su.activity_features(timeline, values, True), "client_id")
    )
    overview = su.client_overview(timeline, values)
    assert rows(overview.select(*joined.columns)) == rows(joined)


def test_overview_without_prior_care_stays_missing(spark, types):
    index = spark.createDataFrame([(5, INDEX)], "client_id long, dx_date date")
    events = spark.createDataFrame(
        [(5, day(1), 1, 1.0, 1.0, 1, 1)],
        "client_id long, date date, dbc_id long, mins_direct_staff double,"
        " mins_indirect_staff double, intervention_type_id long, team_id long",
    )
    found = su.client_overview(tl.event_timeline(events, types, index, SPEC), ["talk"]).first()
    assert (found["days_prev"], found["n_prev"], found["mins_prev"]) == (None, None, None)


def test_dominant_team_takes_the_lowest_id_on_a_tie(spark, timeline):
    teams = spark.createDataFrame(
        [(i, f"t{i}", "s", "d", "o") for i in (6, 7, 8)],
        "team_id long, team string, subdepartment string, department string, organisation string",
    )
    found = as_dicts(su.dominant_team(timeline, teams))
    assert (found[1]["team_id"], found[1]["team_mins"], found[1]["team"]) == (6, 32.0, "t6")
    assert (found[2]["team_id"], found[2]["team_mins"]) == (7, 6.0)


def test_summary_columns_are_labelled(timeline):
    schema = su.post_index_summary(timeline).schema
    assert schema["minsb"].metadata == {"label": "Minutes of BGGZ Interventions"}


def test_roles_are_checked(spark):
    with pytest.raises(ValueError, match="lacks columns"):
        check_role("dbc", spark.createDataFrame([(1,)], "client_id long"))
    stamped = spark.sql("select 1L client_id, timestamp_ntz'2020-01-02 03:04:05' date_stop, 1d claimed")
    assert check_role("dbc", stamped).first()["date_stop"] == D(2020, 1, 2)


def test_bound_interventions_may_be_a_function(spark, events, types, dx, codes, clients):
    empty = spark.createDataFrame([], "client_id long, date_stop date, claimed double")
    teams = spark.createDataFrame(
        [], "team_id long, team string, subdepartment string, department string, organisation string"
    )
    asked = []
    care = bind(
        dx_codes=codes,
        dx=dx,
        clients=clients,
        dbc=empty,
        interventions=lambda ids: asked.append(ids) or events,
        intervention_types=types,
        teams=teams,
    )
    assert care.interventions_of(clients.select("client_id")).count() == events.count()
    assert len(asked) == 1


def test_thousands_of_categories_fit_in_maps(spark):
    from cohortline.operators import summaries as su
    from cohortline.operators import timeline as tl

    types = spark.range(5000).select(
        F.col("id").alias("intervention_type_id"),
        F.when(F.col("id") > 0, F.concat(F.lit("Cat"), "id")).alias("description_cat"),
    )
    assert len(tl.category_values(types)) == 5000
    listed = su.category_catalogue(types)
    assert listed.count() == 5000 and listed.filter("category = '<na>' and n_column = 'n_<na>'").count() == 1
    events = spark.range(20_000).select(
        F.pmod("id", F.lit(3)).alias("client_id"),
        F.concat(F.lit("cat"), F.pmod("id", F.lit(5000))).alias("category"),
        F.lit(2).cast("long").alias("n"),
        F.lit(1.5).alias("listed"),
    )
    maps = su.activity_maps(events)
    assert {r["c"] for r in maps.select(F.size("n").alias("c")).collect()} == {5000}
    assert maps.agg(F.sum(F.aggregate(F.map_values("n"), F.lit(0).cast("long"), lambda s, v: s + v))).first()[0] == 40_000
    wide = su.widen_maps(maps, ["cat7", "none"])
    assert wide.columns == ["client_id", "n_cat7", "n_none", "mins_cat7", "mins_none"]
    assert {tuple(r)[1:] for r in wide.collect()} <= {(2, 0, 2.0, 0.0), (4, 0, 3.0, 0.0), (4, 0, 4.0, 0.0)} | {(2, 0, 1.0, 0.0)}


def test_best_team_needs_no_sort(spark, rows):
    from cohortline.operators import summaries as su

    care = [(1, 5, 10.0), (1, -3, 10.0), (1, 9, 4.0), (2, 7, 0.0), (2, 8, 0.0), (3, None, 90.0), (4, (1 << 62), 3.4), (4, 1, 3.4)]
    timeline = spark.createDataFrame(care, "client_id long, team_id long, listed double").withColumns(
        {"n": F.lit(1).cast("long"), "period": F.lit("follow_up")}
    )
    teams = spark.createDataFrame([(-3, "a"), (7, "b")], "team_id long, team string").withColumns(
        {c: F.lit("x") for c in ("subdepartment", "department", "organisation")}
    )
    best = su.dominant_team(timeline, teams)
    assert rows(best, "client_id", "team_id", "team_mins", "team") == [
        (1, -3, 10.0, "a"), (2, 7, 0.0, "b"), (4, 1, 3.0, None)
    ]
    assert "SortAggregate" not in best._jdf.queryExecution().toString()
    with pytest.raises(TypeError):
        su.dominant_team(timeline.withColumn("team_id", F.col("team_id").cast("string")), teams)


@pytest.mark.parametrize("count", [0, 1, 7, 999, 1000, 5000])
def test_samples_have_the_size_asked_for(spark, rows, count):
    from cohortline.operators.sampling import exact_sample

    table = spark.range(1000).withColumn("v", F.col("id") * 2)
    got = rows(exact_sample(table.repartition(6), "id", count, "s"))
    assert len(got) == min(count, 1000) and got == rows(exact_sample(table.coalesce(1), "id", count, "s"))
    assert set(got) <= set(rows(exact_sample(table, "id", count + 50, "s")))
