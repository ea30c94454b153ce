import datetime as dt

import pytest
from pyspark.sql import types as T

from cohortline.functions.columns import numeric_minimum
from cohortline.operators import postcode as pc
from cohortline.operators import privacy as pr
from cohortline.operators import scoring as sc
from cohortline.operators import slots as sl
from cohortline.operators.timeline import clean_descriptions
from cohortline.plans import patients as pl
from cohortline.sources import tables as ta

D = dt.date


@pytest.fixture(scope="module")
def scores(spark):
    data = [(1, 2020, 1, D(2020, 1, 3), 5.0, "phq9"), (1, 2020, 1, D(2020, 1, 2), 6.0, "phq9")]
    data += [(1, 2020, 1, D(2020, 1, 9), 7.5, "bsi"), (1, 2020, 2, D(2020, 2, 1), None, "bsi")]
    data += [(None, 2020, 1, D(2020, 1, 1), 1.0, "bsi")]
    data += [(2, 2020, 1, D(2020, 1, 1 + i), float(i), "bsi") for i in range(15)]
    return spark.createDataFrame(
        data, "client_id long, year int, month int, date date, score double, rom string"
    )


def test_slots_are_ordered_typed_and_counted(scores):
    wide = sl.score_months_wide(scores)
    assert wide.columns[:8] == [
        "client_id", "year", "month", "nrom", "overflow_count", "date_01", "rom_01", "score_01",
    ]
    assert wide.columns[-1] == "score_12" and len(wide.columns) == 5 + 36
    assert isinstance(wide.schema["date_01"].dataType, T.DateType)
    assert isinstance(wide.schema["score_01"].dataType, T.DoubleType)
    found = {(r["client_id"], r["month"]): r for r in wide.collect()}
    first = found[1, 1]
    assert [first[f"rom_0{i}"] for i in (1, 2, 3, 4)] == ["bsi", "phq9", "phq9", None]
    assert [first[f"score_0{i}"] for i in (1, 2, 3)] == [7.5, 6.0, 5.0]
    assert (first["nrom"], first["overflow_count"]) == (3, 0)
    assert (found[1, 2]["nrom"], found[1, 2]["score_01"], found[1, 2]["rom_01"]) == (1, None, "bsi")


def test_slots_beyond_the_last_are_counted_not_lost_silently(scores):
    found = {r["client_id"]: r for r in sl.score_months_wide(scores).collect()}
    assert (found[2]["nrom"], found[2]["overflow_count"], found[2]["score_12"]) == (15, 3, 11.0)


def test_a_missing_key_is_a_group(scores):
    found = [r for r in sl.score_months_wide(scores).collect() if r["client_id"] is None]
    assert [(r["nrom"], r["score_01"]) for r in found] == [(1, 1.0)]


def test_only_the_first_records_leave_a_partition(scores):
    plan = sl.score_months_wide(scores)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_occupancy_counts_groups_with_at_least_that_many(scores):
    keys = ["client_id", "year", "month"]
    found = sl.slot_occupancy(scores, keys, chunk=4)
    got = {r["idx"]: r["n"] for r in found.collect()}
    assert got == {1: 4, 2: 2, 3: 2, **{i: 1 for i in range(4, 16)}}
    assert found.count() == 15


def test_diagnosis_months(spark):
    names = ["ax_1_1", "ax_1_2", "ax_1_3", "ax_1_4", "ax_2_1", "ax_2_2"]
    schema = "client_id long, date date, " + ", ".join(f"{n} string" for n in names)
    schema += ", ax_3 string, ax_4 string, gaf1 double, gaf2 double"
    blank = [None] * 10
    data = [(1, D(2020, 1, 5), "b", *blank[1:]), (1, D(2020, 1, 4), "a", *blank[1:9], 50.0)]
    data += [(1, D(2020, 1, 1), *blank), (1, D(2020, 3, 1), *blank[:8], 61.0, None)]
    found = sl.diagnosis_months_wide(spark.createDataFrame(data, schema))
    assert len(found.columns) == 5 + 9 * 11
    by_month = {r["month"]: r for r in found.collect()}
    assert by_month[1]["ndiag"] == 2 and by_month[3]["gaf1_1"] == 61.0
    assert [by_month[1][f"ax_1_1_{i}"] for i in (1, 2, 3)] == ["a", "b", None]
    assert by_month[1]["gaf2_1"] == 50.0 and by_month[1]["date_1"] == D(2020, 1, 4)


def test_scores_follow_rules_and_norms(spark, rows):
    items = spark.createDataFrame(
        [
            (1, D(2020, 1, 1), "a", 1, 2.0),
            (1, D(2020, 1, 1), "a", 2, 1.0),
            (1, D(2020, 1, 2), "a", 1, 3.0),
            (1, D(2020, 1, 2), "a", 2, None),  # too few answers
            (1, D(2020, 1, 1), "b", 1, 4.0),
            (1, D(2020, 1, 1), "b", 99, 4.0),  # not an item of this instrument
            (2, None, "b", 1, 4.0),  # no date
        ],
        "client_id long, date date, rom string, item int, answer double",
    )
    rules = spark.createDataFrame(
        [("a", 1, 2.0, False, 4.0), ("a", 2, 1.0, True, 4.0), ("b", 1, 1.0, False, 4.0)],
        "rom string, item int, weight double, reverse boolean, top double",
    )
    norms = spark.createDataFrame(
        [("a", 5.0, 2.0, 2), ("b", 4.0, 1.0, 1)], "rom string, mean double, sd double, min_answered int"
    )
    found = sc.score_instruments(items, rules, norms)
    assert rows(found, "client_id", "date", "rom", "score") == sorted(
        [(1, D(2020, 1, 1), "a", 60.0), (1, D(2020, 1, 2), "a", None), (1, D(2020, 1, 1), "b", 50.0)],
        key=repr,
    )
    one = sc.score_instrument(items.filter("rom = 'a'").drop("rom"), rules, norms, "a")
    assert rows(one) == rows(found.filter("rom = 'a'"))


def test_score_union_tags_and_drops_undated(spark):
    table = spark.createDataFrame(
        [(1, D(2020, 5, 6), 1.0), (1, None, 2.0)], "client_id long, date date, score double"
    )
    roms = ("phq9", "bsi", "honos")
    found = sc.in_reading_order(sc.score_union({rom: table for rom in roms})).collect()
    assert [r["rom"] for r in found] == sorted(roms)
    assert {(r["year"], r["month"]) for r in found} == {(2020, 5)}


def test_postcode_dimension_from_files(spark, tmp_path):
    columns = list(pc.STATISTICS)
    lines = [";".join(columns).replace(";", ","), "1011," + "1.5," * 5 + "high,2,3,4,5"]
    lines += ["1012," + "-99997," * 5 + "-99997,-99997,3,4,5"]
    (tmp_path / "sheet.csv").write_text("\n".join(lines))
    types = {"PC4": T.IntegerType(), "M_INKHH": T.StringType()}
    schema = T.StructType([T.StructField(c, types.get(c, T.DoubleType())) for c in columns])
    raw = ta.read_sheet(spark, str(tmp_path / "sheet.csv"), schema, "-99997")
    (tmp_path / "live.csv").write_text(
        "pc4;jaar;lbrmtr\n1011;2012;-0,125\n1011;2011;9,5\n1013;2012;1,5\n"
    )
    live_schema = T.StructType(
        [
            T.StructField("pc4", T.IntegerType()),
            T.StructField("jaar", T.IntegerType()),
            T.StructField("lbrmtr", T.DoubleType()),
        ]
    )
    live = ta.read_semicolon_csv(spark, str(tmp_path / "live.csv"), live_schema)
    table = pc.postcode_dimension(raw, live)
    found = {r["zip"]: r for r in table.collect()}
    assert found[1011]["lbrmtr"] == -0.125 and found[1012]["lbrmtr"] is None
    assert found[1012]["p_nl_achtg"] is None and found[1012]["oad"] == 3.0 + 1.0
    assert table.schema["lbrmtr"].metadata["label"] == "Leefbaarheid"
    lowest = numeric_minimum(table).first().asDict()
    assert min(v for v in lowest.values() if v is not None) > -99997
    people = spark.createDataFrame(
        [(1, "f", 1980, D(2020, 1, 1), 1011, "x"), (2, "m", 1970, None, 9999, "y")],
        "client_id long, gender string, year_of_birth int, enroll_date date, zip int, dx string",
    )
    enriched = pc.enrich_by_postcode(people, table)
    assert enriched.columns == [
        "client_id", "gender", "year_of_birth", *(c for c in table.columns if c != "zip"),
        "enroll_date", "dx",
    ]
    assert {r["client_id"]: r["m_inkhh"] for r in enriched.collect()} == {1: "high", 2: None}


def test_pseudonyms_replace_ids(spark, rows):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "client_id long, v string")
    keys = spark.createDataFrame([(1, "k1"), (2, None)], "client_id long, key string")
    assert rows(pr.pseudonymise(table, keys)) == sorted(
        [("k1", "a"), (None, "b"), (None, "c")], key=repr
    )
    assert rows(pr.pseudonymise(table, keys, "drop")) == [("k1", "a")]
    with pytest.raises(Exception, match="client without key"):
        pr.pseudonymise(table, keys, "fail").collect()
    with pytest.raises(ValueError):
        pr.pseudonymise(table, keys, "other")


def test_descriptions_are_cleaned(spark):
    table = spark.createDataFrame([(1, "résumé  x")], "id int, description string")
    assert clean_descriptions(table).first()["description"] == "r sum  x"


def test_bundle_holds_all_rows_of_the_clients(spark, rows):
    table = spark.createDataFrame([(i % 4, i) for i in range(20)], "client_id long, v long")
    chosen = spark.createDataFrame([(1,), (3,), (3,)], "client_id long")
    found = pl.case_bundle({"a": table, "b": table.drop("v")}, chosen)
    assert set(found) == {"a", "b"} and found["a"].count() == 10
    assert {r[0] for r in found["b"].collect()} == {1, 3}


def test_demo_bundle_is_repeatable_and_written_as_text(spark, tmp_path, rows):
    table = spark.range(100).withColumnRenamed("id", "client_id")
    drawn = pl.demo_clients(table.repartition(5))
    assert rows(drawn) == rows(pl.demo_clients(table.coalesce(1))) and drawn.count() == 10
    ta.write_demo(pl.case_bundle({"t": table}, drawn), str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 10


def test_tables_round_trip(spark, tmp_path, rows):
    table = spark.createDataFrame([(1, 2020, "a"), (2, 2021, "b")], "i int, year int, s string")
    ta.write_tables({"one": table, "two": table}, str(tmp_path), {"two": ["year"]})
    back = ta.read_tables(spark, str(tmp_path), ["one", "two"])
    assert rows(back["one"]) == rows(table)
    assert rows(back["two"].select("i", "year", "s")) == rows(table)
