import pathlib

import pytest
from pyspark.sql import functions as F

from suite.compare import database, difference
from suite.oracles import ORACLES, sql
from suite.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert difference(df, con, sql(ORACLES[name]))[1] is None
    else:
        assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_extract_holds_no_client_id_and_keeps_labels(spark, tmp_path):
    from cohortline.core.workspace import materialise, scratch_dir, scratch_scope
    from cohortline.operators.postcode import postcode_dimension
    from cohortline.plans.extract import build_extract, write_extract
    from cohortline.sources.tables import published_folder, read_tables
    from suite import bindings as b

    stored = pathlib.Path(scratch_dir(spark).removeprefix("file:")) / "cohortline"
    before = set(stored.glob("*"))
    with scratch_scope(spark):
        postcode = postcode_dimension(b.postcode_statistics(spark, FOLDER), b.liveability(spark, FOLDER))
        tables = build_extract(
            b.care_tables(spark, FOLDER),
            b.scores(spark, FOLDER),
            materialise(postcode, "postcode"),
            b.client_keys(spark, FOLDER),
            b.SPEC,
            ("date", "o_orderkey"),
        )
        write_extract(tables, str(tmp_path), by_year=True)
        assert set(stored.glob("*")) > before
    assert set(stored.glob("*")) == before
    run = pathlib.Path(published_folder(spark, str(tmp_path)))
    assert run.parent == tmp_path and not (run / "patients" / "year=1997").exists()
    assert any((run / "patient_months_interventions").glob("year=*"))
    back = read_tables(spark, str(tmp_path), list(tables))
    assert set(back) == {
        "patients",
        "patient_months_interventions",
        "patient_months_diagnoses",
        "patient_months_romscores",
    }
    keys = {r["key"] for r in b.client_keys(spark, FOLDER).collect()} | {None}
    for df in back.values():
        assert df.count() > 0
        assert {r["client_id"] for r in df.select("client_id").collect()} <= keys
    patients = back["patients"]
    assert "zip" not in patients.columns and "cluster" in patients.columns
    assert patients.schema["mins"].metadata["label"] == "Minutes of Interventions"
    assert patients.schema["oad"].metadata["label"] == "Omgevingsadressendichtheid"


def test_extract_is_ordered_and_published_as_a_whole(spark, tmp_path):
    from cohortline.plans.extract import write_extract
    from cohortline.sources.tables import published_folder, read_tables

    folder = str(tmp_path)
    rows = spark.range(3000).select(
        F.pmod(F.xxhash64("id"), F.lit(400)).alias("client_id"),
        (F.col("id") % 3 + 2000).cast("int").alias("year"),
        (F.col("id") % 12).cast("int").alias("month"),
    ).repartition(7)
    write_extract({"months": rows, "other": rows.select("client_id")}, folder)
    first = published_folder(spark, folder)
    files = sorted(pathlib.Path(first, "months").glob("*.parquet"))
    read = [tuple(r) for f in files for r in spark.read.parquet(str(f)).collect()]
    assert len(read) == 3000 and read == sorted(read)

    broken = rows.withColumn("month", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        write_extract({"other": rows, "months": broken}, folder)
    assert published_folder(spark, folder) == first
    assert {p.name for p in tmp_path.glob("run-*")} == {pathlib.Path(first).name}

    write_extract({"months": rows.limit(5), "other": rows}, folder)
    assert published_folder(spark, folder) != first
    assert read_tables(spark, folder, ["months"])["months"].count() == 5
