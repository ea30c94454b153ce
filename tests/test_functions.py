import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.functions import aggregates as ag
from cohortline.functions import columns as fc
from cohortline.functions import distribution as di


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-2.5,)], "x double")
    assert [r[0] for r in df.select(ag.half_even(F.col("x"))).collect()] == [0.0, 2.0, 2.0, -2.0]


def test_sums_treat_missing_values_by_their_rule(spark):
    df = spark.createDataFrame(
        [("a", None), ("b", 1.0), ("b", None), ("c", 1.0), ("c", 2.0)], "g string, x double"
    )
    found = df.groupBy("g").agg(
        ag.sum_or_zero(F.col("x")).alias("zero"), ag.sum_if_complete(F.col("x")).alias("complete")
    )
    got = {r["g"]: (r["zero"], r["complete"]) for r in found.collect()}
    assert got == {"a": (0.0, None), "b": (1.0, None), "c": (3.0, 3.0)}


def test_first_per_group_orders_missing_last_and_breaks_ties(spark, rows):
    data = [(1, None, 1, "n"), (1, 5, 9, "b"), (1, 5, 3, "a"), (2, None, 2, "z")]
    df = spark.createDataFrame(data, "id int, day int, tie int, code string")
    found = ag.first_per_group(df, ["id"], ["day", "tie"], ["code", "day"])
    assert rows(found) == [(1, "a", 5), (2, "z", None)]


def test_ascii_text_blanks_bytes_then_halves_spaces(spark):
    texts = ["café", "a   b", "10€", "naïve  x", "😀", "plain", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in df.select(fc.ascii_text(F.col("t"))).collect()]
    assert found == ["caf ", "a  b", "10  ", "na ve x", "  ", "plain", None]


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, mins_x int, mins_y int, b int")
    assert fc.column_range(df, "mins_x", "b") == ["mins_x", "mins_y", "b"]
    assert fc.with_prefix(df, "mins_") == ["mins_x", "mins_y"]
    assert fc.strip_prefix(df, "mins_").columns == ["a", "x", "y", "b"]
    assert fc.move_first(df, "b", "mins_y").columns == ["b", "mins_y", "a", "mins_x"]


def test_any_non_null_over_mixed_types(spark):
    df = spark.createDataFrame(
        [(None, None), ("x", None), (None, dt.date(2020, 1, 1))], "s string, d date"
    )
    assert [r[0] for r in df.select(fc.any_non_null("s", "d")).collect()] == [False, True, True]


def test_labels_survive_parquet(spark, tmp_path):
    df = fc.with_labels(spark.range(1).withColumn("n", F.lit(1)), {"n": "Number", "other": "x"})
    df.write.parquet(str(tmp_path / "t"))
    assert fc.label_of(spark.read.parquet(str(tmp_path / "t")), "n") == "Number"


def test_sentinel_becomes_null_in_numbers_only(spark):
    df = spark.createDataFrame([(-99997.0, -99997, "-99997")], "x double, i int, s string")
    assert tuple(fc.sentinel_to_null(df, -99997).first()) == (None, None, "-99997")


def trimmed(values, trim):
    ordered = np.sort(values)
    cut = int(np.floor(len(ordered) * trim))
    return ordered[cut : len(ordered) - cut].mean()


@pytest.fixture(scope="module")
def measured(spark):
    """Three groups; one holds most rows and many copies of one value."""
    random = np.random.default_rng(3)
    data = {
        "hot": np.concatenate([np.zeros(900), random.normal(10, 3, 1500)]),
        "small": random.exponential(5, 37),
        "one": np.array([4.0]),
        None: np.array([1.0, 2.0, 10.0, 11.0]),
    }
    pairs = [(g, float(v)) for g, values in data.items() for v in values]
    random.shuffle(pairs)
    pairs = [(g, float(v)) for g, v in pairs] + [("small", None)]
    return data, spark.createDataFrame(pairs, "g string, x double").repartition(7)


def test_quantiles_match_numpy_for_any_group(measured):
    data, df = measured
    found = di.group_quantiles(df, ["g"], "x", {"a": 0.05, "m": 0.5, "z": 0.95}).collect()
    assert {r["g"]: r["n"] for r in found} == {g: len(v) for g, v in data.items()}
    for r in found:
        want = np.quantile(data[r["g"]], [0.05, 0.5, 0.95])
        assert np.allclose([r["a"], r["m"], r["z"]], want)


def test_trimmed_means_match_sorting(measured):
    data, df = measured
    for r in di.group_trimmed_means(df, ["g"], "x", 0.3, "t").collect():
        assert r["t"] == pytest.approx(trimmed(data[r["g"]], 0.3))


def test_rank_intervals_cover_every_rank_once(measured):
    data, df = measured
    found = di.rank_intervals(df, ["g"], "x").collect()
    for g, values in data.items():
        mine = sorted((r for r in found if r["g"] == g), key=lambda r: r["value"])
        assert [r["value"] for r in mine] == sorted(set(values))
        ends = np.cumsum([r["copies"] for r in mine])
        assert [r["before"] for r in mine] == [0, *ends[:-1]]
        assert {r["total"] for r in mine} == {len(values)}
