from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cohortline.core import skew, workspace


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one key and are copies; another third have none."""
    data = [(7, "copy")] * 3000 + [(None, "none")] * 3000 + [(i, str(i)) for i in range(3000)]
    fact = spark.createDataFrame(data, "k long, v string").repartition(16)
    side = spark.createDataFrame([(i, i * 10) for i in range(0, 3000, 2)] + [(7, 70)], "k long, w long")
    return fact, side


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_spread_join_equals_plain_join(hot, rows, how):
    fact, side = hot
    got = skew.spread_join(fact, side, "k", how, salts=8)
    want = fact.join(side, "k", how)
    assert got.columns == want.columns
    assert rows(got.groupBy(*got.columns).count()) == rows(want.groupBy(*want.columns).count())


def test_spread_join_never_sends_the_copies_to_all_tasks(spark, tmp_path):
    """A stored side looks small to the planner, whatever its copies take."""
    spark.range(100).withColumnRenamed("id", "k").write.parquet(str(tmp_path / "side"))
    side = spark.read.parquet(str(tmp_path / "side"))
    joined = skew.spread_join(spark.range(100).withColumnRenamed("id", "k"), side, "k", hot=list(range(100)))
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 100


def test_copies_of_a_hot_key_are_spread(hot):
    fact, _ = hot
    salt = F.pmod(F.spark_partition_id(), F.lit(8))
    held = fact.filter("k = 7").groupBy(salt).count().collect()
    assert len(held) == 8 and max(r["count"] for r in held) < 1000


def test_lookup_join_switches_by_measured_size(hot, rows):
    fact, side = hot
    small = skew.lookup_join(fact, side, "k")
    large = skew.lookup_join(fact, side, "k", max_bytes=0)
    assert rows(small.groupBy("k", "w").count()) == rows(large.groupBy("k", "w").count())
    assert "_salt" not in large.columns


def test_hot_keys_may_come_from_another_table(hot, rows, monkeypatch):
    fact, side = hot
    asked = []
    found = skew.frequent_keys
    monkeypatch.setattr(skew, "frequent_keys", lambda df, key: asked.append(df) or found(df, key))
    source = fact.select("k")
    got = skew.measured(side, "k", 0).join(fact, "left", source)
    assert len(asked) == 1 and asked[0] is source
    assert rows(got.groupBy(*got.columns).count()) == rows(
        fact.join(side, "k", "left").groupBy(*got.columns).count()
    )


def test_frequent_keys_are_bounded(hot):
    found = skew.frequent_keys(hot[0], "k", 2)
    assert found[0] == 7 and len(found) == 2 and None not in found


def test_frequent_keys_of_nothing(spark):
    assert skew.frequent_keys(spark.range(0), "id") == []


def test_a_doubled_key_doubles_rows_as_a_merge_does(spark, rows):
    fact = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    side = spark.createDataFrame([(1, "x"), (1, "y")], "k long, w string")
    for bound in (skew.BROADCAST_BYTES, 0):
        found = skew.lookup_join(fact, side, "k", "left", max_bytes=bound)
        assert rows(found) == [(1, "a", "x"), (1, "a", "y"), (2, "b", None)]


def test_table_bytes_grows_with_text(spark):
    short = spark.createDataFrame([("a",)] * 10, "s string")
    long = spark.createDataFrame([("a" * 1000,)] * 10, "s string")
    assert skew.table_bytes(long) - skew.table_bytes(short) == 9990
    assert skew.table_bytes(short.limit(0)) == 0


def test_materialise_stores_rows_and_metadata(spark, rows):
    df = spark.range(5).withColumn("x", F.col("id") * 2).withMetadata("x", {"label": "twice"})
    stored = workspace.materialise(df, "numbers")
    assert rows(stored) == rows(df)
    assert stored.schema["x"].metadata == {"label": "twice"}
    assert "Scan parquet" in stored._jdf.queryExecution().toString() or stored.inputFiles()


def test_materialise_leaves_no_shuffle_files(spark):
    def shuffled():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {p for d in dirs for p in Path(d).rglob("shuffle_*")}

    before, setting = shuffled(), spark.conf.get(workspace.CLEANUP, None)
    stored = workspace.materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert shuffled() <= before and stored.count() == 7
    assert spark.conf.get(workspace.CLEANUP, None) == setting
    spark.conf.set(workspace.CLEANUP, "false")
    with pytest.raises(Exception, match="no such thing"):
        workspace.materialise(spark.range(1).select(F.raise_error(F.lit("no such thing"))), "failing")
    assert spark.conf.get(workspace.CLEANUP) == "false"
    spark.conf.unset(workspace.CLEANUP)


def test_stored_texts_reach_python_in_small_batches(spark):
    """Batches are bounded by bytes, so long texts don't fill a worker."""
    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    found = [r["n"] for r in workspace.materialise(texts.mapInArrow(sizes, "n long"), "sizes").collect()]
    assert sum(found) == 3000 and max(found) < 1000


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class Context:
    master = "spark://host:7077"

    def getConf(self):
        return Conf()

    def getCheckpointDir(self):
        return None


class Session:
    conf = Conf()
    sparkContext = Context()


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace.scratch_dir(Session())


def test_the_folder_named_by_the_cluster_is_used():
    session = Session()
    session.conf = Conf({"spark.checkpoint.dir": "hdfs://shared/tmp"})
    assert workspace.scratch_dir(session) == "hdfs://shared/tmp"


def test_nested_columns_are_measured(spark):
    from cohortline.core.skew import table_bytes

    text = "x" * 1000
    rows = [(i, [text, text], {"a": text}, (text, i)) for i in range(50)]
    schema = "k int, a array<string>, m map<string,string>, s struct<t:string,i:int>"
    assert table_bytes(spark.createDataFrame(rows, schema)) > 50 * 4000


def test_join_on_several_keys(spark, rows):
    from cohortline.core.skew import lookup_join

    fact = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", None, 3), (None, 1, 4)], "r string, i int, n int")
    side = spark.createDataFrame([("a", 1, 10), ("b", 1, 20)], "r string, i int, w int")
    for how in ("inner", "left"):
        wide = rows(lookup_join(fact, side, ["r", "i"], how), "r", "i", "n", "w")
        assert wide == rows(lookup_join(fact, side, ["r", "i"], how, max_bytes=0), "r", "i", "n", "w")
        assert wide == rows(fact.join(side, ["r", "i"], how), "r", "i", "n", "w")
