"""Histories and merges: nulls, ties, duplicate keys, clashing names, hot keys, reruns, order of arrival."""

import itertools

import pytest
from pyspark.sql import functions as F

from siltstone.operators import history, rows
from siltstone.sources.folders import working
from siltstone.sources.lake import ConcurrentWrite, LakeTable


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def lake(spark, schema):
    return LakeTable(spark, working(spark, "test")).create(schema)


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, 5, "a", "t"), (1, 7, "b", "s"), (2, 1, None, None)], "_rank long, rank int, _t string, row string")
    assert got(rows.keep_first(df, ["_rank"], [F.col("rank").desc()])) == got(df.where("rank <> 5"))
    assert rows.latest(df, ["_rank"], ["rank"]).columns == df.columns
    new = spark.createDataFrame([(2, 9, "n", "n"), (3, 9, "n", "n")], df.schema)
    assert got(history.upsert(df.where("rank <> 5"), new, ["_rank"])) == got(df.where("rank = 7").union(new))


def test_null_keys_are_keys(spark):
    open_ = spark.createDataFrame([(None, "a", 1, True), (1, "b", 1, True)], "k long, v string, version int, is_current boolean")
    now = spark.createDataFrame([(None, "a"), (1, None)], "k long, v string")
    assert got(history.snapshot(open_, now, ["k"], ["v"])) == sorted([(None, "a", 1, True), (1, "b", 1, False), (1, None, 2, True)], key=repr)
    assert got(history.upsert(open_.select("k", "v"), now, ["k"])) == got(now)


def test_sources_that_repeat_a_key_fail(spark):
    target, source = spark.createDataFrame([(1, "a")], "k long, v string"), spark.createDataFrame([(2, "x"), (2, "y")], "k long, v string")
    with pytest.raises(Exception, match="repeats a key"):
        history.upsert(target, source, ["k"]).collect()
    t = lake(spark, "k long, v string")
    with pytest.raises(Exception, match="repeats a key"):
        history.merge_scd1(t, source, ["k"])
    assert t.read().count() == 0


def test_scd1_table(spark):
    t = lake(spark, "a long, b string, v string, note string")
    t.append(spark.createDataFrame([(1, "x", "old", "n1"), (1, "y", "old", "n2"), (None, "x", "old", "n3")], "a long, b string, v string, note string"))
    source = spark.createDataFrame([(1, "x", "new"), (None, "x", None), (1, "y", "old"), (2, "z", "in")], "a long, b string, v string")
    assert history.merge_scd1(t, source, ["a", "b"]) == {"numTargetRowsInserted": 1, "numTargetRowsUpdated": 2}
    want = sorted([(1, "x", "new", "n1"), (1, "y", "old", "n2"), (None, "x", None, "n3"), (2, "z", "in", None)], key=repr)
    assert got(t.read()) == want
    version = t.state().version
    assert history.merge_scd1(t, source, ["a", "b"]) == {"numTargetRowsInserted": 0, "numTargetRowsUpdated": 0}
    assert t.state().version == version and got(t.read()) == want
    assert got(t.read(version=1)) == sorted([(1, "x", "old", "n1"), (1, "y", "old", "n2"), (None, "x", "old", "n3")], key=repr)


def test_scd1_writes_touched_files_only(spark):
    t = lake(spark, "k long, v string")
    for k in range(4):
        t.append(spark.range(k * 10, k * 10 + 10).selectExpr("id AS k", "'a' AS v").coalesce(1))
    before = set(t.state().files)
    history.merge_scd1(t, spark.createDataFrame([(15, "b")], "k long, v string"), ["k"])
    assert len(before - set(t.state().files)) == 1 and t.read().count() == 40


def test_scd2_table_closes_missing(spark):
    t = lake(spark, "k long, v string, effective_start int, effective_end int, is_current boolean")
    snap = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    history.merge_scd2(t, snap((1, "a"), (2, None), (None, "n")), ["k"], ["v"], F.lit(10))
    history.merge_scd2(t, snap((1, "b"), (2, "x")), ["k"], ["v"], F.lit(20))
    history.merge_scd2(t, snap((1, "a")), ["k"], ["v"], F.lit(30), close_missing=True)
    want = [(1, "a", 10, 20, False), (1, "b", 20, 30, False), (1, "a", 30, None, True), (2, None, 10, 20, False), (2, "x", 20, 30, False), (None, "n", 10, 30, False)]
    assert got(t.read()) == sorted(want, key=repr)
    assert history.merge_scd2(t, snap((1, "a")), ["k"], ["v"], F.lit(40)) == {"numTargetRowsInserted": 0, "numTargetRowsUpdated": 0}


CHANGES = [(1, "a", 10), (1, "a", 20), (1, "b", 30), (1, "a", 40), (2, None, 5), (2, "x", 6), (None, "n", 1), (None, None, 2)]
HISTORY = [(1, "a", 10, 30), (1, "b", 30, 40), (1, "a", 40, None), (2, None, 5, 6), (2, "x", 6, None), (None, "n", 1, 2), (None, None, 2, None)]


@pytest.mark.parametrize("most", [history.MOST, 1, 3])
def test_from_changes_and_hot_keys(spark, most):
    feed = spark.createDataFrame(CHANGES, "k long, v string, s int")
    assert got(history.from_changes(feed, ["k"], ["v"], ["s"], "s", most=most)) == sorted(HISTORY, key=repr)


def test_hot_key_in_parts(spark):
    feed = spark.range(5000).selectExpr("id % 3 = 0 AND id > 10 AS other", "CAST(id AS INT) AS s", "CAST((id * 7919) % 11 < 4 AS STRING) AS v").selectExpr("IF(other, s, -1) AS k", "v", "s")
    plain = got(history.from_changes(feed, ["k"], ["v"], ["s"], "s"))
    assert got(history.from_changes(feed, ["k"], ["v"], ["s"], "s", most=100)) == plain


def test_changes_in_any_order(spark):
    for order in itertools.islice(itertools.permutations(range(4)), 0, 24, 7):
        feed, t = lake(spark, "k long, v string, s int"), lake(spark, "k long, v string, __START_AT int, __END_AT int")
        for part in (*order, order[0]):
            history.merge_changes(feed, t, spark.createDataFrame(CHANGES[part::4], "k long, v string, s int"), ["k"], ["v"], "s")
        assert got(t.read()) == sorted(HISTORY, key=repr)


def test_equal_sequences_take_the_largest(spark):
    feed, t = lake(spark, "k long, v string, s int"), lake(spark, "k long, v string, __START_AT int, __END_AT int")
    history.merge_changes(feed, t, spark.createDataFrame([(1, "a", 1), (1, "b", 1), (1, "b", 1)], "k long, v string, s int"), ["k"], ["v"], "s")
    assert got(t.read()) == [(1, "b", 1, None)]
    with pytest.raises(Exception, match="no sequence"):
        history.merge_changes(feed, t, spark.createDataFrame([(1, "a", None)], "k long, v string, s int"), ["k"], ["v"], "s")


def test_of_two_writers_one_wins(spark):
    t = lake(spark, "k long")
    base = t.state()
    t.append(spark.range(1).toDF("k"))
    with pytest.raises(ConcurrentWrite):
        t.commit(base, "WRITE", remove=["x"])
    # a blind append goes on top
    t.commit(base, "WRITE", {"data/none": {"bytes": 0, "types": {}}}, blind=True)
    assert t.versions() == [0, 1, 2]


def test_many_versions_have_checkpoints(spark):
    t = lake(spark, "k long")
    for k in range(45):
        t.set_properties(n=str(k))
    assert t.state().properties == {"n": "44"} and t.state(version=30).properties == {"n": "29"}
    assert t.folder.exists(f"_log/{40:020d}.checkpoint.json")
