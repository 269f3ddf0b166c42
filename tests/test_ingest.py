"""Ingestion, streams, messages, tables and declared datasets: what is lost, repeated or refused."""

import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from siltstone.functions import columns as C
from siltstone.plans.pipeline import Pipeline
from siltstone.sources import local, messages
from siltstone.sources.folders import Folder, working
from siltstone.sources.lake import LakeTable, SchemaMismatch
from siltstone.streaming import ingest


@pytest.fixture
def root(spark):
    return working(spark, "ingest-test")


def land(spark, root, name, *lines):
    Folder(spark, f"{root}/in").write(name, "\n".join(lines) + "\n")


def job(spark, root, **options):
    return ingest.FileIngest(spark, f"{root}/in", f"{root}/table", f"{root}/checkpoint", **options)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_nothing_is_lost(spark, root):
    land(spark, root, "a.json", '{"id": 1, "value": 2.5}', "no json", '{"id": "x", "value": 1}', '{"id": 2, "other": {"a": [1]}}', "", '{"id": null}', "[1]")
    found = job(spark, root, schema={"id": "bigint", "value": "double"}).run()
    rows = got(found)
    assert (1, 2.5, None) in rows and (None, None, '{"_malformed":"no json"}') in rows
    assert (None, 1.0, '{"id":"x"}') in rows and (None, None, None) in rows
    assert json.loads([r for r in rows if r[0] == 2][0][2]) == {"other": '{"a":[1]}'}
    assert (None, None, '{"_malformed":"[1]"}') in rows and len(rows) >= 6


def test_strings_are_never_rescued(spark, root):
    land(spark, root, "a.json", '{"id": 1, "value": "not_a_number"}', '{"id": {"a": 1}, "value": 5}')
    assert got(job(spark, root).run()) == [("1", "not_a_number", None), ('{"a":1}', "5", None)]


def test_new_columns_outlive_the_object(spark, root):
    land(spark, root, "a.json", '{"id": 1}')
    assert job(spark, root, add_new_columns=True).run().columns == ["id", "_rescued_data"]
    land(spark, root, "b.json", '{"id": 2, "country": "x"}')
    with pytest.raises(StreamingQueryException, match="SchemaEvolved"):
        job(spark, root, add_new_columns=True).run_once()
    # nothing of the batch was taken in, but its schema was kept
    assert job(spark, root).read().count() == 1
    assert got(job(spark, root, add_new_columns=True).run(attempts=1).select("id", "country")) == [("1", None), ("2", "x")]
    land(spark, root, "c.json", '{"id": 3, "country": "y"}')
    assert got(job(spark, root, add_new_columns=True).run(attempts=1).select("id", "country")) == [("1", None), ("2", "x"), ("3", "y")]


def test_other_failures_are_raised_at_once(spark, root):
    land(spark, root, "a.json", *[json.dumps({f"k{i}": i for i in range(30)})])
    bad = job(spark, root, schema={"id": "no such type"})
    with pytest.raises(StreamingQueryException):
        bad.run(attempts=2)


def test_files_are_taken_in_once(spark, root):
    land(spark, root, "a.json", '{"id": 1}')
    for _ in range(2):
        assert job(spark, root).run().count() == 1
    Folder(spark, f"{root}/checkpoint").delete()
    assert job(spark, root).run().count() == 2


def test_csv_headers_that_differ(spark, root):
    land(spark, root, "a.csv", "id,name", '1,"a, ""b"""', "x,c")
    land(spark, root, "b.csv", "name,id,more", "d,2,e", "f,3")
    found = job(spark, root, fmt="csv", schema={"id": "int", "name": "string"}).run()
    rows = got(found.select("id", "name"))
    assert {(1, 'a, "b"'), (None, "c"), (2, "d")} <= set(rows) and len(rows) == 4
    assert {r._rescued_data for r in found.collect()} >= {None, '{"id":"x"}', '{"more":"e"}'}


def test_late_rows_are_dropped(spark, root):
    schema = "k long, ts timestamp"
    land_ = lambda *r: spark.createDataFrame(list(r), "k long, ts string").select("k", F.col("ts").cast("timestamp").alias("ts")).write.mode("append").parquet(f"{root}/in")
    run = lambda: ingest.deduplicated(spark, f"{root}/in", schema, ["k", "ts"], "ts", "1 hour", f"{root}/table", f"{root}/checkpoint")
    land_((1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00"))
    assert run().count() == 2
    land_((3, "2024-01-01 12:00:00"), (2, "2024-01-02 00:00:00"), (4, "2024-01-01 23:30:00"))
    assert sorted(r.k for r in run().collect()) == [1, 2, 4]


def test_a_repeated_batch_is_skipped(spark, root):
    t = LakeTable(spark, f"{root}/t").create("k long")
    df = spark.range(3).toDF("k")
    assert t.append(df, stream=("s", 0)) == 1 and t.append(df, stream=("s", 0)) is None and t.append(df, stream=("other", 0)) == 2
    assert t.read().count() == 6


def test_messages_resume_and_offsets(spark, root):
    path = root.removeprefix("file:")
    messages.send(path, "t", 0, ['{"id": 1}', "broken", '{"id": "x"}'], ["a", "b", "c"], at=10.0)
    out = LakeTable(spark, f"{root}/consumed")
    run = lambda: ingest.into_table(messages.payloads(messages.messages(spark, path=path, subscribe="t"), "id int"), out, f"{root}/checkpoint")
    run()
    messages.send(path, "t", 1, ['{"id": 2}'])
    run()
    run()
    assert got(out.read().select("id", "message_key", "partition", "offset", "raw")) == sorted([(1, "a", 0, 0, None), (None, "b", 0, 1, "broken"), (None, "c", 0, 2, '{"id": "x"}'), (2, None, 1, 0, None)], key=repr)
    assert messages.messages(spark, stream=False, path=path, subscribe="t").count() == 4
    options = messages.kafka_options("host:9093", "t", "user", "secret")
    assert options["kafka.security.protocol"] == "SASL_SSL" and 'password="secret"' in options["kafka.sasl.jaas.config"]


def test_enforcement(spark, root):
    t = LakeTable(spark, f"{root}/t").create("a long, b string")
    for bad in ("1L AS a", "1L AS a, 'x' AS b, 2 AS c", "1 AS a, 'x' AS b", "'1' AS a, 'x' AS b"):
        with pytest.raises(SchemaMismatch):
            t.append(spark.sql(f"SELECT {bad}"))
    with pytest.raises(SchemaMismatch):
        t.append(spark.sql("SELECT 'x' AS a"), merge_schema=True)
    with pytest.raises(SchemaMismatch):
        t.widen_column("a", "int")
    t.append(spark.sql("SELECT 'y' AS b, 2L AS a"))  # by name, not by place
    t.append(spark.sql("SELECT 0.5D AS a, true AS c"), merge_schema=True)
    assert got(t.read()) == [(0.5, None, True), (2.0, "y", None)]


def test_declared_rules(spark, root):
    p = Pipeline(spark, f"{root}/lake")
    land(spark, root, "a.json", '{"k": 1}', '{"k": 2}')
    p.table("raw")(lambda: p.files(f"{root}/in", schema={"k": "int"}))

    @p.table()
    @p.expect("odd", "k % 2 = 1")
    @p.expect_or_drop("small", "k < 2")
    def small():
        return p.read_stream("raw").select("k")

    @p.materialized_view()
    @p.expect_or_fail("none", "k > 5")
    def strict():
        return p.read("raw").select("k")

    assert p.run("small") == ["raw", "small"]
    assert got(p.lake("small").read()) == [(1,)]
    assert got(p.expectations()) == [("small", "odd", 1, 1), ("small", "small", 1, 1)]
    with pytest.raises(Exception, match="strict: none"):
        p.run("strict")
    land(spark, root, "b.json", '{"k": 0}')
    p.run("small")
    p.run("small")
    assert got(p.lake("small").read()) == [(0,), (1,)]
    p.run("small", full_refresh=True)
    assert got(p.lake("small").read()) == [(0,), (1,)]
    p.materialized_view("a")(lambda: p.read("b"))
    p.materialized_view("b")(lambda: p.read("a"))
    with pytest.raises(ValueError, match="read each other"):
        p.run("a")
    with pytest.raises(ValueError, match="twice"):
        p.materialized_view("a")(lambda: None)


def test_small_functions(spark):
    df = spark.createDataFrame([("1548137353.0", " new york "), ("", ""), (None, None), ("x", "A")], "t string, n string")
    assert [tuple(r) for r in df.select(F.unix_seconds(C.epoch_timestamp(F.col("t"))), C.title(F.col("n")), C.code(F.col("n")), C.blank(F.col("n"))).collect()] == [(1548137353, "New York", "NEW YORK", False), (None, "", None, True), (None, None, None, True), (None, "A", "A", False)]
    flat = local.flattened(spark.createDataFrame([((1, ("x",)), [1])], "a struct<b: int, c: struct<d: string>>, e array<int>"))
    assert flat.columns == ["a.b", "a.c.d", "e"] and flat.select("`a.c.d`").first()[0] == "x"
    with pytest.raises(ValueError, match="no list"):
        local.from_rest(spark, "http://x", "a int", lambda url: {"a": 1})
    assert local.events(spark, 100, files=7).rdd.getNumPartitions() == 7
