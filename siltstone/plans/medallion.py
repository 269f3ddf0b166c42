"""Queries over the layers that keep state: files, versioned tables, streams, histories, declared datasets. Each has its SQL."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import columns as C
from ..operators import history, rows
from ..sources import local, messages
from ..sources.catalog import Catalog
from ..sources.folders import Folder, working
from ..sources.lake import LakeTable, SchemaMismatch
from ..streaming import ingest
from .pipeline import Pipeline
from .queries import Query, latest_lines, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def wrap(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return wrap


def lake(spark: SparkSession, name: str = "lake") -> LakeTable:
    return LakeTable(spark, working(spark, name))


def customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


def landed_csv(spark: SparkSession, d: str, root: str, half: int | None = None) -> str:
    c = customers(spark, d)
    c = c if half is None else c.where(F.col("c_custkey") % 2 == half)
    c.write.mode("append").csv(f"{root}/landing", header=True)
    return f"{root}/landing"


# files


@query("SELECT CAST(c_custkey AS VARCHAR) c_custkey, c_name, CAST(c_nationkey AS VARCHAR) c_nationkey, c_mktsegment FROM customer")
def q37_csv_strings(spark, d):
    """Header CSV by a glob, all columns as strings."""
    path = landed_csv(spark, d, working(spark, "csv"))
    return spark.read.csv(f"{path}/*.csv", header=True)


@query("SELECT CAST(c_custkey AS INTEGER) c_custkey, c_name, CAST(c_nationkey AS INTEGER) c_nationkey, c_mktsegment FROM customer")
def q38_csv_inferred(spark, d):
    return spark.read.csv(landed_csv(spark, d, working(spark, "csv")), header=True, inferSchema=True)


@query("SELECT event_id, event_type, user_id FROM events")
def q39_json_inferred(spark, d):
    root = working(spark, "json")
    table(spark, d, "events").select("event_id", "event_type", "user_id").write.json(root)
    return spark.read.json(root).select("event_id", "event_type", "user_id")


NESTED = "order_number string, ordered_products array<struct<id: string, qty: string, price: string, promotion_info: struct<promo_id: string>>>"


def bronze_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their lines nested, as text; every 101st order number is no number, every 103rd part's id is empty."""
    line = F.struct(
        F.when(F.col("l_partkey") % 103 == 0, "").otherwise(F.col("l_partkey").cast("string")).alias("id"),
        F.col("l_quantity").cast("int").cast("string").alias("qty"),
        F.col("l_extendedprice").cast("string").alias("price"),
        F.struct(F.col("l_suppkey").cast("string").alias("promo_id")).alias("promotion_info"),
    )
    number = F.when(F.col("l_orderkey") % 101 == 0, F.concat(F.lit("bad-"), F.col("l_orderkey").cast("string"))).otherwise(F.col("l_orderkey").cast("string"))
    return table(spark, d, "lineitem").groupBy(number.alias("order_number")).agg(F.collect_list(line).alias("ordered_products"))


def landed_orders(spark: SparkSession, d: str) -> DataFrame:
    root = working(spark, "orders")
    bronze_orders(spark, d).write.json(root)
    return spark.read.schema(NESTED).json(f"{root}/*.json")


@query("SELECT CASE WHEN l_orderkey % 101 = 0 THEN 'bad-' || CAST(l_orderkey AS VARCHAR) ELSE CAST(l_orderkey AS VARCHAR) END order_number, CAST(l_suppkey AS VARCHAR) promo_id, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) qty FROM lineitem")
def q40_json_nested(spark, d):
    """Nested JSON with an explicit schema, exploded, two levels deep."""
    return landed_orders(spark, d).select("order_number", F.explode("ordered_products").alias("line")).select("order_number", "line.promotion_info.promo_id", "line.qty")


def ingested_csv(spark: SparkSession, d: str, typed: bool) -> DataFrame:
    """Two halves that land one after the other; the second is taken in by a new object."""
    root = working(spark, "csv-ingest")
    for half in (0, 1):
        landed_csv(spark, d, root, half)
        found = ingest.FileIngest(spark, f"{root}/landing", f"{root}/table", f"{root}/checkpoint", fmt="csv", infer_types=typed, metadata=typed).run()
    return found


@query("SELECT CAST(c_custkey AS INTEGER) c_custkey, c_name, CAST(c_nationkey AS INTEGER) c_nationkey, true AS stamped FROM customer")
def q41_csv_incremental_typed(spark, d):
    stamped = F.col("source_filename").endswith(".csv") & F.col("ingestion_timestamp").isNotNull() & F.col("load_date").isNotNull()
    return ingested_csv(spark, d, True).select("c_custkey", "c_name", "c_nationkey", stamped.alias("stamped"))


@query("SELECT CAST(c_custkey AS VARCHAR) c_custkey, c_name, CAST(c_nationkey AS VARCHAR) c_nationkey, c_mktsegment FROM customer")
def q42_csv_incremental_strings(spark, d):
    return ingested_csv(spark, d, False).drop(ingest.RESCUED)


@query("SELECT event_id, CASE WHEN event_id % 500 = 0 THEN NULL ELSE event_type END event_type, CASE WHEN event_id % 500 = 0 THEN '{\"_malformed\":\"broken ' || CAST(event_id AS VARCHAR) || '\"}' WHEN event_id % 7 = 0 THEN '{\"extra\":\"' || event_type || '\"}' END rescued FROM (SELECT CASE WHEN event_id % 500 = 0 THEN NULL ELSE event_id END AS shown, * FROM events) WHERE event_id % 500 <> 0 UNION ALL SELECT NULL, NULL, '{\"_malformed\":\"broken ' || CAST(event_id AS VARCHAR) || '\"}' FROM events WHERE event_id % 500 = 0")
def q43_rescue_all(spark, d):
    """Lines that are no JSON and keys that the schema lacks come back whole."""
    root, e = working(spark, "rescue"), table(spark, d, "events")
    row = F.to_json(F.struct("event_id", "event_type", F.when(F.col("event_id") % 7 == 0, F.col("event_type")).alias("extra")))
    e.select(F.when(F.col("event_id") % 500 == 0, F.concat(F.lit("broken "), "event_id")).otherwise(row).alias("value")).write.text(f"{root}/landing")
    found = ingest.FileIngest(spark, f"{root}/landing", f"{root}/table", f"{root}/checkpoint", {"event_id": "bigint", "event_type": "string"}).run()
    return found.select("event_id", "event_type", F.col(ingest.RESCUED).alias("rescued"))


@query("SELECT count(*) total_rows, CAST(2 AS BIGINT) files FROM nation")
def q44_file_metadata(spark, d):
    root = working(spark, "metadata")
    n = table(spark, d, "nation")
    for half in (0, 1):
        n.where(F.col("n_nationkey") % 2 == half).coalesce(1).write.mode("append").json(root)
    return spark.read.json(root).select("n_name", F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("total_rows"), F.countDistinct("path").alias("files"))


@query("SELECT count(*) total_rows, true AS many_files FROM events WHERE event_id % 10 = 0")
def q45_small_files(spark, d):
    """Many small JSON files, taken in by batches of at most 20 of them."""
    root = working(spark, "small")
    table(spark, d, "events").where("event_id % 10 = 0").select("event_id").repartition(40).write.mode("append").json(f"{root}/landing")
    job = ingest.FileIngest(spark, f"{root}/landing", f"{root}/table", f"{root}/checkpoint", {"event_id": "bigint"}, files_per_batch=20)
    batches = [p for p in job.run_once() if p["numInputRows"]]
    return job.read().agg(F.count("*").alias("total_rows")).withColumn("many_files", F.lit(len(batches) > 1))


# rows from elsewhere


@query("SELECT n_name, n_name || '.example' AS \"site.host\", n_regionkey AS \"site.region.id\" FROM nation")
def q46_rest_flattened(spark, d):
    """Records of a (stubbed) service, nested fields laid flat under dotted names."""
    n = [{"n_name": r.n_name, "site": {"host": f"{r.n_name}.example", "region": {"id": r.n_regionkey}}} for r in table(spark, d, "nation").collect()]
    found = local.from_rest(spark, "http://nations.example/all", "n_name string, site struct<host: string, region: struct<id: int>>", lambda url: {"results": json.loads(json.dumps(n))}, "results")
    return local.flattened(found)


@query("SELECT * FROM (VALUES ('a', CAST(1 AS BIGINT)), ('b', NULL), ('c', CAST(3 AS BIGINT))) t(name, n)")
def q47_local_rows(spark, d):
    return local.from_rows(spark, [{"name": "a", "n": 1}, {"name": "b"}, {"n": 3, "name": "c"}])


@query("SELECT n_regionkey, count(*) nations FROM nation GROUP BY n_regionkey")
def q48_temp_view(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("siltstone_nations")
    return spark.sql("SELECT n_regionkey, count(*) AS nations FROM siltstone_nations GROUP BY n_regionkey")


@query("SELECT CAST(i AS INTEGER) event_id, ['click','purchase','login','logout'][CAST(((i * 7919 + 104729) % 1000003) % 4 + 1 AS INTEGER)] event_type, CAST(((i * 7919 + 104729) % 1000003) % 1000 + 1 AS INTEGER) user_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(i) AS \"timestamp\" FROM range(10000) r(i)")
def q49_generated_events(spark, d):
    return local.events(spark, 10_000)


EVENT = "event_id int, event_type string, user_id int, timestamp string"


def topic(root: str, a: int, b: int) -> None:
    """Messages a to b, dealt over two partitions."""
    for p in (0, 1):
        ids = [i for i in range(a, b) if i % 2 == p]
        messages.send(root, "events", p, [json.dumps({"event_id": i, "event_type": "click", "user_id": i % 7, "timestamp": "2024-01-01T00:00:00"}) if i % 10 else "{broken" for i in ids], [str(i) for i in ids])


@query("SELECT CASE WHEN i % 10 <> 0 THEN CAST(i AS INTEGER) END event_id, CASE WHEN i % 10 <> 0 THEN CAST(i % 7 AS INTEGER) END user_id, 'events' topic, CAST(i % 2 AS INTEGER) AS \"partition\", CAST(i // 2 AS BIGINT) AS \"offset\", i % 10 = 0 broken FROM range(150) r(i)")
def q50_messages(spark, d):
    """A topic replayed from its first message, stopped, and resumed on the same checkpoint after more came."""
    root, out = working(spark, "topic").removeprefix("file:"), lake(spark)
    for a, b in ((0, 100), (100, 150)):
        topic(root, a, b)
        stream = messages.payloads(messages.messages(spark, path=root, subscribe="events"), EVENT)
        ingest.into_table(stream, out, f"{root}-checkpoint")
    return out.read().select("event_id", "user_id", "topic", "partition", "offset", F.col("raw").isNotNull().alias("broken"))


@query("SELECT CAST(0 AS BIGINT) latest_rows, CAST(100 AS BIGINT) earliest_rows")
def q51_starting_offsets(spark, d):
    """On a fresh checkpoint, `latest` sees nothing of what is there, `earliest` all."""
    root = working(spark, "topic").removeprefix("file:")
    topic(root, 0, 100)
    n = {}
    for begin in ("latest", "earliest"):
        out = lake(spark)
        ingest.into_table(messages.messages(spark, path=root, subscribe="events", startingOffsets=begin), out, f"{root}-{begin}")
        n[begin] = out.read().count()
    return spark.createDataFrame([(n["latest"], n["earliest"])], "latest_rows long, earliest_rows long")


# versioned tables


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 = 0")
def q52_overwrite(spark, d):
    """A table overwritten in its schema, then with another one."""
    t, c = lake(spark), customers(spark, d)
    t.overwrite(c)
    t.overwrite(c.where("c_custkey % 2 = 0"))
    t.overwrite(c.where("c_custkey % 3 = 0").select("c_custkey", "c_mktsegment"), replace_schema=True)
    return t.read()


def rejects(t: LakeTable, df: DataFrame) -> bool:
    try:
        t.append(df)
    except SchemaMismatch:
        return True
    return False


@query("SELECT count(*) total_rows, true extra_rejected, true missing_rejected, true type_rejected FROM customer")
def q53_enforced_append(spark, d):
    """Frames with a column too many, one too few, or another type are not appended."""
    c = customers(spark, d)
    t = lake(spark).create(c.schema)
    t.append(c)
    extra, missing, kind = rejects(t, c.withColumn("note", F.lit("x"))), rejects(t, c.drop("c_name")), rejects(t, c.withColumn("c_nationkey", F.col("c_nationkey") + 0.5))
    return t.read().agg(F.count("*").alias("total_rows")).select("total_rows", F.lit(extra).alias("extra_rejected"), F.lit(missing).alias("missing_rejected"), F.lit(kind).alias("type_rejected"))


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 1 THEN 'late' END note FROM customer")
def q54_merge_schema(spark, d):
    """An append that brings a column; earlier rows read null."""
    c = customers(spark, d).select("c_custkey", "c_name")
    t = lake(spark).create(c.schema)
    t.append(c.where("c_custkey % 2 = 0"))
    t.append(c.where("c_custkey % 2 = 1").withColumn("note", F.lit("late")), merge_schema=True)
    return t.read()


@query("SELECT c_custkey, CAST(c_nationkey AS DOUBLE) + CASE WHEN c_custkey % 2 = 1 THEN 0.5 ELSE 0 END nation FROM customer")
def q55_widening(spark, d):
    """A BIGINT column takes doubles after it was widened; files of both types read as one."""
    c = customers(spark, d).select("c_custkey", F.col("c_nationkey").cast("bigint").alias("nation"))
    t = lake(spark).create(c.schema)
    t.append(c.where("c_custkey % 2 = 0"))
    t.widen_column("nation", "double")
    t.append(c.where("c_custkey % 2 = 1").withColumn("nation", F.col("nation") + F.lit(0.5).cast("double")))
    return t.read()


@query("SELECT c_custkey, c_name AS customer_name, CAST(NULL AS VARCHAR) c_mktsegment FROM customer")
def q56_rename_drop(spark, d):
    """Renamed in the log alone; a column dropped and added again doesn't bring its values back."""
    c = customers(spark, d).drop("c_nationkey")
    t = lake(spark).create(c.schema)
    t.append(c)
    files = t.detail().first().numFiles
    t.rename_column("c_name", "customer_name")
    t.drop_column("c_mktsegment")
    t.add_column("c_mktsegment", "string")
    if t.detail().first().numFiles != files:
        raise AssertionError("renaming wrote files")
    return t.read()


@query("SELECT count(*) total_rows, true same_rows, true fewer_files, true in_ranges, true refused FROM lineitem")
def q57_optimize_cluster(spark, d):
    """Many small files become few; clustering takes effect at the next optimize, and has no boolean keys."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", (F.col("l_quantity") > 25).alias("large"))
    t = lake(spark).create(l.schema)
    for k in range(3):
        t.append(l.where(F.col("l_orderkey") % 3 == k).repartition(4))
    before, many = t.read().agg(F.sum(F.xxhash64("l_orderkey", "l_quantity").cast("decimal(38)"))).first(), t.detail().first().numFiles
    t.optimize()
    fewer = t.detail().first().numFiles < many
    t.cluster_by("l_orderkey")
    t.optimize(64 << 10)
    try:
        t.cluster_by("large")
        refused = False
    except SchemaMismatch:
        refused = True
    state = t.state()
    spans = sorted(map(tuple, t._frame(state, state.files, "file").groupBy("file").agg(F.min("l_orderkey"), F.max("l_orderkey")).select(F.min("min(l_orderkey)").over(_each()), F.max("max(l_orderkey)").over(_each())).collect()))
    ranges = all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    same = t.read().agg(F.sum(F.xxhash64("l_orderkey", "l_quantity").cast("decimal(38)"))).first() == before
    flags = {"same_rows": same, "fewer_files": fewer, "in_ranges": ranges, "refused": refused}
    return t.read().agg(F.count("*").alias("total_rows")).select("total_rows", *[F.lit(v).alias(k) for k, v in flags.items()])


def _each():
    from pyspark.sql import Window

    return Window.partitionBy("file")


@query("SELECT count(*) total_rows, true dry_run_kept, true old_gone, true young_kept FROM customer")
def q58_vacuum(spark, d):
    """A dry run lists, a vacuum deletes what no kept version needs; young versions keep their files."""
    c = customers(spark, d)
    t = lake(spark)
    t.overwrite(c.where("c_custkey % 2 = 0"))
    t.overwrite(c)
    young = not t.vacuum(dry_run=True)
    listed = t.vacuum(0, dry_run=True)
    there = t.read(version=1).count() > 0
    gone = t.vacuum(0) == listed and len(listed) > 0
    flags = {"dry_run_kept": there, "old_gone": gone, "young_kept": young}
    return t.read().agg(F.count("*").alias("total_rows")).select("total_rows", *[F.lit(v).alias(k) for k, v in flags.items()])


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'CREATE TABLE', CAST(NULL AS BIGINT)), (1, 'WRITE', (SELECT count(*) FROM customer)), (2, 'MERGE', (SELECT count(*) FROM customer)), (3, 'SET TBLPROPERTIES', NULL)) t(version, operation, output_rows)")
def q59_history(spark, d):
    """Versions, operations and their metrics, read out of a map."""
    c = customers(spark, d).select("c_custkey", "c_mktsegment")
    t = lake(spark).create(c.schema)
    t.append(c.coalesce(1))
    history.merge_scd1(t, c.where("c_custkey < 5").withColumn("c_mktsegment", F.lit("ZZ")), ["c_custkey"])
    t.set_properties(owner="sales")
    return t.history().select("version", "operation", F.col("operationMetrics.numOutputRows").cast("bigint").alias("output_rows"))


@query("SELECT 'sales' AS owner, CAST(1 AS BIGINT) one_file, true has_bytes, 'c_custkey' AS clustered FROM region WHERE r_regionkey = 0")
def q60_detail_properties(spark, d):
    c = customers(spark, d)
    t = lake(spark).create(c.schema, properties={"owner": "nobody"})
    t.append(c.coalesce(1))
    t.set_properties(owner="sales")
    t.cluster_by("c_custkey")
    return t.detail().select(F.col("properties.owner").alias("owner"), F.col("numFiles").alias("one_file"), (F.col("sizeInBytes") > 0).alias("has_bytes"), F.array_join("clusteringColumns", ",").alias("clustered"))


@query("SELECT * FROM (VALUES ('c_custkey', 'bigint'), ('c_nationkey', 'int')) t(col_name, data_type)")
def q61_describe(spark, d):
    t = lake(spark).create(customers(spark, d).schema)
    return t.describe().where("col_name IN ('c_custkey', 'c_nationkey')")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def q62_time_travel(spark, d):
    """The rows of an earlier version, after they were merged over and optimized."""
    c = customers(spark, d).select("c_custkey", "c_mktsegment")
    t = lake(spark).create(c.schema)
    version = t.append(c)
    history.merge_scd1(t, c.withColumn("c_mktsegment", F.lit("ZZ")), ["c_custkey"])
    t.optimize()
    return t.read(version=version)


@query("SELECT count(*) total_rows, true dropped, true still_there FROM region")
def q63_create_drop(spark, d):
    """CREATE IF NOT EXISTS leaves a table as it is; DROP IF EXISTS may be repeated."""
    r = table(spark, d, "region")
    t = lake(spark).create(r.schema)
    t.append(r)
    t.create("other int", if_not_exists=True)
    still = t.read().count()
    t.drop()
    t.drop()
    return spark.createDataFrame([(still, not t.exists(), still > 0)], "total_rows long, dropped boolean, still_there boolean")


# streams


@query("SELECT event_id, event_type FROM events")
def q64_stream_to_table(spark, d):
    """A stream into a table, and a stream over that table's log into another; both restarted in between."""
    root, e = working(spark, "stream"), table(spark, d, "events").select("event_id", "event_type")
    first, second = LakeTable(spark, f"{root}/first"), LakeTable(spark, f"{root}/second").create(e.schema)
    name = ingest.stream_name(spark, f"{root}/second-checkpoint")
    for half in (0, 1):
        e.where(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{root}/landing")
        ingest.into_table(spark.readStream.schema(e.schema).parquet(f"{root}/landing"), first, f"{root}/first-checkpoint")
        first.optimize()
        first.stream_to(lambda df, n: second.append(df, stream=(name, n)) and None, f"{root}/second-checkpoint")
    return second.read()


@query("SELECT 2 * count(*) total_rows, count(*) distinct_rows FROM events")
def q65_checkpoint_deleted(spark, d):
    """Without its checkpoint a stream takes everything in again, as new rows; nothing old is lost."""
    root = working(spark, "again")
    table(spark, d, "events").select("event_id").write.json(f"{root}/landing")
    for k in range(2):
        found = ingest.FileIngest(spark, f"{root}/landing", f"{root}/table", f"{root}/checkpoint", {"event_id": "bigint"}).run()
        Folder(spark, f"{root}/checkpoint").delete()
    return found.agg(F.count("*").alias("total_rows"), F.countDistinct("event_id").alias("distinct_rows"))


@query("SELECT CAST(5 AS BIGINT) total_rows, CAST(5 AS BIGINT) input_rows, CAST(5 AS BIGINT) history_rows")
def q66_interval_and_progress(spark, d):
    """Run by an interval, stopped after a bounded wait; rows by the stream's progress and by the table's history."""
    root = working(spark, "interval")
    spark.range(5).select((F.col("id") * 10).alias("value")).repartition(5).write.json(f"{root}/landing")
    job = ingest.FileIngest(spark, f"{root}/landing", f"{root}/table", f"{root}/checkpoint", {"value": "int"})
    batches = job.run_once({"processingTime": "1 second"}, wait=3)
    seen = sum(p["numInputRows"] for p in batches)
    written = job.table.history().where("operation = 'STREAMING UPDATE'").agg(F.sum(F.col("operationMetrics.numOutputRows").cast("bigint")).alias("history_rows"))
    return written.select(F.lit(job.read().count()).cast("long").alias("total_rows"), F.lit(seen).cast("long").alias("input_rows"), "history_rows")


@query("SELECT user_id, ts FROM (SELECT DISTINCT user_id, ts FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 2 DAY FROM events) AND event_id % 2 = 0)")
def q67_late_rows(spark, d):
    """Rows later than the watermark are dropped by a deduplicating stream: the second batch holds nothing that is not late."""
    root = working(spark, "late")
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    last = F.lit(e.agg(F.max("ts")).first()[0])
    e.where((F.col("ts") >= last - F.expr("INTERVAL 2 DAYS")) & (F.col("event_id") % 2 == 0)).union(e.where(F.col("ts") == last)).where("event_id % 2 = 0").drop("event_id").write.parquet(f"{root}/landing")
    run = lambda: ingest.deduplicated(spark, f"{root}/landing", "user_id long, ts timestamp", ["user_id", "ts"], "ts", "1 hour", f"{root}/table", f"{root}/checkpoint")
    run()
    e.where(F.col("ts") < last - F.expr("INTERVAL 10 DAYS")).drop("event_id").write.mode("append").parquet(f"{root}/landing")
    return run().select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


# quality and histories


@query("SELECT CAST(c_custkey AS VARCHAR) AS customer_id, 'customer_id did not cast to INT' rejection_reason, true AS stamped FROM customer WHERE false UNION ALL SELECT 'bad-' || CAST(c_custkey AS VARCHAR), 'customer_id did not cast to INT', true FROM customer WHERE c_custkey % 97 = 0")
def q68_quarantine_table(spark, d):
    """Rejects with reason and time go to a table of their own, merged by their content: a rerun adds none."""
    key = F.col("c_custkey").cast("string")
    raw = customers(spark, d).select(F.when(F.col("c_custkey") % 97 == 0, F.concat(F.lit("bad-"), key)).otherwise(key).alias("customer_id"))
    t = lake(spark).create("customer_id string, rejection_reason string, quarantined_at timestamp")
    for _ in range(2):
        bad, _ = rows.quarantined(raw, [("customer_id did not cast to INT", F.col("customer_id").try_cast("int").isNull())])
        history.merge_scd1(t, bad.drop("quarantined_at").distinct(), ["customer_id", "rejection_reason"], audit={"quarantined_at": F.current_timestamp()})
    return t.read().select("customer_id", "rejection_reason", F.col("quarantined_at").isNotNull().alias("stamped"))


@query("SELECT true passes, 'c_mktsegment' AS missing, 'note' AS unexpected FROM region WHERE r_regionkey = 0")
def q69_contract(spark, d):
    """A frame that keeps its contract passes; one with a column too many and one too few is told both."""
    c = customers(spark, d).select("c_custkey", "c_mktsegment")
    agreed = {"c_custkey": "bigint", "c_mktsegment": "string"}
    passes = rows.check_contract(c, agreed) is c
    try:
        rows.check_contract(c.drop("c_mktsegment").withColumn("note", F.lit("x")), agreed)
        said = ""
    except rows.ContractViolation as e:
        said = str(e)
    return spark.createDataFrame([(passes, "c_mktsegment" if "missing ['c_mktsegment']" in said else said, "note" if "unexpected ['note']" in said else said)], "passes boolean, missing string, unexpected string")


@query("SELECT count(*) total_rows, count(*) FILTER (NOT coalesce(value > 10, false)) broken_value, count(*) FILTER (event_type IS NULL) broken_type FROM events")
def q70_expectation_counts(spark, d):
    """Rows are dropped and counted in one pass."""
    rules = {"value": F.col("value") > 10, "type": F.col("event_type").isNotNull()}
    df, seen = rows.observed(table(spark, d, "events").select("event_id", "value", "event_type"), rules)
    rows.expect(df, rules).write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(got["rows"], got["value"], got["type"])], "total_rows long, broken_value long, broken_type long")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'UPDATED' ELSE c_mktsegment END seg, CAST(c_custkey % 10 = 0 AS INTEGER) writes FROM customer UNION ALL SELECT c_custkey + 1000000, 'NEW', 1 FROM customer WHERE c_custkey % 50 = 0")
def q71_scd1_table(spark, d):
    """A merge into a table, run twice: the second changes nothing and writes no version. `writes` counts what was set."""
    c = customers(spark, d).select("c_custkey", F.col("c_mktsegment").alias("seg"))
    t = lake(spark).create("c_custkey bigint, seg string, writes int")
    t.append(c.withColumn("writes", F.lit(0)))
    source = c.where("c_custkey % 10 = 0").withColumn("seg", F.lit("UPDATED")).unionByName(c.where("c_custkey % 50 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("NEW").alias("seg")))
    for k in (1, 2):
        history.merge_scd1(t, source, ["c_custkey"], audit={"writes": F.lit(k)})
    return t.read()


def snapshots(spark: SparkSession, d: str) -> LakeTable:
    """Customers of day 1 and day 2, when 25 changed, one (key 30) lost its segment and one is new; day 2 is run twice."""
    c = customers(spark, d).select("c_custkey", F.col("c_mktsegment").alias("seg"))
    t = lake(spark).create("c_custkey bigint, seg string, effective_start timestamp_ntz, effective_end timestamp_ntz, is_current boolean")
    history.merge_scd2(t, c, ["c_custkey"], ["seg"], F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    changed = c.withColumn("seg", F.when(F.col("c_custkey") < 25, "ZZ").when(F.col("c_custkey") == 30, None).otherwise(F.col("seg")))
    second = changed.unionByName(c.where("c_custkey = 1").select(F.lit(-1).cast("bigint").alias("c_custkey"), "seg"))
    for _ in range(2):
        history.merge_scd2(t, second, ["c_custkey"], ["seg"], F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return t


@query(
    "WITH k AS (SELECT c_custkey, c_mktsegment seg, c_custkey < 25 OR c_custkey = 30 moved FROM customer)"
    " SELECT c_custkey, seg, TIMESTAMP '2024-01-01' effective_start, CASE WHEN moved THEN TIMESTAMP '2024-02-01' END effective_end, NOT moved is_current FROM k"
    " UNION ALL SELECT c_custkey, CASE WHEN c_custkey < 25 THEN 'ZZ' END, TIMESTAMP '2024-02-01', NULL, true FROM k WHERE moved"
    " UNION ALL SELECT -1, seg, TIMESTAMP '2024-02-01', NULL, true FROM k WHERE c_custkey = 1"
)
def q72_scd2_table(spark, d):
    return snapshots(spark, d).read()


@query("SELECT c_custkey, c_mktsegment seg FROM customer")
def q73_as_of(spark, d):
    """The history as it stood in the middle of January."""
    at = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return snapshots(spark, d).read().where((F.col("effective_start") <= at) & (F.col("effective_end").isNull() | (F.col("effective_end") > at))).select("c_custkey", "seg")


@query('WITH x AS (SELECT *, lag(event_type) OVER w p, row_number() OVER w rn FROM (SELECT user_id, ts, max(event_type) event_type FROM events GROUP BY user_id, ts) WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT * FROM x WHERE rn=1 OR event_type IS DISTINCT FROM p) SELECT user_id, event_type, ts AS "__START_AT", lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS "__END_AT" FROM y')
def q74_cdc_table(spark, d):
    """A change feed that comes in three parts, the latest first and one of them twice, gives the history of the whole."""
    e = table(spark, d, "events").select("user_id", "event_type", "ts")
    feed, t = lake(spark, "feed").create(e.schema), lake(spark).create("user_id bigint, event_type string, __START_AT timestamp_ntz, __END_AT timestamp_ntz")
    part = F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(3))
    for k in (2, 0, 2, 1):
        history.merge_changes(feed, t, e.where(part == k), ["user_id"], ["event_type"], "ts")
    return t.read()


# the silver order lines, end to end


def silver_lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected) order lines of nested bronze orders: typed, quarantined by reason, one line an order and product."""
    raw = landed_orders(spark, d).select(F.col("order_number").alias("raw_number"), F.explode_outer("ordered_products").alias("line"))
    lines = raw.select("raw_number", F.col("raw_number").try_cast("bigint").alias("order_number"), F.col("line.id").alias("product_id"), F.col("line.price").try_cast("double").alias("unit_price"), F.col("line.qty").try_cast("bigint").alias("quantity"), F.col("line.promotion_info.promo_id").try_cast("bigint").alias("promo_id"))
    bad, good = rows.quarantined(lines, [("order_number did not cast to BIGINT", F.col("order_number").isNull()), ("product_id missing", C.blank(F.col("product_id")))])
    clean = rows.latest(good.drop("raw_number"), ["order_number", "product_id"], ["unit_price"])
    return clean.withColumn("line_revenue", C.line_revenue(F.col("unit_price"), F.col("quantity"))), bad


GOOD = "SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_extendedprice DESC, CAST(l_quantity AS BIGINT), l_suppkey) rn FROM lineitem WHERE l_orderkey % 101 <> 0 AND l_partkey % 103 <> 0"


@query(f"SELECT l_orderkey order_number, CAST(l_partkey AS VARCHAR) product_id, l_extendedprice unit_price, CAST(l_quantity AS BIGINT) quantity, round(l_extendedprice * l_quantity, 2) line_revenue FROM ({GOOD}) WHERE rn = 1")
def q75_silver_lines(spark, d):
    """The flow into a table by a type 1 merge, run twice."""
    clean, _ = silver_lines(spark, d)
    t = lake(spark).create("order_number bigint, product_id string, unit_price double, quantity bigint, promo_id bigint, line_revenue double, silver_updated_at timestamp")
    for _ in range(2):
        history.merge_scd1(t, clean, ["order_number", "product_id"], audit={"silver_updated_at": F.current_timestamp()})
    return t.read().where("silver_updated_at IS NOT NULL").select("order_number", "product_id", "unit_price", "quantity", "line_revenue")


@query("SELECT CASE WHEN l_orderkey % 101 = 0 THEN 'order_number did not cast to BIGINT' ELSE 'product_id missing' END rejection_reason, count(*) n FROM lineitem WHERE l_orderkey % 101 = 0 OR l_partkey % 103 = 0 GROUP BY 1")
def q76_silver_rejects(spark, d):
    return silver_lines(spark, d)[1].groupBy("rejection_reason").agg(F.count("*").alias("n"))


# declared datasets


def declared(spark: SparkSession, d: str) -> tuple[Pipeline, str]:
    """Bronze customers and orders from files, clean ones, a history and the latest valid order of each customer."""
    root = working(spark, "declared")
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"), F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("segment"), F.lit(1704067200).cast("string").alias("valid_from"))
    c.write.json(f"{root}/customers")
    table(spark, d, "orders").select(F.col("o_custkey").alias("customer_id"), "o_orderkey", F.col("o_orderdate").cast("string").alias("ordered"), "o_totalprice").write.json(f"{root}/orders")
    p = Pipeline(spark, f"{root}/lake")
    p.table("brz_customers", "customers as they land")(lambda: p.files(f"{root}/customers"))
    p.table("brz_orders", "orders as they land")(lambda: p.files(f"{root}/orders", schema={"customer_id": "bigint", "o_orderkey": "bigint", "ordered": "string", "o_totalprice": "double"}))

    @p.table(comment="typed customers with an id")
    @p.expect_or_drop("has_id", "customer_id IS NOT NULL")
    def slv_customers_clean():
        b = p.read_stream("brz_customers")
        return b.select(F.col("customer_id").try_cast("bigint").alias("customer_id"), C.code(F.col("segment")).alias("segment"), C.epoch_timestamp(F.col("valid_from")).cast("timestamp_ntz").alias("valid_from_ts"))

    p.create_streaming_table("slv_customers_history")
    p.create_auto_cdc_flow("slv_customers_history", "slv_customers_clean", ["customer_id"], "valid_from_ts", track_columns=["segment"])

    @p.materialized_view(comment="the latest order of each customer, if it is large")
    @p.expect_or_drop("large", "o_totalprice > 100000")
    def slv_orders_clean():
        b = p.read("brz_orders")
        return rows.keep_first(b, ["customer_id"], [F.col("ordered").desc_nulls_last(), F.col("o_orderkey").desc()]).select("customer_id", "o_orderkey", "o_totalprice")

    return p, root


@query('SELECT c_custkey customer_id, upper(c_mktsegment) segment, TIMESTAMP \'2024-01-01 00:00:00\' AS "__START_AT", CASE WHEN c_custkey < 25 THEN TIMESTAMP \'2024-04-01 00:00:00\' END AS "__END_AT" FROM customer UNION ALL SELECT c_custkey, \'ZZ\', TIMESTAMP \'2024-04-01 00:00:00\', NULL FROM customer WHERE c_custkey < 25')
def q77_declared_history(spark, d):
    """Two updates: the second takes in only what landed since, later versions of 25 customers and a row without an id."""
    p, root = declared(spark, d)
    p.run()
    late = table(spark, d, "customer").where("c_custkey < 25").select(F.col("c_custkey").cast("string").alias("customer_id"), F.lit("zz").alias("segment"), F.lit(1711929600).cast("string").alias("valid_from"))
    late.unionByName(late.limit(1).withColumn("customer_id", F.lit("none"))).write.mode("append").json(f"{root}/customers")
    p.run()
    return p.lake("slv_customers_history").read()


@query("SELECT * FROM (VALUES ('brz_customers', 'slv_customers_clean'), ('slv_customers_clean', 'slv_customers_history'), ('brz_orders', 'slv_orders_clean')) t(source, target)")
def q78_declared_lineage(spark, d):
    p, _ = declared(spark, d)
    order = p.run()
    if sorted(order, key=order.index) != order or order.index("brz_customers") > order.index("slv_customers_history"):
        raise AssertionError(f"wrong order {order}")
    return p.lineage()


@query("SELECT o_custkey customer_id, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rn FROM orders) WHERE rn = 1 AND o_totalprice > 100000")
def q79_declared_view(spark, d):
    """A full refresh builds the same rows again."""
    p, _ = declared(spark, d)
    p.run("slv_orders_clean")
    p.run("slv_orders_clean", full_refresh=True)
    return p.lake("slv_orders_clean").read()


@query("SELECT 'slv_orders_clean' dataset, 'large' expectation, count(*) FILTER (o_totalprice > 100000) passed, count(*) FILTER (NOT o_totalprice > 100000) failed FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rn FROM orders) WHERE rn = 1")
def q80_declared_expectations(spark, d):
    p, _ = declared(spark, d)
    p.run("slv_orders_clean")
    return p.expectations()


# single operators


@query("SELECT c_custkey, upper(left(lower(c_mktsegment), 1)) || lower(substr(c_mktsegment, 2)) title FROM customer")
def q81_initcap(spark, d):
    return customers(spark, d).select("c_custkey", C.title(F.concat(F.lit(" "), F.lower("c_mktsegment"))).alias("title"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN make_timestamp(CAST(epoch(o_orderdate) AS BIGINT) * 1000000) END order_ts FROM orders")
def q82_epoch_text(spark, d):
    """Epoch seconds as text, with '.0' or broken, by nested try_casts."""
    o = table(spark, d, "orders")
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string")
    text = F.when(F.col("o_orderkey") % 10 == 0, "").when(F.col("o_orderkey") % 3 == 0, F.concat(seconds, F.lit(".0"))).otherwise(seconds)
    return o.select("o_orderkey", C.epoch_timestamp(text).cast("timestamp_ntz").alias("order_ts"))


@query("SELECT count(*) total_rows, true now_is_one, true today_is_its_day FROM region")
def q83_now(spark, d):
    """One time and one day for all rows of a run."""
    r = table(spark, d, "region").select(F.current_timestamp().alias("now"), F.current_date().alias("today"))
    return r.agg(F.count("*").alias("total_rows"), (F.countDistinct("now") == 1).alias("now_is_one"), F.every(F.to_date("now") == F.col("today")).alias("today_is_its_day"))


@query("SELECT c_custkey, c_custkey * 2 AS twice, upper(c_name) AS name FROM customer")
def q84_select_expr(spark, d):
    return customers(spark, d).selectExpr("c_custkey", "c_custkey * 2 AS twice", "upper(c_name) AS name")


@query("SELECT least(count(*), 10) n, true of_the_table FROM customer")
def q85_limit(spark, d):
    """Any ten rows of the table."""
    c = customers(spark, d)
    ten = c.limit(10)
    return ten.join(c.select("c_custkey").distinct(), "c_custkey", "left_semi").agg(F.count("*").alias("n")).withColumn("of_the_table", F.lit(True))


@query('SELECT p_type, CAST(sum(CAST(p_size AS BIGINT)) AS BIGINT) AS total_size, count(p_brand) AS brands FROM part GROUP BY p_type')
def q86_dict_aggregate(spark, d):
    """The dict form of agg, and its generated names renamed."""
    found = table(spark, d, "part").groupBy("p_type").agg({"p_size": "sum", "p_brand": "count"})
    return found.withColumnRenamed("sum(p_size)", "total_size").withColumnRenamed("count(p_brand)", "brands")


@query("SELECT event_id, nullif(t, '') shown FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE event_type END t FROM events) WHERE t IS NULL OR t = '' OR (t <> '' AND t = 'click')")
def q87_null_or_empty(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, None).when(F.col("event_id") % 4 == 1, "").otherwise(F.col("event_type")).alias("t"))
    return e.where("t IS NULL OR t = '' OR (t != '' AND t = 'click')").select("event_id", F.nullif("t", F.lit("")).alias("shown"))


@query("SELECT l_shipdate IS NULL no_date, count(*) total_rows, CAST(0 AS BIGINT) null_l_quantity FROM lineitem GROUP BY 1")
def q88_null_profile(spark, d):
    found = rows.null_counts(table(spark, d, "lineitem"), ["l_quantity", "l_shipdate"])
    return found.select((F.col("null_l_shipdate") == F.col("total_rows")).alias("no_date"), "total_rows", "null_l_quantity")


@query("SELECT count(*) total_rows, true waited FROM customer")
def q89_as_of_time(spark, d):
    """A version by time: what was there before the rows were cut down."""
    c = customers(spark, d)
    t = lake(spark)
    t.overwrite(c)
    time.sleep(0.05)
    then = time.time()
    time.sleep(0.05)
    t.overwrite(c.limit(1))
    return t.read(as_of=then).agg(F.count("*").alias("total_rows")).withColumn("waited", F.lit(t.read().count() == 1))


@query("SELECT p_name, CAST(sum(CAST(round(l_extendedprice * l_quantity, 2) AS DECIMAL(18,2))) AS DOUBLE) total_revenue, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) total_units FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey,l_partkey ORDER BY l_extendedprice DESC NULLS LAST, l_linenumber, l_suppkey, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) rn FROM lineitem) WHERE rn=1) JOIN part ON p_partkey=l_partkey GROUP BY p_name ORDER BY total_revenue DESC, p_name LIMIT 10")
def q90_line_revenue_top10(spark, d):
    lines = latest_lines(spark, d).withColumn("line_revenue", C.line_revenue(F.col("l_extendedprice"), F.col("l_quantity")))
    found = lines.join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("p_name")
    return found.agg(C.money(F.col("line_revenue")).alias("total_revenue"), F.sum(F.col("l_quantity").cast("bigint")).alias("total_units")).orderBy(F.desc("total_revenue"), "p_name").limit(10)


@query("SELECT n_name, n_regionkey FROM nation")
def q91_named_table(spark, d):
    """A table of a schema, written and read by its name."""
    found = Catalog(spark, working(spark, "catalog"))
    found.create_schema("bronze")
    found.create_schema("bronze")
    found.table("bronze.nations").overwrite(table(spark, d, "nation").select("n_name", "n_regionkey"))
    if found.tables("bronze") != ["nations"]:
        raise AssertionError(f"tables {found.tables('bronze')}")
    return found.read("bronze.nations")


@query("SELECT n_name FROM nation WHERE n_regionkey = 1")
def q92_volume_files(spark, d):
    """Files put into a volume, copied, listed, removed, and read where they are."""
    found = Catalog(spark, working(spark, "catalog"))
    found.create_schema("raw")
    volume = found.create_volume("raw.landing")
    names = [r.n_name for r in table(spark, d, "nation").where("n_regionkey = 1").select("n_name").collect()]
    volume.write("in/a.json", "\n".join(json.dumps({"n_name": n}) for n in names))
    volume.copy("in", "out")
    volume.delete("in")
    if volume.children() != ["out"] or volume.children("out") != ["a.json"]:
        raise AssertionError(f"files {volume.files()}")
    return spark.read.json(f"{volume.path}/out")


@query("SELECT CAST(count(*) AS BIGINT) total_rows, CAST(8 AS BIGINT) columns, true printed FROM customer")
def q93_inspection(spark, d):
    """What display, show, printSchema and len(columns) tell of a frame."""
    c = table(spark, d, "customer").select("*", *[F.lit(k).alias(f"x{k}") for k in range(3)])
    shown = c.schema.treeString() if hasattr(c.schema, "treeString") else c._jdf.schema().treeString()
    text = c._show_string(2, False, False)
    return spark.createDataFrame([(c.count(), len(c.columns), "c_custkey" in shown and "|c_custkey" in text)], "total_rows long, columns long, printed boolean")


@query("SELECT event_type, CAST(count(*) AS BIGINT) n FROM events GROUP BY event_type")
def q94_producer_and_consumer(spark, d):
    """Events made by rule are sent as messages at a rate, consumed in a stream, and counted by type."""
    root, out = working(spark, "produced").removeprefix("file:"), lake(spark)
    e = table(spark, d, "events").select("event_id", "event_type", "user_id").orderBy("event_id")
    messages.send(root, "events", 0, (json.dumps(r.asDict()) for r in e.toLocalIterator()))
    ingest.into_table(messages.payloads(messages.messages(spark, path=root, subscribe="events"), "event_id long, event_type string, user_id long"), out, f"{root}-checkpoint")
    return out.read().where("raw IS NULL").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN c_custkey % 97 <> 0 THEN CAST(c_custkey AS INTEGER) END c_custkey, CAST(c_nationkey AS DOUBLE) c_nationkey, c_name, CASE WHEN c_custkey % 97 = 0 THEN 'bad-' ELSE '' END || CAST(c_custkey AS VARCHAR) raw_c_custkey FROM customer")
def q95_typed_with_raw(spark, d):
    """Text columns typed by a list of kinds; the key's raw text stays beside it."""
    key = F.col("c_custkey").cast("string")
    raw = customers(spark, d).select(F.when(F.col("c_custkey") % 97 == 0, F.concat(F.lit("bad-"), key)).otherwise(key).alias("c_custkey"), F.col("c_nationkey").cast("string").alias("c_nationkey"), "c_name")
    return C.typed(raw, {"c_custkey": "int", "c_nationkey": "double"}, ("c_custkey",))
