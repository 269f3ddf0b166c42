"""The engine's operators over the tables of one folder, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import history, rows
from ..sources.folders import working
from ..streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column: str) -> Column:
    """An exact sum, whatever the order of rows."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def latest_lines(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("l_extendedprice").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ("l_linenumber", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")]]
    return rows.keep_first(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"], order)


def latest_orders(spark: SparkSession, d: str) -> DataFrame:
    return rows.keep_first(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc()])


def raw_customers(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return table(spark, d, "customer").select(F.when(F.col("c_custkey") % 97 == 0, F.concat(F.lit("bad-"), key)).otherwise(key).alias("raw_id"), "c_name")


@query
def q01_project(spark, d):
    return table(spark, d, "part").select("p_name", "p_size", "p_type", "p_brand", "p_retailprice")


@query
def q02_filter_gt(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_quantity") > 40).select("l_orderkey", "l_partkey", "l_quantity")


@query
def q03_top_brands(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(money("p_retailprice").alias("total_sales")).orderBy(F.desc("total_sales"), "p_brand").limit(10)


@query
def q04_sales_by_type(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(money("p_retailprice").alias("total_sales"))


@query
def q05_sales_by_size(spark, d):
    return table(spark, d, "part").groupBy("p_size").agg(money("p_retailprice").alias("total_sales"))


@query
def q06_count_distinct_dups(spark, d):
    distinct = F.countDistinct("o_custkey")
    return table(spark, d, "orders").agg(F.count("*").alias("total_rows"), distinct.alias("distinct_customers"), (F.count("*") - distinct).alias("duplicate_rows"))


@query
def q07_count_distinct_multi(spark, d):
    distinct = F.countDistinct("l_orderkey", "l_partkey")
    return table(spark, d, "lineitem").agg(F.count("*").alias("total_rows"), distinct.alias("distinct_lines"), (F.count("*") - distinct).alias("duplicate_rows"))


@query
def q08_conditional_sums(spark, d):
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return table(spark, d, "lineitem").agg(F.count("*").alias("total_rows"), one(F.col("l_returnflag") == "R").alias("returned"), one(F.col("l_shipdate").isNull()).alias("null_shipdate"))


@query
def q09_dedup_lines(spark, d):
    return latest_lines(spark, d).select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")


@query
def q10_latest_order(spark, d):
    return latest_orders(spark, d).select("o_custkey", "o_orderkey", "o_orderdate")


@query
def q11_inner_join(spark, d):
    return table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey").join(table(spark, d, "customer"), "c_custkey", "inner").select("o_orderkey", "c_custkey", "c_mktsegment")


@query
def q12_left_anti(spark, d):
    pending = table(spark, d, "orders").where("o_orderstatus = 'P' AND o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(pending, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query
def q13_in_subquery(spark, d):
    chosen = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(chosen, "o_custkey", "left_semi").select("o_custkey", "o_orderkey", "o_totalprice")


@query
def q14_union_by_name(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return c.where("c_custkey < 25").withColumn("c_mktsegment", F.lit("ZZ")).unionByName(c.where("c_custkey >= 25"))


@query
def q15_distinct(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query
def q16_typed_customers(spark, d):
    return raw_customers(spark, d).select(F.col("raw_id").try_cast("int").alias("customer_id"), "c_name")


@query
def q17_quarantine(spark, d):
    bad, _ = rows.split(raw_customers(spark, d), F.col("raw_id").try_cast("int").isNull())
    return bad.select("raw_id", F.lit("customer_id did not cast to INT").alias("rejection_reason"))


@query
def q18_clean_half(spark, d):
    _, clean = rows.split(raw_customers(spark, d), F.col("raw_id").try_cast("int").isNull())
    return clean.select(F.col("raw_id").try_cast("int").alias("customer_id"), "c_name")


@query
def q19_reasoned_quarantine(spark, d):
    rules = [("order_number did not cast to BIGINT", F.col("l_orderkey") % 101 == 0), ("product_id missing", F.col("l_partkey") % 103 == 0)]
    return rows.reasoned(table(spark, d, "lineitem"), rules).select("l_orderkey", "l_linenumber", "rejection_reason")


@query
def q20_text_standardise(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.upper(F.trim(F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" ")))).alias("seg"))


@query
def q21_epoch_to_ts(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).cast("timestamp_ntz").alias("order_ts"))


@query
def q22_modulo_arith(spark, d):
    return table(spark, d, "customer").select("c_custkey", ((F.col("c_custkey") + 1) % 4).alias("loyalty"))


@query
def q23_nest_explode(spark, d):
    nested = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_quantity")).alias("products"))
    return nested.select("l_orderkey", F.explode("products").alias("item")).select("l_orderkey", "item.l_partkey", "item.l_quantity")


@query
def q24_line_revenue(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * F.col("l_quantity"), 2).alias("line_revenue"))


@query
def q25_from_json(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("event")).select("event_id", "event.*")


@query
def q26_revenue_top10(spark, d):
    """The flagship: deduplicated lines, joined, summed, the ten best."""
    lines = latest_lines(spark, d).join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return lines.groupBy("p_name").agg(money("l_extendedprice").alias("total_revenue"), F.sum(F.col("l_quantity").cast("bigint")).alias("total_units")).orderBy(F.desc("total_revenue"), "p_name").limit(10)


@query
def q27_scd1_upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    updates = c.where("c_custkey % 10 = 0").withColumn("seg", F.lit("UPDATED"))
    new = c.where("c_custkey % 50 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("NEW").alias("seg"))
    return history.upsert(c, updates.unionByName(new), ["c_custkey"])


def customer_history(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    opened = c.withColumn("version", F.lit(1)).withColumn("is_current", F.lit(True))
    return history.snapshot(opened, c.where("c_custkey < 25").withColumn("seg", F.lit("ZZ")), ["c_custkey"], ["seg"])


@query
def q28_scd2_snapshot(spark, d):
    return customer_history(spark, d)


@query
def q29_scd2_counts(spark, d):
    current = F.col("is_current")
    return customer_history(spark, d).agg(F.count("*").alias("total_rows"), F.count(F.when(current, 1)).alias("current_rows"), F.count(F.when(~current, 1)).alias("historical_rows"))


@query
def q30_scd2_cdc(spark, d):
    feed = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return history.from_changes(feed, ["user_id"], ["event_type"], ["ts", "event_id"], "ts")


@query
def q31_stream_dedup(spark, d):
    """The events land twice; a watermarked stream keeps each once."""
    root = working(spark, "dedup")
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    for _ in range(2):
        e.write.mode("append").parquet(f"{root}/landing")
    found = ingest.deduplicated(spark, f"{root}/landing", "user_id long, ts timestamp", ["user_id", "ts"], "ts", "30 days", f"{root}/table", f"{root}/checkpoint")
    return found.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query
def q32_expect_or_drop(spark, d):
    rules = {"value": F.col("value") > 10, "type": F.col("event_type").isNotNull()}
    return rows.expect(table(spark, d, "events"), rules).select("event_id", "value")


@query
def q33_incremental_two_batches(spark, d):
    """Two halves land one after the other; a restarted ingest takes in each file once."""
    root, e = working(spark, "ingest"), table(spark, d, "events").select("event_id", "event_type")
    run = lambda: ingest.JsonIngest(spark, f"{root}/landing", f"{root}/table", f"{root}/checkpoint", {"event_id": "bigint", "event_type": "string"}).run()
    for half in (0, 1):
        e.where(F.col("event_id") % 2 == half).write.mode("append").json(f"{root}/landing")
        found = run()
    return found.select("event_id", "event_type")


@query
def q34_schema_evolution(spark, d):
    """The second batch has a new column; rows of the first read null."""
    root, e = working(spark, "evolve"), table(spark, d, "events")
    job = ingest.JsonIngest(spark, f"{root}/landing", f"{root}/table", f"{root}/checkpoint", {"event_id": "bigint"}, add_new_columns=True)
    e.where("event_id % 2 = 0").select("event_id").write.mode("append").json(f"{root}/landing")
    job.run()
    e.where("event_id % 2 = 1").select("event_id", F.col("event_type").alias("country")).write.mode("append").json(f"{root}/landing")
    return job.run().select("event_id", "country")


@query
def q35_rescued(spark, d):
    """Values that are no numbers are rescued."""
    root, e = working(spark, "rescue"), table(spark, d, "events")
    text = F.when(F.col("event_id") % 500 == 0, F.lit("not_a_number")).otherwise(F.col("value").cast("string"))
    e.select("event_id", text.alias("value")).write.json(f"{root}/landing")
    found = ingest.JsonIngest(spark, f"{root}/landing", f"{root}/table", f"{root}/checkpoint", {"event_id": "bigint", "value": "double"}).run()
    return found.select("event_id", "value", F.col("_rescued_data").isNotNull().alias("is_rescued"))


@query
def q36_mv_valid_latest(spark, d):
    return rows.expect(latest_orders(spark, d), {"price": F.col("o_totalprice") > 100000}).select("o_custkey", "o_orderkey")
