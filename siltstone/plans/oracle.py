"""The SQL that each query of plans.queries must agree with, for DuckDB."""

SQL = {
    "q01_project": 'SELECT p_name,p_size,p_type,p_brand,p_retailprice FROM part',
    "q02_filter_gt": 'SELECT l_orderkey,l_partkey,l_quantity FROM lineitem WHERE l_quantity > 40',
    "q03_top_brands": 'SELECT p_brand, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) total_sales FROM part GROUP BY p_brand ORDER BY total_sales DESC, p_brand LIMIT 10',
    "q04_sales_by_type": 'SELECT p_type, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) total_sales FROM part GROUP BY p_type',
    "q05_sales_by_size": 'SELECT p_size, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) total_sales FROM part GROUP BY p_size',
    "q06_count_distinct_dups": 'SELECT count(*) total_rows, count(DISTINCT o_custkey) distinct_customers, count(*)-count(DISTINCT o_custkey) duplicate_rows FROM orders',
    "q07_count_distinct_multi": 'SELECT count(*) total_rows, count(DISTINCT (l_orderkey,l_partkey)) distinct_lines, count(*)-count(DISTINCT (l_orderkey,l_partkey)) duplicate_rows FROM lineitem',
    "q08_conditional_sums": "SELECT count(*) total_rows, CAST(sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS BIGINT) returned, CAST(sum(CASE WHEN l_shipdate IS NULL THEN 1 ELSE 0 END) AS BIGINT) null_shipdate FROM lineitem",
    "q09_dedup_lines": 'SELECT l_orderkey,l_partkey,l_linenumber,l_extendedprice FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey,l_partkey ORDER BY l_extendedprice DESC NULLS LAST, l_linenumber, l_suppkey, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) rn FROM lineitem) WHERE rn=1)',
    "q10_latest_order": 'SELECT o_custkey,o_orderkey,o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST,o_orderkey DESC) rn FROM orders) WHERE rn=1',
    "q11_inner_join": 'SELECT o_orderkey,c_custkey,c_mktsegment FROM orders JOIN customer ON o_custkey=c_custkey',
    "q12_left_anti": "SELECT c_custkey,c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='P' AND o_totalprice>300000)",
    "q13_in_subquery": "SELECT o_custkey,o_orderkey,o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment='BUILDING')",
    "q14_union_by_name": "SELECT c_custkey, CASE WHEN c_custkey<25 THEN 'ZZ' ELSE c_mktsegment END c_mktsegment FROM customer",
    "q15_distinct": 'SELECT DISTINCT o_orderstatus,o_orderpriority FROM orders',
    "q16_typed_customers": "SELECT TRY_CAST(raw_id AS INTEGER) customer_id, c_name FROM (SELECT CASE WHEN c_custkey % 97 = 0 THEN 'bad-' || CAST(c_custkey AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END raw_id, c_name FROM customer)",
    "q17_quarantine": "SELECT raw_id, 'customer_id did not cast to INT' rejection_reason FROM (SELECT CASE WHEN c_custkey % 97 = 0 THEN 'bad-' || CAST(c_custkey AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END raw_id FROM customer) WHERE TRY_CAST(raw_id AS INTEGER) IS NULL",
    "q18_clean_half": "SELECT TRY_CAST(raw_id AS INTEGER) customer_id, c_name FROM (SELECT CASE WHEN c_custkey % 97 = 0 THEN 'bad-' || CAST(c_custkey AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END raw_id, c_name FROM customer) WHERE TRY_CAST(raw_id AS INTEGER) IS NOT NULL",
    "q19_reasoned_quarantine": "SELECT l_orderkey,l_linenumber, CASE WHEN l_orderkey%101=0 THEN 'order_number did not cast to BIGINT' ELSE 'product_id missing' END rejection_reason FROM lineitem WHERE l_orderkey%101=0 OR l_partkey%103=0",
    "q20_text_standardise": "SELECT c_custkey, upper(trim('  ' || lower(c_mktsegment) || ' ')) seg FROM customer",
    "q21_epoch_to_ts": 'SELECT o_orderkey, make_timestamp(CAST(epoch(o_orderdate) AS BIGINT)*1000000) order_ts FROM orders',
    "q22_modulo_arith": 'SELECT c_custkey, (c_custkey+1)%4 loyalty FROM customer',
    "q23_nest_explode": 'SELECT l_orderkey,l_partkey,l_quantity FROM lineitem',
    "q24_line_revenue": 'SELECT l_orderkey,l_linenumber, round(l_extendedprice*l_quantity,2) line_revenue FROM lineitem',
    "q25_from_json": "SELECT event_id, CAST(json_extract_string(props,'$.k') AS INTEGER) k FROM events",
    "q26_revenue_top10": 'SELECT p_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) total_revenue, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) total_units FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey,l_partkey ORDER BY l_extendedprice DESC NULLS LAST, l_linenumber, l_suppkey, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) rn FROM lineitem) WHERE rn=1) JOIN part ON p_partkey=l_partkey GROUP BY p_name ORDER BY total_revenue DESC,p_name LIMIT 10',
    "q27_scd1_upsert": "SELECT c_custkey, CASE WHEN c_custkey%10=0 THEN 'UPDATED' ELSE c_mktsegment END seg FROM customer UNION ALL SELECT c_custkey+1000000, 'NEW' FROM customer WHERE c_custkey%50=0",
    "q28_scd2_snapshot": "SELECT c_custkey, c_mktsegment seg, 1 version, c_custkey>=25 is_current FROM customer UNION ALL SELECT c_custkey,'ZZ',2,true FROM customer WHERE c_custkey<25",
    "q29_scd2_counts": 'SELECT count(*)+25 total_rows, count(*) current_rows, CAST(25 AS BIGINT) historical_rows FROM customer',
    "q30_scd2_cdc": 'WITH x AS (SELECT *, lag(event_type) OVER w p, row_number() OVER w rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts,event_id)), y AS (SELECT * FROM x WHERE rn=1 OR event_type IS DISTINCT FROM p) SELECT user_id,event_type,ts start_at,lead(ts) OVER (PARTITION BY user_id ORDER BY ts,event_id) end_at FROM y',
    "q31_stream_dedup": 'SELECT DISTINCT user_id, ts FROM events',
    "q32_expect_or_drop": 'SELECT event_id,value FROM events WHERE value > 10 AND event_type IS NOT NULL',
    "q33_incremental_two_batches": 'SELECT event_id,event_type FROM events',
    "q34_schema_evolution": 'SELECT event_id, CASE WHEN event_id%2=1 THEN event_type END country FROM events',
    "q35_rescued": 'SELECT event_id, CASE WHEN event_id%500=0 THEN NULL ELSE value END value, event_id%500=0 is_rescued FROM events',
    "q36_mv_valid_latest": 'SELECT o_custkey,o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST,o_orderkey DESC) rn FROM orders) WHERE rn=1 AND o_totalprice>100000',
}
