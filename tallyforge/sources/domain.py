"""The company-graph domain over the star-schema tables, as DataFrames and as SQL.

This is the only module that knows the tables' own column names. Each view exists twice:
as a function of a session and folder, and as a common table expression for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Market segments as sectors; one company in eleven is unclassified.
SECTORS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


#: Columns of the star-schema tables, so that reading them infers nothing from files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, by its declared schema where it has one."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region")
    found = table(spark, sf_dir, "nation").join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows and 5
    return found.select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_name").alias("name"), F.col("r_name").alias("region"), F.col("n_regionkey").cast("long").alias("bloc_id"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, cik, country_id, sector, industry, revenue_total, market_cap, deleted. Revenue is that of closed orders."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    revenue = orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue_total"))
    base = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.expr("CASE WHEN c_custkey % 3 <> 0 THEN lpad(cast(c_custkey * 37 AS string), 10, '0') END").alias("cik"),
        F.col("c_nationkey").cast("long").alias("country_id"),
        F.expr("CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END").alias("sector"),
        F.expr("CASE WHEN c_custkey % 7 <> 0 THEN concat(c_mktsegment, '_', c_custkey % 3) END").alias("industry"),
        F.col("c_acctbal").alias("market_cap"),
        (F.col("c_custkey") % 50 == 49).alias("deleted"),
    )
    return base.join(revenue, F.col("id") == F.col("o_custkey"), "left").drop("o_custkey")


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue relationships, a row for each supplier, buyer and state: id, company_id (seller), related_company_id, value, status, deleted."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", F.expr("cast(l_extendedprice AS decimal(12, 2)) * (1 - cast(l_discount AS decimal(4, 2)))").alias("net"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sums = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", "o_custkey", "l_returnflag").agg(F.round(F.sum("net"), 2).cast("double").alias("value"))
    state = F.expr("CASE l_returnflag WHEN 'A' THEN 'Approved' WHEN 'N' THEN 'Pending' ELSE 'Rejected' END")
    ident = F.concat_ws("-", "l_suppkey", "o_custkey", "l_returnflag")
    return sums.select(ident.alias("id"), F.col("l_suppkey").alias("company_id"), F.col("o_custkey").alias("related_company_id"), "value", state.alias("status"), ((F.col("l_suppkey") + F.col("o_custkey")) % 17 == 0).alias("deleted"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("id"), F.col("event_type").alias("title"), "ts", F.col("user_id").alias("company_id"), F.col("value").alias("impact"), "props", (F.col("event_id") % 13 == 0).alias("deleted"))


SQL = {
    "countries": "SELECT n_nationkey::BIGINT AS id, 'N' || n_nationkey AS code, n_name AS name, r_name AS region, n_regionkey::BIGINT AS bloc_id FROM nation JOIN region ON n_regionkey = r_regionkey",
    "companies": """SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN lpad((c_custkey * 37)::VARCHAR, 10, '0') END AS cik, c_nationkey::BIGINT AS country_id,
    CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS sector, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment || '_' || (c_custkey % 3) END AS industry, c_acctbal AS market_cap,
    c_custkey % 50 = 49 AS deleted, revenue_total
    FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS revenue_total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON c_custkey = o_custkey""",
    "contributions": """SELECT l_suppkey || '-' || o_custkey || '-' || l_returnflag AS id, l_suppkey AS company_id, o_custkey AS related_company_id, round(sum(l_extendedprice::DECIMAL(12, 2) * (1 - l_discount::DECIMAL(4, 2))), 2)::DOUBLE AS value,
    CASE l_returnflag WHEN 'A' THEN 'Approved' WHEN 'N' THEN 'Pending' ELSE 'Rejected' END AS status, (l_suppkey + o_custkey) % 17 = 0 AS deleted
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey, o_custkey, l_returnflag""",
    "evts": "SELECT event_id AS id, event_type AS title, ts, user_id AS company_id, value AS impact, props, event_id % 13 = 0 AS deleted FROM events",
}


def with_views(sql: str, *names: str) -> str:
    """SQL with the named views before it."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + sql
