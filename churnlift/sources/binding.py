"""Binding of the driver's TPC-H-shaped test tables to the canonical retail
tables the pipeline expects (FIXTURES.md §2).

The raw test tables hold no NULLs and no orphan keys, while the reference's
data has both (it reports and drops them).  The binding therefore changes
keys on the fact side: lines of some suppliers point at stores that do not
exist or have no store, lines of some parts at unknown products, some orders
have no customer, some states are NULL and some operation times are no times.
Every row of every table is read.

``*_SQL`` strings are the same binding as SQL text for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .contract import CONTRACTS, conforming
from .io import read_table

# Dates shift by whole years so that the reports' literal year bounds select rows.
ORDER_YEAR_SHIFT = 27
EXTRA_DISCOUNT_PRIORITY = "1-URGENT"
OPERATION_YEAR_SHIFT = 1


# Declared schemas of the test tables: name and type are checked at each scan.
RAW_SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"}


def raw_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table under its declared schema."""
    return read_table(spark, sf_dir, name, schema=T.StructType.fromDDL(RAW_SCHEMAS[name]))


# Order priorities stand in for raw payment-method text: four of them name a
# method the payment recoding knows, '4-NOT SPECIFIED' names one it does not.
PRIORITY_TO_PAYMENT = {
    "1-URGENT": "CREDIT_CARD_ONLINE",
    "2-HIGH": "CARD ON DELIVERY",
    "3-MEDIUM": "CASH",
    "4-NOT SPECIFIED": "BANK TRANSFER",
    "5-LOW": "QR CODE",
}


def raw_payment(priority):
    expr = None
    for k, v in PRIORITY_TO_PAYMENT.items():
        expr = F.when(priority == k, v) if expr is None else expr.when(priority == k, v)
    return expr


def _raw_payment_sql(col: str) -> str:
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in PRIORITY_TO_PAYMENT.items())
    return f"case {col} {whens} end"


# Fact rows whose key is changed: key modulo n is 0.
NO_STORE, ORPHAN_STORE, ORPHAN_PRODUCT, NO_CUSTOMER, BAD_TIME = 20, 10, 20, 41, 53


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FACT_ORDER_TABLE: one row per order line."""
    li = raw_table(spark, sf_dir, "lineitem")
    o = raw_table(spark, sf_dir, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    offered = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    # extra (tax-sized) price cut between offered and charged price on urgent
    # orders only, so that "used an extra discount" separates customers
    charged = F.when(F.col("o_orderpriority") == EXTRA_DISCOUNT_PRIORITY,
                     offered * (1 - F.col("l_tax"))).otherwise(offered)
    order_date = F.col("o_orderdate") + F.make_interval(F.lit(ORDER_YEAR_SHIFT))
    state = (F.when(F.col("o_orderstatus") == "F", "Valid")
              .when(F.col("o_orderstatus") == "O", "Invalid")
              .when(F.col("o_orderstatus") == "P",
                    F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).otherwise("Fraud")))
    return j.select(
        F.col("l_orderkey").alias("ORDER_ID"),
        F.when(F.col("o_orderkey") % NO_CUSTOMER != 0, F.col("o_custkey")).alias("CUSTOMER_ID"),
        F.when(F.col("l_partkey") % ORPHAN_PRODUCT == 0, -F.col("l_partkey")).otherwise(F.col("l_partkey")).alias("SKU_ID"),
        F.when(F.col("l_suppkey") % NO_STORE == 0, F.lit(None))
         .when(F.col("l_suppkey") % ORPHAN_STORE == 0, -F.col("l_suppkey")).otherwise(F.col("l_suppkey")).alias("STORE_ID"),
        F.col("l_linenumber").alias("LINE_NO"),
        (F.col("o_orderkey") % 97).alias("DEVICE_ID"),
        order_date.alias("ORDER_TIMESTAMP"),
        order_date.alias("ORDER_DATE"),
        F.col("l_quantity").alias("UNIT_QUANTITY"),
        F.col("l_extendedprice").alias("UNIT_LIST_PRICE"),
        offered.alias("UNIT_OFFERED_PRICE"),
        charged.alias("UNIT_CHARGED_PRICE"),
        (charged * F.col("l_quantity")).alias("UNIT_NET"),
        raw_payment(F.col("o_orderpriority")).alias("PAYMENT_METHOD"),
        state.cast("string").alias("ORDER_STATE_FINAL"),
    )


def store_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = raw_table(spark, sf_dir, "supplier")
    n = raw_table(spark, sf_dir, "nation")
    return (s.join(n, s.s_nationkey == n.n_nationkey)
             .select(F.col("s_suppkey").alias("STORE_ID"), F.col("s_name").alias("STORE_NAME"),
                     F.col("n_name").alias("PREFIX")))


def product_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raw_table(spark, sf_dir, "part")
    bundle = (F.when(F.col("p_size") % 10 == 0, F.lit(1))
               .when(F.col("p_size") % 10 == 1, F.lit(None)).otherwise(F.lit(0)))
    return p.select(F.col("p_partkey").alias("SKU_ID"), F.col("p_name").alias("SKU_NAME"),
                    F.nullif(F.col("p_type"), F.lit("ECONOMY")).alias("SKU_CATEGORY"),
                    F.col("p_brand").alias("SKU_SUBCATEGORY"), bundle.cast("int").alias("SKU_IS_BUNDLE"))


def user_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = raw_table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("CUSTOMER_ID"), F.col("c_mktsegment").alias("SEGMENT"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FACT_OPERATION_TABLE: one row per order (no CUSTOMER_ID)."""
    e = raw_table(spark, sf_dir, "events")
    ts = F.col("ts") + F.make_interval(F.lit(OPERATION_YEAR_SHIFT))
    return e.select(
        F.col("event_id").alias("ORDER_ID"),
        F.date_trunc("DAY", ts).cast("timestamp_ntz").alias("ORDER_DATE"),
        F.when(F.col("event_id") % BAD_TIME == 0, F.lit("n/a")).otherwise(F.date_format(ts, "HH:mm:ss")).alias("ORDER_TIME"),
        F.when(F.col("event_type") == "signup", "Invalid").otherwise("Valid").alias("ORDER_STATE_FINAL"),
        F.col("value").alias("DELIVERY_TIME"),
        F.when(F.col("event_type") == "error", F.lit(None))
         .otherwise((F.col("value") <= 50).cast("int")).alias("WITHIN_SLA"),
        F.get_json_object("props", "$.k").cast("double").alias("APPROVAL_TIME"),
        (F.col("value") * 2).alias("TOTAL_DISTANCE"),
    )


def operations_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations as another tool exports them, every column text; some
    dates, times and measurements are no such thing and some states are NULL."""
    ops = operations(spark, sf_dir)
    n = F.col("ORDER_ID")
    return ops.select(
        F.when(n % 97 == 0, F.concat(F.lit("#"), n.cast("string"))).otherwise(n.cast("string")).alias("ORDER_ID"),
        F.when(n % 31 == 0, F.date_format("ORDER_DATE", "dd/MM/yyyy")).otherwise(F.date_format("ORDER_DATE", "yyyy-MM-dd HH:mm:ss")).alias("ORDER_DATE"),
        "ORDER_TIME", F.when(n % 29 != 0, F.col("ORDER_STATE_FINAL")).alias("ORDER_STATE_FINAL"),
        F.when(n % 37 == 0, "fast").otherwise(F.col("DELIVERY_TIME").cast("string")).alias("DELIVERY_TIME"),
        F.col("WITHIN_SLA").cast("string").alias("WITHIN_SLA"), F.col("APPROVAL_TIME").cast("string").alias("APPROVAL_TIME"),
        F.col("TOTAL_DISTANCE").cast("string").alias("TOTAL_DISTANCE"))


def canonical_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five tables under their contracts."""
    tables = {
        "order_details": order_lines(spark, sf_dir),
        "store_master": store_master(spark, sf_dir),
        "product_master": product_master(spark, sf_dir),
        "user_master": user_master(spark, sf_dir),
        "operation_details": operations(spark, sf_dir),
    }
    return {name: conforming(df, CONTRACTS[name]) for name, df in tables.items()}


# ---- the same binding as SQL text (DuckDB oracle) ---------------------------
ORDER_LINES_SQL = f"""
select l_orderkey ORDER_ID, case when o_orderkey % {NO_CUSTOMER} <> 0 then o_custkey end CUSTOMER_ID,
  case when l_partkey % {ORPHAN_PRODUCT} = 0 then -l_partkey else l_partkey end SKU_ID,
  case when l_suppkey % {NO_STORE} = 0 then null when l_suppkey % {ORPHAN_STORE} = 0 then -l_suppkey
    else l_suppkey end STORE_ID,
  l_linenumber LINE_NO, o_orderkey % 97 DEVICE_ID,
  o_orderdate + interval '{ORDER_YEAR_SHIFT}' year ORDER_TIMESTAMP,
  o_orderdate + interval '{ORDER_YEAR_SHIFT}' year ORDER_DATE,
  l_quantity UNIT_QUANTITY, l_extendedprice UNIT_LIST_PRICE,
  l_extendedprice*(1-l_discount) UNIT_OFFERED_PRICE,
  case when o_orderpriority = '{EXTRA_DISCOUNT_PRIORITY}' then l_extendedprice*(1-l_discount)*(1-l_tax)
    else l_extendedprice*(1-l_discount) end UNIT_CHARGED_PRICE,
  case when o_orderpriority = '{EXTRA_DISCOUNT_PRIORITY}' then l_extendedprice*(1-l_discount)*(1-l_tax)
    else l_extendedprice*(1-l_discount) end * l_quantity UNIT_NET,
  {_raw_payment_sql('o_orderpriority')} PAYMENT_METHOD,
  case o_orderstatus when 'F' then 'Valid' when 'O' then 'Invalid'
    when 'P' then case when o_orderkey % 5 = 0 then null else 'Fraud' end end ORDER_STATE_FINAL
from lineitem join orders on l_orderkey = o_orderkey"""

STORE_MASTER_SQL = """
select s_suppkey STORE_ID, s_name STORE_NAME, n_name PREFIX
from supplier join nation on s_nationkey = n_nationkey"""

PRODUCT_MASTER_SQL = """
select p_partkey SKU_ID, p_name SKU_NAME, nullif(p_type, 'ECONOMY') SKU_CATEGORY,
  p_brand SKU_SUBCATEGORY,
  cast(case p_size % 10 when 0 then 1 when 1 then null else 0 end as integer) SKU_IS_BUNDLE
from part"""

USER_MASTER_SQL = """
select c_custkey CUSTOMER_ID, c_mktsegment SEGMENT from customer"""

OPERATIONS_SQL = f"""
select event_id ORDER_ID,
  date_trunc('day', ts + interval '{OPERATION_YEAR_SHIFT}' year) ORDER_DATE,
  case when event_id % {BAD_TIME} = 0 then 'n/a'
    else strftime(ts + interval '{OPERATION_YEAR_SHIFT}' year, '%H:%M:%S') end ORDER_TIME,
  case event_type when 'signup' then 'Invalid' else 'Valid' end ORDER_STATE_FINAL,
  value DELIVERY_TIME,
  case when event_type = 'error' then null else cast(value <= 50 as integer) end WITHIN_SLA,
  cast(json_extract_string(props, '$.k') as double) APPROVAL_TIME,
  value * 2 TOTAL_DISTANCE
from events"""

BINDING_CTES = {
    "order_details": ORDER_LINES_SQL,
    "store_master": STORE_MASTER_SQL,
    "product_master": PRODUCT_MASTER_SQL,
    "user_master": USER_MASTER_SQL,
    "operation_details": OPERATIONS_SQL,
}


def with_ctes(body: str, ctes: dict[str, str]) -> str:
    """Prefix ``body`` with named CTEs (oracle SQL assembly)."""
    parts = [f"{name} as ({sql.strip()})" for name, sql in ctes.items()]
    return "with " + ",\n".join(parts) + "\n" + body.strip()
