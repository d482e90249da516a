"""Transaction frames: schema, readers, and adapters over the driver's tables.

A transaction frame has TransactionID, TransactionDT (whole seconds), TransactionAmt, isFraud, client_id
and link attributes.  The row order everywhere is (TransactionDT, TransactionID).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME, ID, LABEL, AMOUNT = "TransactionDT", "TransactionID", "isFraud", "TransactionAmt"

#: Raw transactions as CSV; declared, so nothing is sampled to infer types.
TRANSACTIONS = T.StructType([
    T.StructField(ID, T.LongType()), T.StructField(LABEL, T.IntegerType()), T.StructField(TIME, T.LongType()),
    T.StructField(AMOUNT, T.DoubleType()), T.StructField("card1", T.LongType()),
    *[T.StructField(c, T.DoubleType()) for c in ("card2", "card3", "card5", "addr1", "addr2")],
    T.StructField("P_emaildomain", T.StringType()), T.StructField("R_emaildomain", T.StringType()),
    T.StructField("D1", T.DoubleType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with a declared schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


# The text columns of the public card data; all others but the whole numbers are doubles.
TEXT_COLUMNS = frozenset(
    "ProductCD card4 card6 P_emaildomain R_emaildomain DeviceType DeviceInfo M1 M2 M3 M4 M5 M6 M7 M8 M9 id_12 id_15 id_16 id_23 id_27 id_28 "
    "id_29 id_30 id_31 id_33 id_34 id_35 id_36 id_37 id_38".split()
)
WHOLE_COLUMNS = {ID: T.LongType(), TIME: T.LongType(), "card1": T.LongType(), LABEL: T.IntegerType()}


def declared(spark: SparkSession, path: str) -> T.StructType:
    """The schema of a raw CSV from its header line and the rule above; no value is looked at."""
    def kind(name: str) -> T.DataType:
        name = name.replace("-", "_")
        return T.StringType() if name in TEXT_COLUMNS else WHOLE_COLUMNS.get(name, T.DoubleType())

    return T.StructType([T.StructField(c, kind(c)) for c in spark.read.option("header", True).csv(path).columns])


def present(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def load_raw(spark: SparkSession, transactions: str, identity: str, schema: T.StructType | None = None, identity_schema: T.StructType | None = None) -> DataFrame:
    """Transactions with their identity rows, if any; dashes in identity column names become underscores.

    Schemas that are not given are declared by the files' headers.  A file that is not there is named.
    """
    if absent := [p for p in (transactions, identity) if not present(spark, p)]:
        raise FileNotFoundError(f"not there: {', '.join(absent)}")
    side = read_csv(spark, identity, identity_schema or declared(spark, identity))
    side = side.toDF(*[c.replace("-", "_") for c in side.columns])
    return read_csv(spark, transactions, schema or declared(spark, transactions)).join(side, ID, "left")


def tx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transactions: the user is the client, the JSON number and its day are link attributes."""
    k = F.regexp_extract("props", r"(-?\d+)", 1)
    t = F.unix_timestamp("ts")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias(ID), t.alias(TIME), F.col("value").alias(AMOUNT), (F.col("event_type") == "error").cast("int").alias(LABEL),
        F.col("user_id").cast("string").alias("client_id"), F.col("event_type").alias("P_emaildomain"), k.cast("int").alias("addr1"),
        F.concat_ws("|", k, F.floor(t / 86400).cast("string")).alias("k_day"), k.alias("ring_id"),
    )


#: The same frame for DuckDB.
EVENTS_SQL = r"""tx AS (SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS t, value AS amt, CAST(event_type = 'error' AS INT) AS y,
  CAST(user_id AS VARCHAR) AS client, event_type, CAST(regexp_extract(props, '(-?\d+)', 1) AS INT) AS addr1,
  regexp_extract(props, '(-?\d+)', 1) || '|' || CAST(CAST(floor(epoch(ts) / 86400) AS BIGINT) AS VARCHAR) AS k_day,
  regexp_extract(props, '(-?\d+)', 1) AS ring FROM events)"""


def tx_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions: first line's part and the customer's nation as link attributes; dates tie often."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey")).alias("l"))
    rows = o.join(line, o["o_orderkey"] == line["l_orderkey"], "left").join(c, o["o_custkey"] == c["c_custkey"], "left")
    return rows.select(
        F.col("o_orderkey").alias(ID), F.unix_timestamp(F.date_trunc("day", "o_orderdate")).alias(TIME), F.col("o_totalprice").alias(AMOUNT),
        (F.col("o_orderstatus") == "F").cast("int").alias(LABEL), F.col("o_custkey").alias("card1"), F.col("c_nationkey").alias("addr1"),
        F.col("o_orderpriority").alias("P_emaildomain"), F.col("l.l_partkey").cast("string").alias("part"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 50).alias("D1"),
    )


ORDERS_SQL = """ln AS (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS part FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS id, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS t, o_totalprice AS amt,
  CAST(o_orderstatus = 'F' AS INT) AS y, o_custkey AS card1, c_nationkey AS addr1, o_orderpriority AS prio, CAST(part AS VARCHAR) AS part,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 50 END AS d1
  FROM orders LEFT JOIN ln ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey)"""
