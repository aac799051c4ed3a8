"""Driver tables and the nominal views built on them.

``ninst``  orders ⋈ customer ⋈ nation  -> 5 nominal attributes, class = order status
``linst``  lineitem, identical tuples collapsed to one weighted row, class = return flag

Both are declared (fixed attribute domains) so no pass over the data is needed to
know the cardinalities, and no fact table is joined to a dictionary on a hot value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.sources.nominal import NominalData

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Fixed values of the two views (domain sizes follow from the view definitions).
NINST_ATTRS = ("a0", "a1", "a2", "a3", "a4")
NINST_CARDS = (5, 5, 5, 12, 5)
NINST_CLASSES = 3
LINST_ATTRS = ("a0", "a1", "a2", "a3", "a4")
LINST_CARDS = (7, 11, 9, 6, 2)
LINST_CLASSES = 3


# Values of the string attributes in sort order (fixed values); the code is the place.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
ORDER_STATUS = ("F", "O", "P")
LINE_STATUS = ("F", "O")
RETURN_FLAGS = ("A", "N", "R")


def coded(column: str, values: tuple[str, ...]) -> Column:
    """Code of a declared domain: a literal map, no join.  NULL stays NULL; a value outside
    the domain fails the job."""
    c = F.col(column)
    code = F.when(c.isNull(), F.lit(None).cast("int"))
    for i, v in enumerate(values):
        code = code.when(c == v, F.lit(i))
    return code.otherwise(F.raise_error(F.concat(F.lit(f"value outside the domain of {column}: "), c)).cast("int"))


def ninst(spark: SparkSession, sf_dir: str) -> NominalData:
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    df = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .select(
            F.col("o_orderkey").alias("rid"),
            (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("a0"),
            coded("c_mktsegment", SEGMENTS).alias("a1"),
            F.col("n_regionkey").cast("int").alias("a2"),
            (F.month("o_orderdate") - 1).cast("int").alias("a3"),
            F.least(F.floor(F.col("o_totalprice") / 100000), F.lit(4)).cast("int").alias("a4"),
            coded("o_orderstatus", ORDER_STATUS).alias("cls"),
        )
    )
    return NominalData(df, NINST_ATTRS, NINST_CARDS, NINST_CLASSES)


def linst(spark: SparkSession, sf_dir: str) -> NominalData:
    """Identical raw tuples are counted first (partial counts in the tasks), then the few
    distinct ones are coded and counted again; one scan, no join."""
    raw = ["l_linenumber", "l_discount", "l_tax", "l_quantity", "l_linestatus", "l_returnflag"]
    few = read_table(spark, sf_dir, "lineitem").groupBy(*raw).agg(F.count(F.lit(1)).alias("n"))
    df = few.select(
        (F.col("l_linenumber") - 1).cast("int").alias("a0"),
        F.round(F.col("l_discount") * 100).cast("int").alias("a1"),
        F.round(F.col("l_tax") * 100).cast("int").alias("a2"),
        F.floor(F.col("l_quantity") / 10).cast("int").alias("a3"),
        coded("l_linestatus", LINE_STATUS).alias("a4"),
        coded("l_returnflag", RETURN_FLAGS).alias("cls"), "n")
    # identical tuples -> one weighted row; the tuple's mixed-radix code is its id
    df = df.groupBy(*LINST_ATTRS, "cls").agg(F.sum("n").cast("double").alias("weight"))
    rid = F.lit(0).cast("long")
    for a, c in zip(LINST_ATTRS, LINST_CARDS):
        rid = rid * c + F.col(a)
    rid = rid * LINST_CLASSES + F.col("cls")
    df = df.select(rid.alias("rid"), *LINST_ATTRS, "cls", "weight")
    return NominalData(df, LINST_ATTRS, LINST_CARDS, LINST_CLASSES, weight="weight")


# ---------------------------------------------------------------------------------
# The same views as DuckDB SQL (used only by the oracle).
NINST_SQL = """
seg AS (SELECT c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS a1
        FROM (SELECT DISTINCT c_mktsegment FROM customer) s),
st AS (SELECT o_orderstatus, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS cls
       FROM (SELECT DISTINCT o_orderstatus FROM orders) s),
ninst AS (
  SELECT o.o_orderkey AS rid,
         CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) - 1 AS a0,
         seg.a1 AS a1,
         CAST(n.n_regionkey AS INTEGER) AS a2,
         CAST(month(o.o_orderdate) AS INTEGER) - 1 AS a3,
         CAST(least(floor(o.o_totalprice / 100000), 4) AS INTEGER) AS a4,
         st.cls AS cls,
         1.0::DOUBLE AS weight
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN seg ON c.c_mktsegment = seg.c_mktsegment
  JOIN st ON o.o_orderstatus = st.o_orderstatus)"""

LINST_SQL = """
lstat AS (SELECT l_linestatus, CAST(dense_rank() OVER (ORDER BY l_linestatus) - 1 AS INTEGER) AS a4
          FROM (SELECT DISTINCT l_linestatus FROM lineitem) s),
rflag AS (SELECT l_returnflag, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS cls
          FROM (SELECT DISTINCT l_returnflag FROM lineitem) s),
lcoded AS (
  SELECT CAST(l_linenumber - 1 AS INTEGER) AS a0,
         CAST(round(l_discount * 100) AS INTEGER) AS a1,
         CAST(round(l_tax * 100) AS INTEGER) AS a2,
         CAST(floor(l_quantity / 10) AS INTEGER) AS a3,
         lstat.a4 AS a4, rflag.cls AS cls
  FROM lineitem JOIN lstat USING (l_linestatus) JOIN rflag USING (l_returnflag)),
linst AS (
  SELECT CAST((((((a0 * 11 + a1) * 9 + a2) * 6 + a3) * 2 + a4) * 3 + cls) AS BIGINT) AS rid,
         a0, a1, a2, a3, a4, cls, CAST(count(*) AS DOUBLE) AS weight
  FROM lcoded GROUP BY a0, a1, a2, a3, a4, cls)"""

# The first three attributes of ``ninst`` alone (a second dataset of the evaluation job).
NINST3_SQL = NINST_SQL + """,
ninst3 AS (SELECT rid, a0, a1, a2, cls, weight FROM ninst)"""

VIEW_SQL = {"ninst": NINST_SQL, "linst": LINST_SQL, "ninst3": NINST3_SQL}
VIEW_META = {
    "ninst": (NINST_ATTRS, NINST_CARDS, NINST_CLASSES),
    "linst": (LINST_ATTRS, LINST_CARDS, LINST_CLASSES),
    "ninst3": (NINST_ATTRS[:3], NINST_CARDS[:3], NINST_CLASSES),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> NominalData:
    return {"ninst": ninst, "linst": linst}[name](spark, sf_dir)
