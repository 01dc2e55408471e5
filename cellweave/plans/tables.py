"""The driver tables in their roles: sparse matrix, cells, genes, edges, documents, messages.

Every role covers its whole source tables.  The SQL fragments state the same
roles for the oracle side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import neighbors


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def counts(spark: SparkSession, sf: str) -> DataFrame:
    """expr(cell_id, gene_id, value): quantity bought by a customer of a part."""
    lines = load(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("gene_id"), "l_quantity")
    orders = load(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("cell_id"))
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .groupBy("cell_id", "gene_id")
        .agg(F.sum("l_quantity").alias("value"))
    )


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """obs: customers on a 40-wide grid, jittered by their balance."""
    nation = load(spark, sf, "nation")
    customer = load(spark, sf, "customer")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").alias("cell_id"),
        F.col("c_mktsegment").alias("cell_type"),
        F.col("n_name").alias("sample_id"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("batch"),
        (F.col("c_custkey") % 40 + F.col("c_acctbal") * 0.00003).alias("x"),
        (F.floor(F.col("c_custkey") / 40) + F.col("c_acctbal") * 0.00005).alias("y"),
        F.col("c_acctbal").alias("pseudotime"),
    )


def genes(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select(
        F.col("p_partkey").alias("gene_id"),
        F.col("p_name").alias("symbol"),
        F.col("p_brand").alias("chromosome"),
        F.col("p_partkey").alias("start"),
        F.col("p_type").alias("gene_set"),
        (F.col("p_type") == "PROMO").alias("is_mt"),
    )


def lognorm(spark: SparkSession, sf: str) -> DataFrame:
    from cellweave.operators import normalize

    return normalize.log1p(normalize.normalize_total(counts(spark, sf)))


def spatial_edges(spark: SparkSession, sf: str, k: int = 6) -> DataFrame:
    return neighbors.knn_spatial(cells(spark, sf), k=k)


SQL_COUNTS = """counts AS (
  SELECT o_custkey AS cell_id, l_partkey AS gene_id, SUM(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""

SQL_CELLS = """cells AS (
  SELECT c_custkey AS cell_id, c_mktsegment AS cell_type, n_name AS sample_id, 'R' || n_regionkey AS batch,
         c_custkey % 40 + c_acctbal * CAST(0.00003 AS DOUBLE) AS x,
         floor(c_custkey / 40) + c_acctbal * CAST(0.00005 AS DOUBLE) AS y, c_acctbal AS pseudotime
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

SQL_GENES = """genes AS (
  SELECT p_partkey AS gene_id, p_name AS symbol, p_brand AS chromosome, p_partkey AS start,
         p_type AS gene_set, p_type = 'PROMO' AS is_mt FROM part)"""

SQL_LOGNORM = SQL_COUNTS + """, lognorm AS (
  SELECT cell_id, gene_id, ln(1 + value * CAST(10000 AS DOUBLE) / SUM(value) OVER (PARTITION BY cell_id)) AS value FROM counts)"""


def sql_edges(k: int = 6, name: str = "edges") -> str:
    """Brute-force nearest neighbours, for the oracle side only."""
    return f"""{name} AS (
  SELECT src, dst, sqrt(d2) AS dist, rn AS rank FROM (
    SELECT a.cell_id AS src, b.cell_id AS dst, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2,
           row_number() OVER (PARTITION BY a.cell_id
             ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.cell_id) AS rn
    FROM cells a JOIN cells b ON a.cell_id <> b.cell_id) WHERE rn <= {k})"""


def norm_sf_sql(z: str) -> str:
    """Upper normal tail for z >= 0, the same polynomial as the Spark side."""
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.2316419::DOUBLE * ({z})))"
    return (f"(exp(-({z}) * ({z}) / 2.0::DOUBLE) / sqrt(2.0::DOUBLE * pi()) * {t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * "
            f"(1.781477937::DOUBLE + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE)))))")


def norm_p_sql(z: str) -> str:
    return f"least(1.0::DOUBLE, 2.0::DOUBLE * {norm_sf_sql(f'abs({z})')})"


def r6_sql(e: str, digits: int = 6) -> str:
    return f"round({e}, {digits}) + 0.0::DOUBLE"
