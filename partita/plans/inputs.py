"""The given tables as categorical data, with partitions of their units, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partita.operators.encode import Dataset, encode
from partita.sources.scratch import written
from partita.sources.tables import from_strings, from_table

LETTERS = "abcdefghijklmnopqrstuvwxyzàâäæçèéêëîïôöœùûüßáíóúñ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which letters a document has: a site for each of ``LETTERS``, value 1 or 0."""
    flags = F.array(*[F.when(F.col("lowered").contains(c), "1").otherwise("0") for c in LETTERS])
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), F.lower(F.coalesce("text", F.lit(""))).alias("lowered"))
    long = rows.select("unit_id", F.posexplode(flags).alias("at", "value"))
    return long.select("unit_id", (F.col("at") + 1).alias("pos"), "value")


def aligned_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of orders as an alignment: key, status, first letter of the priority and date, 18 characters each."""
    code = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), "o_orderstatus", F.substring("o_orderpriority", 1, 1), F.date_format("o_orderdate", "yyyyMMdd"))
    return from_strings(table(spark, sf_dir, "orders").select("o_orderkey", code.alias("code")), "o_orderkey", "code")


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    return from_table(orders, "o_orderkey", ["o_orderstatus", "o_orderpriority", "y", "m"])


def part_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_brand", "p_type", "p_size"])


def customer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("band", F.floor(F.col("c_acctbal") / 1000))
    return from_table(rows, "c_custkey", ["c_mktsegment", "c_nationkey", "band"])


def embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of an embedding's entries."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), F.posexplode("embedding").alias("at", "x"))
    return rows.select("unit_id", (F.col("at") + 1).alias("pos"), F.when(F.col("x") > 0, "1").otherwise("0").alias("value"))


CELLS = {"documents": document_cells, "aligned": aligned_cells, "orders": order_cells, "part": part_cells, "customer": customer_cells, "embeddings": embedding_cells}
#: Table, id and column (SQL) that partitions its units.
GROUPS = {
    "documents": ("documents", "doc_id", "lang"), "aligned": ("orders", "o_orderkey", "o_orderpriority"), "orders": ("orders", "o_orderkey", "o_orderpriority"),
    "part": ("part", "p_partkey", "p_type"), "customer": ("customer", "c_custkey", "c_nationkey % 5"), "embeddings": ("embeddings", "vec_id", "label"),
}


def dataset(spark: SparkSession, sf_dir: str, name: str) -> Dataset:
    source, key, _ = GROUPS[name]
    units = table(spark, sf_dir, source).select(F.col(key).alias("unit_id"), F.col(key).cast("string").alias("uid"))
    cells = CELLS[name](spark, sf_dir)
    return encode(written(cells) if name == "documents" else cells, units)  # looking for letters twice takes longer


def partition(spark: SparkSession, sf_dir: str, name: str, by: str | None = None) -> DataFrame:
    """unit_id and cluster: the values of a column, numbered in order."""
    source, key, column = GROUPS[name]
    rows = table(spark, sf_dir, source).select(F.col(key).alias("unit_id"), F.expr(by or column).alias("label"))
    ranked = rows.select("label").distinct().select("label", F.dense_rank().over(Window.orderBy("label")).alias("cluster"))
    return rows.join(ranked, "label").select("unit_id", "cluster")


def _columns_sql(source: str, key: str, columns: list[str]) -> str:
    parts = [f"SELECT {key} AS unit_id, {k} AS pos, nullif(lower(trim(({c})::VARCHAR)), '') AS value FROM {source}" for k, c in enumerate(columns, 1)]
    return " UNION ALL ".join(parts)


CELLS_SQL = {
    "documents": f"SELECT doc_id AS unit_id, pos, CASE WHEN contains(lower(coalesce(text, '')), substr('{LETTERS}', pos, 1)) THEN '1' ELSE '0' END AS value FROM documents, (SELECT unnest(range(1, {len(LETTERS) + 1}))::INTEGER AS pos)",
    "aligned": """SELECT unit_id, pos, nullif(lower(trim(substr(code, pos, 1))), '') AS value FROM (SELECT o_orderkey AS unit_id,
      lpad(o_orderkey::VARCHAR, 8, '0') || o_orderstatus || substr(o_orderpriority, 1, 1) || strftime(o_orderdate, '%Y%m%d') AS code FROM orders), (SELECT unnest(range(1, 19))::INTEGER AS pos)""",
    "orders": _columns_sql("orders", "o_orderkey", ["o_orderstatus", "o_orderpriority", "year(o_orderdate)", "month(o_orderdate)"]),
    "part": _columns_sql("part", "p_partkey", ["p_name", "p_brand", "p_type", "p_size"]),
    "customer": _columns_sql("customer", "c_custkey", ["c_mktsegment", "c_nationkey", "floor(c_acctbal / 1000)::BIGINT"]),
    "embeddings": "SELECT vec_id AS unit_id, pos, CASE WHEN embedding[pos] > 0 THEN '1' ELSE '0' END AS value FROM embeddings, (SELECT unnest(range(1, 65))::INTEGER AS pos)",
}


def encode_sql(name: str) -> str:
    """CTEs cells, counts, sites, alphabet, attributes, ones, units, partition."""
    source, key, column = GROUPS[name]
    return f"""WITH cells AS ({CELLS_SQL[name]}),
counts AS (SELECT pos, value, count(*) AS n FROM cells GROUP BY pos, value),
sites AS (SELECT pos, count(value) AS n_values, coalesce(sum(n) FILTER (value IS NOT NULL), 0)::BIGINT AS n_present, count(value) > 1 AS is_poly FROM counts GROUP BY pos),
alphabet AS (SELECT value, row_number() OVER (ORDER BY CASE WHEN numeric THEN try_cast(value AS DOUBLE) END, value)::INTEGER AS code
  FROM (SELECT DISTINCT value FROM counts WHERE value IS NOT NULL), (SELECT bool_and(try_cast(value AS DOUBLE) IS NOT NULL) AS numeric FROM counts WHERE value IS NOT NULL)),
attributes AS (SELECT row_number() OVER (ORDER BY pos, code)::INTEGER AS attr_id, dense_rank() OVER (ORDER BY pos)::INTEGER AS site_key, pos, value, code
  FROM counts JOIN sites USING (pos) JOIN alphabet USING (value) WHERE is_poly),
ones AS (SELECT unit_id, attr_id FROM cells JOIN attributes USING (pos, value)),
units AS (SELECT {key} AS unit_id FROM {source}),
partition AS (SELECT {key} AS unit_id, dense_rank() OVER (ORDER BY {column})::INTEGER AS cluster FROM {source} WHERE ({column}) IS NOT NULL)"""


def lgamma_mix(a: str, b: str) -> str:
    return f"lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + lgamma({a} + n1) + lgamma({b} + n - n1) - lgamma({a} + {b} + n)"


R = "(ln(0.001) / ln(0.95))"


def model_sql(name: str) -> str:
    """CTEs of ``encode_sql`` and totals, hyper, sizes, cluster_counts, scores, classes, states."""
    g = [f"ln({x}::DOUBLE)" for x in (0.6, 0.35, 0.05, 0.05)]
    third = "CASE WHEN k = 1 THEN '-inf'::DOUBLE ELSE ln((k - 1)::DOUBLE) - ln(k::DOUBLE) END"
    op = ("0", "0", third, "-ln(k::DOUBLE)")
    scores = ", ".join(f"{lgamma_mix(f'a{s}', f'b{s}')} + {g[s - 1]} / k + {op[s - 1]} AS l{s}" for s in range(1, 5))
    return f"""{encode_sql(name)},
totals AS (SELECT attr_id, count(o.unit_id) AS total FROM attributes LEFT JOIN ones o USING (attr_id) GROUP BY attr_id),
amount AS (SELECT count(*) AS u FROM units),
first_pair AS (SELECT attr_id, total, u, CASE WHEN u > {R} THEN ({R} + 1) * (total + 0.5::DOUBLE) / (u + 1) ELSE total + 0.5::DOUBLE END AS a1 FROM totals, amount),
hyper AS (SELECT attr_id, a1, CASE WHEN u > {R} THEN {R} + 1 - a1 ELSE 0.5::DOUBLE + u - total END AS b1,
  1.0::DOUBLE AS a2, 1.0::DOUBLE AS b2, 1.0::DOUBLE AS a3, {R} AS b3, {R} AS a4, 1.0::DOUBLE AS b4 FROM first_pair),
sizes AS (SELECT cluster, count(*) AS n FROM partition GROUP BY cluster),
clusters AS (SELECT count(*) AS k FROM sizes),
seen AS (SELECT cluster, attr_id, count(*) AS c FROM ones JOIN partition USING (unit_id) GROUP BY cluster, attr_id),
cluster_counts AS (SELECT cluster, attr_id, coalesce(c, 0) AS n1 FROM (SELECT cluster, attr_id FROM sizes, attributes) LEFT JOIN seen USING (cluster, attr_id)),
scores AS (SELECT cluster, attr_id, n, n1, k, a1, a2, a3, a4, b1, b2, b3, b4, {scores} FROM cluster_counts JOIN sizes USING (cluster) JOIN hyper USING (attr_id), clusters),
sums AS (SELECT attr_id, sum(l1) AS h1, sum(l2) AS h2, sum(greatest(l3, l4)) AS h3 FROM scores GROUP BY attr_id),
classes AS (SELECT *, CASE WHEN h3 > h2 AND h3 > h1 THEN 3 WHEN h3 > h2 THEN 1 WHEN h2 > h1 THEN 2 ELSE 1 END AS class FROM sums),
states AS (SELECT cluster, attr_id, CASE WHEN class = 3 AND l4 > l3 THEN 4 ELSE class END AS state FROM scores JOIN classes USING (attr_id)),
effective AS (SELECT s.*, state, CASE state WHEN 1 THEN a1 WHEN 2 THEN a2 WHEN 3 THEN a3 ELSE a4 END AS a, CASE state WHEN 1 THEN b1 WHEN 2 THEN b2 WHEN 3 THEN b3 ELSE b4 END AS b
  FROM scores s JOIN states USING (cluster, attr_id)),
grid AS (SELECT p.unit_id, p.cluster AS own_cluster, e.*, o.unit_id IS NOT NULL AS has
  FROM partition p CROSS JOIN effective e LEFT JOIN ones o ON o.unit_id = p.unit_id AND o.attr_id = e.attr_id),
own AS (SELECT unit_id, cluster, sum(CASE WHEN has THEN ln(a + n1 - 1) WHEN n1 < n THEN ln(b + n - 1 - n1) END - ln(a + b + n - 1)) AS own FROM grid WHERE cluster = own_cluster GROUP BY unit_id, cluster),
joined AS (SELECT unit_id, own_cluster, cluster, sum(CASE WHEN has THEN ln(a + n1) ELSE ln(b + n - n1) END - ln(a + b + n)) AS score FROM grid GROUP BY unit_id, own_cluster, cluster),
gains AS (SELECT j.unit_id, j.own_cluster AS source, j.cluster AS target, j.score - o.own AS gain FROM joined j JOIN own o USING (unit_id) WHERE j.cluster <> j.own_cluster)"""
