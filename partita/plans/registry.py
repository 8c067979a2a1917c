"""Queries over the given tables, by name, each with SQL for the same result where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.operators import assign, cocluster, counts, distance, encode, model, report, search
from partita.operators.encode import Dataset
from partita.plans import inputs
from partita.plans.inputs import dataset, encode_sql, lgamma_mix, model_sql, partition, table
from partita.sources import tables
from partita.sources.scratch import shared_folder, written
from partita.streaming import profile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _round(column: str | Column, digits: int = 6) -> Column:
    return F.round(column, digits)


def _folder(spark: SparkSession) -> str:
    """A new folder below the shared one, for what a query writes and reads again."""
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


# Cells and encoding


def _cells(name: str):
    return lambda spark, d: inputs.CELLS[name](spark, d)


for _name in ("orders", "aligned", "documents"):
    _query(f"cells_{_name}", f"{encode_sql(_name)} SELECT unit_id, pos, value FROM cells")(_cells(_name))
for _name in inputs.CELLS:
    _query(f"sites_{_name}", f"{encode_sql(_name)} SELECT pos, n_values, n_present, is_poly FROM sites")(lambda spark, d, n=_name: encode.profile_sites(encode.value_counts(inputs.CELLS[n](spark, d))))
for _name in ("aligned", "orders", "part"):
    _query(f"alphabet_{_name}", f"{encode_sql(_name)} SELECT value, code FROM alphabet")(lambda spark, d, n=_name: encode.alphabet(encode.value_counts(inputs.CELLS[n](spark, d))))
    _query(f"attributes_{_name}", f"{encode_sql(_name)} SELECT attr_id, site_key, pos, value, code FROM attributes")(lambda spark, d, n=_name: dataset(spark, d, n).attributes)
    _query(f"one_hot_{_name}", f"{encode_sql(_name)} SELECT unit_id, attr_id FROM ones")(lambda spark, d, n=_name: dataset(spark, d, n).ones)
for _name in ("aligned", "part"):
    _query(
        f"decode_{_name}",
        f"{encode_sql(_name)} SELECT unit_id, pos, coalesce(CASE WHEN is_poly THEN value END, '') AS value FROM cells JOIN sites USING (pos)",
    )(lambda spark, d, n=_name: encode.decode(dataset(spark, d, n)))


@_query(
    "validate_texts",
    """WITH sized AS (SELECT doc_id AS unit_id, len(text) AS n FROM documents WHERE len(text) > 0),
    usual AS (SELECT n AS usual FROM sized GROUP BY n ORDER BY count(*) DESC, n LIMIT 1)
    SELECT 'length' AS problem, unit_id, n || ' cells, others have ' || usual AS detail FROM sized, usual WHERE n <> usual""",
)
def validate_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as sequences of unequal length: all but those of the commonest length are reported."""
    return encode.validate(tables.from_strings(table(spark, d, "documents"), "doc_id", "text"))


@_query("validate_orders", f"{encode_sql('orders')} SELECT 'letters' AS problem, unit_id, string_agg(value, '' ORDER BY value) AS detail FROM (SELECT DISTINCT unit_id, value FROM cells WHERE value NOT IN ('o', 'f')) WHERE true GROUP BY unit_id")
def validate_orders(spark: SparkSession, d: str) -> DataFrame:
    return encode.validate(inputs.order_cells(spark, d), letters=("o", "f"))


@_query("saved_dataset", f"{encode_sql('part')} SELECT unit_id, attr_id, pos, value FROM ones JOIN attributes USING (attr_id)")
def saved_dataset(spark: SparkSession, d: str) -> DataFrame:
    """A data set after it was written to the shared folder and loaded again."""
    path = _folder(spark)
    tables.save_dataset(dataset(spark, d, "part"), path)
    data = tables.load_dataset(spark, path)
    return data.ones.join(data.attributes, "attr_id").select("unit_id", "attr_id", "pos", "value")


SEQUENCE_SQL = "translate(lpad(p_partkey::VARCHAR, 8, '0') || lpad(p_size::VARCHAR, 3, '0'), '0123456789', 'acgturykmw')"


@_query("fasta_part", f"SELECT 'part ' || p_partkey AS uid, pos, substr({SEQUENCE_SQL}, pos, 1) AS value FROM part, (SELECT unnest(range(1, 12))::INTEGER AS pos)")
def fasta_part(spark: SparkSession, d: str) -> DataFrame:
    """Keys and sizes of parts as sequences, written as a sequence file of two lines a sequence and read again."""
    path = _folder(spark)
    text = F.translate(F.concat(F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lpad(F.col("p_size").cast("string"), 3, "0")), "0123456789", "ACGTURYKMW")
    record = F.concat(F.lit(">part "), F.col("p_partkey"), F.lit("\n"), F.substring(text, 1, 6), F.lit("\n  "), F.substring(text, 7, 5), F.lit("\n"))
    table(spark, d, "part").select(record.alias("value")).write.text(path)
    cells, units = tables.read_fasta(spark, path)
    return cells.join(units, "unit_id").select("uid", "pos", "value")


@_query("csv_orders", f"{encode_sql('orders')} SELECT unit_id::VARCHAR AS uid, pos, value FROM cells")
def csv_orders(spark: SparkSession, d: str) -> DataFrame:
    """Columns of orders, written as CSV with a header and ids and read again."""
    path = _folder(spark)
    columns = ["o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")]
    table(spark, d, "orders").select("o_orderkey", *columns).write.option("header", True).csv(path)
    cells, units = tables.read_csv(spark, path, header=True, ids=True)
    return cells.join(units, "unit_id").select("uid", "pos", "value")


@_query("partition_file_orders", "SELECT row_number() OVER (ORDER BY o_orderkey) AS unit_id, dense_rank() OVER (ORDER BY o_orderpriority)::DOUBLE AS label FROM orders")
def partition_file_orders(spark: SparkSession, d: str) -> DataFrame:
    """Labels written in the order of units, one a line, and read again: line i is unit i."""
    path = _folder(spark)
    part = written(partition(spark, d, "orders"))
    tables.write_partition(part, path)
    return tables.read_partition(spark, path, part.count())


# Counts and labels

for _name in ("documents", "orders", "part", "customer"):
    _query(f"attribute_totals_{_name}", f"{model_sql(_name)} SELECT attr_id, total FROM totals")(lambda spark, d, n=_name: (lambda x: counts.attribute_totals(x.ones, x.attributes))(dataset(spark, d, n)))
    _query(f"cluster_sizes_{_name}", f"{model_sql(_name)} SELECT cluster, n FROM sizes")(lambda spark, d, n=_name: counts.cluster_sizes(partition(spark, d, n)))
    _query(f"cluster_counts_{_name}", f"{model_sql(_name)} SELECT cluster, attr_id, n1 FROM cluster_counts")(
        lambda spark, d, n=_name: (lambda x: counts.cluster_counts(x.ones, partition(spark, d, n), x.attributes))(dataset(spark, d, n))
    )


@_query("lineitem_value_counts", "SELECT pos, value, count(*) AS n FROM (" + inputs._columns_sql("lineitem", "l_orderkey", ["l_returnflag", "l_linestatus", "l_linenumber"]) + ") GROUP BY pos, value")
def lineitem_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return encode.value_counts(tables.from_table(table(spark, d, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus", "l_linenumber"]))


@_query("relabel_orders", "SELECT o_orderkey AS unit_id, dense_rank() OVER (ORDER BY trunc(o_custkey % 7 - 3.2 + 0.5))::INTEGER AS cluster FROM orders")
def relabel_orders(spark: SparkSession, d: str) -> DataFrame:
    return counts.relabel(table(spark, d, "orders").select(F.col("o_orderkey").alias("unit_id"), (F.col("o_custkey") % 7 - 3.2).alias("label")))


@_query(
    "order_by_size_documents",
    f"{model_sql('documents')}, placed AS (SELECT cluster, row_number() OVER (ORDER BY n DESC, cluster)::INTEGER AS new FROM sizes) SELECT unit_id, new AS cluster FROM partition JOIN placed USING (cluster)",
)
def order_by_size_documents(spark: SparkSession, d: str) -> DataFrame:
    return counts.order_by_size(partition(spark, d, "documents"))


# Model


def _scored(spark: SparkSession, d: str, name: str) -> tuple[Dataset, DataFrame, DataFrame]:
    data = dataset(spark, d, name)
    return data, partition(spark, d, name), model.default_hyper(data)


def _scores(spark: SparkSession, d: str, name: str) -> DataFrame:
    return model.state_scores(*_scored(spark, d, name))


for _name in ("documents", "orders"):
    _query(f"hyper_parameters_{_name}", f"{model_sql(_name)} SELECT attr_id, " + ", ".join(f"round({x}{s}, 6) AS {x}{s}" for x in "ab" for s in range(1, 5)) + " FROM hyper")(
        lambda spark, d, n=_name: model.default_hyper(dataset(spark, d, n)).select("attr_id", *[_round(f"{x}{s}").alias(f"{x}{s}") for x in "ab" for s in range(1, 5)])
    )
    _query(f"state_scores_{_name}", f"{model_sql(_name)} SELECT cluster, attr_id, " + ", ".join(f"round(l{s}, 6) AS l{s}" for s in range(1, 5)) + " FROM scores")(
        lambda spark, d, n=_name: _scores(spark, d, n).select("cluster", "attr_id", *[_round(f"l{s}").alias(f"l{s}") for s in range(1, 5)])
    )
    _query(f"cluster_marginals_{_name}", f"{model_sql(_name)} SELECT cluster, round(sum({lgamma_mix('a1', 'b1')}), 4) AS log_marginal FROM scores GROUP BY cluster")(
        lambda spark, d, n=_name: model.cluster_marginals(*_scored(spark, d, n)).select("cluster", _round("log_marginal", 4).alias("log_marginal"))
    )
for _name in ("documents", "orders", "part", "customer"):
    _query(f"classify_{_name}", f"{model_sql(_name)} SELECT attr_id, class, round(h1, 4) AS h1, round(h2, 4) AS h2, round(h3, 4) AS h3 FROM classes")(
        lambda spark, d, n=_name: model.classify_attributes(_scores(spark, d, n)).select("attr_id", "class", *[_round(h, 4).alias(h) for h in ("h1", "h2", "h3")])
    )
    _query(f"score_partition_{_name}", f"{model_sql(_name)} SELECT round(sum(CASE class WHEN 3 THEN h3 WHEN 2 THEN h2 ELSE h1 END), 3) AS score FROM classes")(
        lambda spark, d, n=_name: model.score_partition(*_scored(spark, d, n)).select(_round("score", 3).alias("score"))
    )


def _states(spark: SparkSession, d: str, name: str) -> tuple[Dataset, DataFrame, DataFrame, DataFrame]:
    data, part, hyper = _scored(spark, d, name)
    scores = written(model.state_scores(data, part, hyper))
    return data, part, scores, written(model.states(scores, model.classify_attributes(scores)))


for _name in ("documents", "orders", "customer"):
    _query(f"states_{_name}", f"{model_sql(_name)} SELECT cluster, attr_id, state FROM states")(lambda spark, d, n=_name: _states(spark, d, n)[3])


@_query("class_priors_of_documents", f"{model_sql('documents')} SELECT s AS state, CASE s WHEN 1 THEN round(ln(0.6), 6) WHEN 2 THEN round(ln(0.35), 6) ELSE round(ln(0.05), 6) END AS log_class, CASE s WHEN 3 THEN round(ln((k - 1)::DOUBLE / k), 6) WHEN 4 THEN round(-ln(k::DOUBLE), 6) ELSE 0.0 END AS log_state FROM clusters, (SELECT unnest([1, 2, 3, 4]) AS s)")
def class_priors_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """Log probabilities of the four states for the number of languages in the table."""
    k = counts.cluster_sizes(partition(spark, d, "documents")).agg(F.count("*").cast("double").alias("k"))
    rows = zip(range(1, 5), model.class_priors(), model.state_priors(F.col("k")), strict=True)
    return k.select(F.inline(F.array(*[F.struct(F.lit(s).alias("state"), _round(F.lit(g)).alias("log_class"), _round(o).alias("log_state")) for s, g, o in rows])))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Orders in 1 to 5 clusters by customer, as five candidate partitions."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit_id"), "o_custkey", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("run_id"))
    return orders.select("run_id", "unit_id", (F.col("o_custkey") % F.col("run_id") + 1).cast("int").alias("cluster"))


def _runs_sql() -> str:
    one = model_sql("orders").split(",\nsizes AS")[0]
    g = ("ln(0.6)", "ln(0.35)", "ln(0.05)", "ln(0.05)")
    op = ("0", "0", "CASE WHEN k = 1 THEN '-inf'::DOUBLE ELSE ln((k - 1)::DOUBLE / k) END", "-ln(k::DOUBLE)")
    scores = ", ".join(f"{lgamma_mix(f'a{s}', f'b{s}')} + {g[s - 1]} / k + {op[s - 1]} AS l{s}" for s in range(1, 5))
    return f"""{one}, runs AS (SELECT r AS run_id, o_orderkey AS unit_id, o_custkey % r + 1 AS cluster FROM orders, (SELECT unnest(range(1, 6)) AS r)),
rsizes AS (SELECT run_id, cluster, count(*) AS n, count(*) OVER (PARTITION BY run_id) AS k FROM runs GROUP BY run_id, cluster),
rseen AS (SELECT run_id, cluster, attr_id, count(*) AS c FROM ones JOIN runs USING (unit_id) GROUP BY run_id, cluster, attr_id),
rcounts AS (SELECT run_id, cluster, attr_id, n, k, coalesce(c, 0) AS n1 FROM (SELECT * FROM rsizes, (SELECT attr_id FROM attributes)) LEFT JOIN rseen USING (run_id, cluster, attr_id)),
rscores AS (SELECT run_id, attr_id, {scores} FROM rcounts JOIN hyper USING (attr_id)),
rsums AS (SELECT run_id, attr_id, sum(l1) AS h1, sum(l2) AS h2, sum(greatest(l3, l4)) AS h3 FROM rscores GROUP BY run_id, attr_id),
totals_of AS (SELECT run_id, sum(CASE WHEN h3 > h2 AND h3 > h1 THEN h3 WHEN h3 > h2 THEN h1 WHEN h2 > h1 THEN h2 ELSE h1 END) AS score FROM rsums GROUP BY run_id)"""


@_query("score_many_orders", f"{_runs_sql()} SELECT run_id, round(score, 3) AS score FROM totals_of")
def score_many_orders(spark: SparkSession, d: str) -> DataFrame:
    data = dataset(spark, d, "orders")
    return model.score_many(data, _runs(spark, d), model.default_hyper(data)).select("run_id", _round("score", 3).alias("score"))


@_query("best_of_orders", f"{_runs_sql()} SELECT run_id, round(score, 3) AS score FROM totals_of ORDER BY totals_of.score DESC, run_id LIMIT 1")
def best_of_orders(spark: SparkSession, d: str) -> DataFrame:
    data = dataset(spark, d, "orders")
    return model.best_of(model.score_many(data, _runs(spark, d), model.default_hyper(data))).select("run_id", _round("score", 3).alias("score"))


# Units in clusters


def _rows(spark: SparkSession, d: str, name: str) -> tuple[Dataset, DataFrame, DataFrame]:
    data, part, scores, states = _states(spark, d, name)
    return data, part, written(assign.effective(scores, states))


def _gains(spark: SparkSession, d: str, name: str) -> DataFrame:
    data, part, rows = _rows(spark, d, name)
    return assign.move_gains(assign.unit_own_score(data, part, rows), assign.unit_cluster_scores(data, rows))


@_query("unit_own_score_documents", f"{model_sql('documents')} SELECT unit_id, cluster, round(own, 6) AS own FROM own")
def unit_own_score_documents(spark: SparkSession, d: str) -> DataFrame:
    return assign.unit_own_score(*_rows(spark, d, "documents")).select("unit_id", "cluster", _round("own").alias("own"))


@_query("unit_cluster_scores_documents", f"{model_sql('documents')} SELECT unit_id, cluster, round(score, 6) AS score FROM joined")
def unit_cluster_scores_documents(spark: SparkSession, d: str) -> DataFrame:
    data, _, rows = _rows(spark, d, "documents")
    return assign.unit_cluster_scores(data, rows).select("unit_id", "cluster", _round("score").alias("score"))


def _new_cluster_sql() -> str:
    g = ("ln(0.6)", "ln(0.35)", "ln(0.05)", "ln(0.05)")
    op = ("0", "0", "ln(k::DOUBLE / (k + 1))", "-ln((k + 1)::DOUBLE)")
    at = [f"lgamma(a{s} + b{s}) - lgamma(a{s}) - lgamma(b{s}) + lgamma(a{s} + m1) + lgamma(b{s} + n + 1 - m1) - lgamma(a{s} + b{s} + n + 1) + {g[s - 1]} / (k + 1) + {op[s - 1]}" for s in range(1, 5)]
    return f"""{model_sql('documents')}, strong AS (SELECT attr_id, max(state) > 2 AS strong FROM states GROUP BY attr_id),
plus AS (SELECT g.*, strong, n1 + CASE WHEN has THEN 1 ELSE 0 END AS m1 FROM grid g JOIN strong USING (attr_id))
SELECT unit_id, cluster, round(sum(CASE WHEN strong THEN greatest({at[2]}, {at[3]}) WHEN state = 2 THEN {at[1]} ELSE {at[0]} END), 5) AS score FROM plus GROUP BY unit_id, cluster"""


@_query("new_cluster_scores_documents", _new_cluster_sql())
def new_cluster_scores_documents(spark: SparkSession, d: str) -> DataFrame:
    data, _, rows = _rows(spark, d, "documents")
    return assign.new_cluster_scores(data, rows).select("unit_id", "cluster", _round("score", 5).alias("score"))


@_query(
    "best_move_documents",
    f"{model_sql('documents')} SELECT source, target, unit_id, round(gain, 6) AS gain FROM gains QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY round(gain, 9) DESC, unit_id) = 1",
)
def best_move_documents(spark: SparkSession, d: str) -> DataFrame:
    best = assign.best_move_per_unit(_gains(spark, d, "documents").withColumn("gain", F.round("gain", 9)))
    return best.select("source", "target", "unit_id", _round("gain").alias("gain"))


# Reports


@_query(
    "site_classes_documents",
    f"""{model_sql('documents')}, flags AS (SELECT pos, cluster, bool_or(state = 4) AS own_flag, bool_or(state = 2) AS weak FROM states JOIN attributes USING (attr_id) GROUP BY pos, cluster),
    kinds AS (SELECT pos, cluster, CASE WHEN own_flag THEN 4 WHEN bool_or(own_flag) OVER (PARTITION BY pos) THEN 3 WHEN bool_or(weak) OVER (PARTITION BY pos) THEN 2 ELSE 1 END AS kind FROM flags)
    SELECT pos, cluster, coalesce(kind, 1) AS class FROM (SELECT pos, cluster FROM sites, sizes) LEFT JOIN kinds USING (pos, cluster)""",
)
def site_classes_documents(spark: SparkSession, d: str) -> DataFrame:
    data, _, _, states = _states(spark, d, "documents")
    return report.site_classes(states, data)


for _name in ("documents", "orders", "customer"):
    _query(f"characteristic_values_{_name}", f"{model_sql(_name)} SELECT pos, cluster, CASE WHEN value = '-' THEN '+' ELSE upper(value) END AS value FROM states JOIN attributes USING (attr_id) WHERE state = 4")(
        lambda spark, d, n=_name: (lambda x: report.characteristic_values(x[3], x[0]))(_states(spark, d, n))
    )


@_query("cluster_summary_documents", f"{model_sql('documents')} SELECT cluster, any_value(n) AS n, " + ", ".join(f"count(*) FILTER (state = {s}) AS state{s}" for s in range(1, 5)) + " FROM states JOIN sizes USING (cluster) GROUP BY cluster")
def cluster_summary_documents(spark: SparkSession, d: str) -> DataFrame:
    _, part, _, states = _states(spark, d, "documents")
    return report.cluster_summary(states, part)


SHOWN = "CASE WHEN value = '-' THEN '+' ELSE upper(value) END"


def _annotated_sql(name: str) -> str:
    return f"""{model_sql(name)},
own_values AS (SELECT cluster, pos, list_sort(list(DISTINCT {SHOWN})) AS vals FROM states JOIN attributes USING (attr_id) WHERE state = 4 GROUP BY cluster, pos),
texts AS (SELECT p.cluster, c.unit_id, c.pos, CASE WHEN is_poly AND list_contains(vals, {SHOWN}) THEN {SHOWN} ELSE lower(coalesce(CASE WHEN is_poly THEN value END, '')) END AS text
  FROM cells c JOIN sites USING (pos) JOIN partition p USING (unit_id) LEFT JOIN own_values o ON o.cluster = p.cluster AND o.pos = c.pos),
heads AS (SELECT cluster, NULL::BIGINT AS unit_id, pos, CASE WHEN len(vals) = 1 THEN vals[1] WHEN len(vals) > 1 THEN len(vals)::VARCHAR ELSE '' END AS text
  FROM (SELECT DISTINCT cluster FROM partition) CROSS JOIN (SELECT pos FROM sites) LEFT JOIN own_values USING (cluster, pos)),
every_text AS (SELECT * FROM texts UNION ALL SELECT * FROM heads),
widths AS (SELECT cluster, pos, greatest(max(len(text)), 1)::INTEGER AS width FROM every_text GROUP BY cluster, pos),
lines AS (SELECT cluster, unit_id, string_agg(lpad(text, width, ' '), '' ORDER BY pos) AS line FROM every_text JOIN widths USING (cluster, pos) GROUP BY cluster, unit_id),
annotated AS (SELECT cluster, (row_number() OVER (PARTITION BY cluster ORDER BY unit_id NULLS FIRST) - 1)::INTEGER AS place, line || coalesce(' ; ' || unit_id, '') AS line FROM lines)"""


@_query("report_customer", f"""{_annotated_sql('customer')},
marks AS (SELECT pos, cluster, bool_or(state = 4) AS mine, bool_or(state = 2) AS weak FROM states JOIN attributes USING (attr_id) GROUP BY pos, cluster),
kinds AS (SELECT pos, cluster, CASE WHEN mine THEN 4 WHEN bool_or(mine) OVER (PARTITION BY pos) THEN 3 WHEN bool_or(weak) OVER (PARTITION BY pos) THEN 2 ELSE 1 END AS class FROM marks)
SELECT 'partition' AS part, unit_id::VARCHAR AS place, cluster::VARCHAR AS cluster, NULL AS said FROM partition
UNION ALL SELECT 'site_classes', s.pos::VARCHAR, c.cluster::VARCHAR, coalesce(class, 1)::VARCHAR FROM sites s CROSS JOIN sizes c LEFT JOIN kinds k ON k.pos = s.pos AND k.cluster = c.cluster
UNION ALL SELECT 'characteristic_values', pos::VARCHAR, cluster::VARCHAR, {SHOWN} FROM states JOIN attributes USING (attr_id) WHERE state = 4
UNION ALL SELECT 'annotated_units', place::VARCHAR, cluster::VARCHAR, line FROM annotated""")
def report_customer(spark: SparkSession, d: str) -> DataFrame:
    """A report of all four levels, written and read again."""
    data, part, _, states = _states(spark, d, "customer")
    path = _folder(spark)
    report.write_report(path, partition=part, score=model.score_partition(data, part, model.default_hyper(data)), states=states, data=data, what=4)
    read = lambda name, place, said: (lambda x: x.select(F.lit(name).alias("part"), F.col(place).alias("place"), "cluster", (F.col(said) if said else F.lit(None).cast("string")).alias("said")))(spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(f"{path}/{name}"))
    parts = [read("partition", "unit_id", None), read("site_classes", "pos", "class"), read("characteristic_values", "pos", "value"), read("annotated_units", "place", "line")]
    return reduce(DataFrame.unionByName, parts)


@_query("annotated_orders", f"{_annotated_sql('orders')} SELECT cluster, place, line FROM annotated")
def annotated_orders(spark: SparkSession, d: str) -> DataFrame:
    data, part, _, states = _states(spark, d, "orders")
    return report.annotated_units(states, data, part)


# Distances

_DISTANCE_SQL = f"""{encode_sql('embeddings')}, sized AS (SELECT unit_id, count(attr_id) AS c FROM units LEFT JOIN ones USING (unit_id) GROUP BY unit_id),
common AS (SELECT a.unit_id AS i, b.unit_id AS j, count(*) AS s FROM ones a JOIN ones b USING (attr_id) GROUP BY ALL),
square AS (SELECT x.unit_id AS i, y.unit_id AS j, CASE WHEN x.c + y.c = coalesce(s, 0) THEN 0.0 ELSE 1 - coalesce(s, 0)::DOUBLE / (x.c + y.c - coalesce(s, 0)) END AS d
  FROM sized x CROSS JOIN sized y LEFT JOIN common ON i = x.unit_id AND j = y.unit_id)"""


@_query("pairwise_distance_embeddings", f"{_DISTANCE_SQL} SELECT i, j, round(d, 6) AS d FROM square WHERE i < j")
def pairwise_distance_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return distance.pairwise_distance(dataset(spark, d, "embeddings")).select("i", "j", _round("d").alias("d"))


@_query("near_pairs_embeddings", f"{_DISTANCE_SQL} SELECT i, j, round(d, 6) AS d FROM square WHERE i < j AND d <= 0.4 + 1e-9")
def near_pairs_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return distance.near_pairs(dataset(spark, d, "embeddings"), 0.4).select("i", "j", _round("d").alias("d"))


@_query("near_pairs_by_threshold_embeddings", f"{_DISTANCE_SQL} SELECT threshold, i, j, round(d, 6) AS d FROM square, (SELECT unnest([0.2::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE]) AS threshold) WHERE i < j AND d <= threshold + 1e-9")
def near_pairs_by_threshold_embeddings(spark: SparkSession, d: str) -> DataFrame:
    pairs, of = distance.near_pairs(dataset(spark, d, "embeddings"), 0.6), F.array(*[F.lit(t) for t in (0.2, 0.4, 0.6)])
    return pairs.select(F.explode(F.filter(of, lambda t: F.col("d") <= t + 1e-9)).alias("threshold"), "i", "j", _round("d").alias("d"))


@_query("nearest_medoid_embeddings", f"{_DISTANCE_SQL}, medoids AS (SELECT min(vec_id) AS j, label + 1 AS cluster FROM embeddings GROUP BY label) SELECT i AS unit_id, cluster::INTEGER AS cluster, round(d, 6) AS d FROM square JOIN medoids USING (j) QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, cluster) = 1")
def nearest_medoid_embeddings(spark: SparkSession, d: str) -> DataFrame:
    medoids = table(spark, d, "embeddings").groupBy("label").agg(F.min("vec_id").alias("unit_id")).select((F.col("label") + 1).cast("int").alias("cluster"), "unit_id")
    return distance.nearest_medoid(dataset(spark, d, "embeddings"), medoids).select("unit_id", "cluster", _round("d").alias("d"))


@_query(
    "k_medoids_embeddings",
    f"""{_DISTANCE_SQL}, m1 AS (SELECT i FROM square GROUP BY i ORDER BY round(sum(d), 9), i LIMIT 1),
    n1 AS (SELECT j, d AS near FROM square JOIN m1 USING (i)), m2 AS (SELECT i FROM square JOIN n1 USING (j) WHERE i NOT IN (SELECT i FROM m1) GROUP BY i ORDER BY round(sum(greatest(near - d, 0)), 9) DESC, i LIMIT 1),
    n2 AS (SELECT j, min(d) AS near FROM square WHERE i IN (SELECT i FROM m1 UNION ALL SELECT i FROM m2) GROUP BY j),
    m3 AS (SELECT i FROM square JOIN n2 USING (j) WHERE i NOT IN (SELECT i FROM m1 UNION ALL SELECT i FROM m2) GROUP BY i ORDER BY round(sum(greatest(near - d, 0)), 9) DESC, i LIMIT 1)
    SELECT 1 AS cluster, i AS unit_id FROM m1 UNION ALL SELECT 2, i FROM m2 UNION ALL SELECT 3, i FROM m3""",
)
def k_medoids_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return distance.medoids(dataset(spark, d, "embeddings"), 3)


@_query("candidate_cuts_customer")
def candidate_cuts_customer(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of every cut and their units, with the scores of the cuts."""
    data = dataset(spark, d, "customer")
    tree = distance.dendrogram(data)
    scores = distance.score_cuts(data, tree, model.default_hyper(data)).select("run_id", _round("score", 3).alias("score"))
    units = tree.leaves.groupBy("leaf").agg(F.count("*").alias("n")).join(tree.cuts, "leaf").groupBy("run_id", "cluster").agg(F.sum("n").alias("n"))
    return units.join(scores, "run_id")


@_query("initial_partition_customer")
def initial_partition_customer(spark: SparkSession, d: str) -> DataFrame:
    data = dataset(spark, d, "customer")
    return distance.initial_partition(data, model.default_hyper(data))


# Search


def _at(spark: SparkSession, d: str, name: str) -> search._Position:
    data = dataset(spark, d, name)
    return search.position(data, partition(spark, d, name), model.default_hyper(data))


def _proposed(operator):
    def run(spark: SparkSession, d: str) -> DataFrame:
        """What an operator proposes from the languages, with the scores of the proposals."""
        at = _at(spark, d, "documents")
        rows = [(p.target + 1, s + 1, int(n), p.score) for p in search.scored(at, operator(at) or []) for s, (n, _) in sorted(p.moved.items())]
        return spark.createDataFrame(rows, "target int, source int, n long, score double").withColumn("score", _round("score", 3))

    return run


for _operator in (search.collect_from_cluster, search.split_cluster, search.collect_from_all, search.create_from_all, search.swap_units):
    _query(f"propose_{_operator.__name__}")(_proposed(_operator))


@_query("move_sums_documents", f"""{model_sql('documents')} SELECT source, target, count(*) FILTER (round(gain, 9) > 0) AS n, round(coalesce(sum(gain) FILTER (gain > 0), 0), 4) AS gain, round(sum(gain), 4) AS "every"
FROM (SELECT source::INTEGER AS source, target::INTEGER AS target, gain FROM gains) GROUP BY source, target""")
def move_sums_documents(spark: SparkSession, d: str) -> DataFrame:
    """For each pair of clusters: units that gain, what they gain, and what a move of all would."""
    rows = [(s + 1, t + 1, n, gain, every) for s, t, n, gain, every in search.pair_sums(_at(spark, d, "documents"))]
    made = spark.createDataFrame(rows, 'source int, target int, n long, gain double, every double')
    return made.select("source", "target", "n", _round("gain", 4).alias("gain"), _round("every", 4).alias("every"))


@_query(
    "split_seeds_documents",
    f"{model_sql('documents')} SELECT cluster::INTEGER AS cluster, arg_min(unit_id, (round(own, 9), unit_id)) AS seed, round(min(own), 6) AS low, arg_min(unit_id, (-round(own, 9), unit_id)) AS stay FROM own GROUP BY cluster HAVING count(*) > 1",
)
def split_seeds_documents(spark: SparkSession, d: str) -> DataFrame:
    """Where splits of clusters begin: the unit that fits its cluster worst, its score, and the one that fits best."""
    rows = [(c + 1, seed, low, stay) for c, seed, low, _, stay in search._edges(_at(spark, d, "documents"))]
    return spark.createDataFrame(rows, "cluster int, seed long, low double, stay long").withColumn("low", _round("low"))


#: An attribute that one of two exchanged units has alone leaves a cluster and comes to the other; what both have stays.
_SWAPS_SQL = f"""{model_sql('documents')},
changes AS (SELECT cluster, attr_id, CASE WHEN n1 > 0 THEN ln(b + n - n1) - ln(a + n1 - 1) ELSE 0 END AS leave, CASE WHEN n1 < n THEN ln(a + n1) - ln(b + n - n1 - 1) ELSE 0 END AS come FROM effective),
sides AS (SELECT x.cluster AS source, y.cluster AS target, x.attr_id, x.leave + y.come AS there, y.leave + x.come AS back FROM changes x JOIN changes y ON x.attr_id = y.attr_id AND x.cluster < y.cluster),
held AS (SELECT o.unit_id, p.cluster, o.attr_id FROM ones o JOIN partition p USING (unit_id)),
gone AS (SELECT unit_id, source, target, sum(there) AS there FROM held h JOIN sides s ON s.source = h.cluster AND s.attr_id = h.attr_id GROUP BY ALL),
brought AS (SELECT unit_id, source, target, sum(back) AS back FROM held h JOIN sides s ON s.target = h.cluster AND s.attr_id = h.attr_id GROUP BY ALL),
shared AS (SELECT x.unit_id AS unit_id, y.unit_id AS other, source, target, sum(there + back) AS same
  FROM sides s JOIN held x ON x.cluster = s.source AND x.attr_id = s.attr_id JOIN held y ON y.cluster = s.target AND y.attr_id = s.attr_id GROUP BY ALL)"""


@_query(
    "swap_gains_documents",
    f"""{_SWAPS_SQL} SELECT g.source::INTEGER AS source, g.target::INTEGER AS target, round(max(there + back - coalesce(same, 0)), 6) AS gain
    FROM gone g JOIN brought b ON b.source = g.source AND b.target = g.target LEFT JOIN shared s ON s.unit_id = g.unit_id AND s.other = b.unit_id
    GROUP BY g.source, g.target HAVING round(max(there + back - coalesce(same, 0)), 9) > 1e-10""",
)
def swap_gains_documents(spark: SparkSession, d: str) -> DataFrame:
    """What the best exchange of two units gains with states held, for each pair of languages where one does."""
    rows = [(k + 1, w + 1, gain) for gain, k, _, w, _, _, _ in search.swaps(_at(spark, d, "documents"))]
    return spark.createDataFrame(rows, "source int, target int, gain double").withColumn("gain", _round("gain"))


@_query("search_documents")
def search_documents(spark: SparkSession, d: str) -> DataFrame:
    """Units and scores of the clusters that a search from the languages ends with."""
    data = dataset(spark, d, "documents")
    hyper = written(model.default_hyper(data))
    found = search.search(data, partition(spark, d, "documents"), hyper)
    return counts.cluster_sizes(found.partition).withColumn("score", _round(F.lit(found.score), 3)).withColumn("rounds", F.lit(len(found.history) - 1))


@_query("search_restarts_documents")
def search_restarts_documents(spark: SparkSession, d: str) -> DataFrame:
    """What searches from the languages and from the sources of documents end with, side by side, and which is best."""
    data = dataset(spark, d, "documents")
    hyper = written(model.default_hyper(data))
    found = search.searches(data, [partition(spark, d, "documents"), partition(spark, d, "documents", "source")], hyper)
    best = max(r.score for r in found)
    rows = [(i, r.score, len(r.history) - 1, r.score == best) for i, r in enumerate(found)]
    return spark.createDataFrame(rows, "run_id int, score double, rounds int, best boolean").withColumn("score", _round("score", 3))


# Co-clustering


def _factors(data: Dataset) -> tuple[DataFrame, DataFrame]:
    w = data.units.select("unit_id", F.array(((F.col("unit_id") % 3 + 1) / 100).alias("a"), ((F.col("unit_id") % 5 + 1) / 100).alias("b")).alias("w"))
    h = data.attributes.select("attr_id", F.array((F.col("attr_id") % 2 + 1) / 10, (F.col("attr_id") % 3 + 1) / 10).alias("h"))
    return w, h


_FACTORS_SQL = f"""{encode_sql('part')}, w AS (SELECT unit_id, (unit_id % 3 + 1) / 100 AS w1, (unit_id % 5 + 1) / 100 AS w2 FROM units),
h AS (SELECT attr_id, (attr_id % 2 + 1) / 10 AS h1, (attr_id % 3 + 1) / 10 AS h2 FROM attributes),
xh AS (SELECT unit_id, sum(h1) AS x1, sum(h2) AS x2 FROM ones JOIN h USING (attr_id) GROUP BY unit_id),
m AS (SELECT sum(w1 * x1) AS p11, sum(w1 * x2) AS p12, sum(w2 * x1) AS p21, sum(w2 * x2) AS p22 FROM w JOIN xh USING (unit_id)),
ww AS (SELECT sum(w1 * w1) AS a, sum(w1 * w2) AS b, sum(w2 * w2) AS c FROM w), hh AS (SELECT sum(h1 * h1) AS e, sum(h1 * h2) AS f, sum(h2 * h2) AS g FROM h), t AS (SELECT count(*) AS t FROM ones)"""


@_query(
    "bipnmf_objective_part",
    f"""{_FACTORS_SQL}, q AS (SELECT a * p11 + b * p21 AS q11, a * p12 + b * p22 AS q12, b * p11 + c * p21 AS q21, b * p12 + c * p22 AS q22, m.*, hh.*, t.* FROM m, ww, hh, t)
    SELECT round(t - 2 * (p11 * p11 + p12 * p12 + p21 * p21 + p22 * p22) + e * (p11 * q11 + p21 * q21) + f * (p12 * q11 + p22 * q21) + f * (p11 * q12 + p21 * q22) + g * (p12 * q12 + p22 * q22), 4) AS objective FROM q""",
)
def bipnmf_objective_part(spark: SparkSession, d: str) -> DataFrame:
    data = dataset(spark, d, "part")
    value = cocluster.objective(cocluster.entries_of(data), *_factors(data))
    return data.units.limit(1).select(_round(F.lit(value), 4).alias("objective"))


@_query("bipnmf_fit_part")
def bipnmf_fit_part(spark: SparkSession, d: str) -> DataFrame:
    """Row clusters of a fit that goes on to its tolerance."""
    data = dataset(spark, d, "part")
    w, _, _ = cocluster.fit(cocluster.entries_of(data), *_factors(data))
    return cocluster.assign_argmax(w, "unit_id", "w")


@_query("assign_argmax_part", f"{_FACTORS_SQL} SELECT unit_id, CASE WHEN w1 >= w2 THEN 1 ELSE 2 END AS cluster FROM w")
def assign_argmax_part(spark: SparkSession, d: str) -> DataFrame:
    return cocluster.assign_argmax(_factors(dataset(spark, d, "part"))[0], "unit_id", "w")


@_query("svd_init_documents")
def svd_init_documents(spark: SparkSession, d: str) -> DataFrame:
    w, _ = cocluster.svd_init(dataset(spark, d, "documents"), 3, 3)
    return cocluster.assign_argmax(w, "unit_id", "w")


# Streams


@_query("stream_profile_orders", f"{encode_sql('orders')} SELECT pos, n_values, n_present, is_poly FROM sites")
def stream_profile_orders(spark: SparkSession, d: str) -> DataFrame:
    """The site table of a stream over the files of ``orders``, once all have arrived."""
    schema = table(spark, d, "orders").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "orders*").parquet(d)
    records = stream.select("o_orderkey", "o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    kept, columns = profile.Profile(_folder(spark)), ["o_orderstatus", "o_orderpriority", "y", "m"]
    running = kept.start(records, lambda batch: tables.from_table(batch, "o_orderkey", columns), _folder(spark))
    running.processAllAvailable()
    running.stop()
    return kept.sites(spark)
