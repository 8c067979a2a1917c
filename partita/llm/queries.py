"""One query for each corpus operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from partita.llm import collocations, language, licenses, lines, media, minhash, mixing, neighbours, secrets, sentencepiece_codec, substrings, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.load(media.store(_table(spark, sf_dir, "documents"))))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.dedup_substrings(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
sums AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS left_over,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left
  FROM sums
  WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, 3 * source_size * weight_left <= weight * left_over AS is_capped FROM ranked),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_capped THEN (3 * source_size)::DOUBLE
              ELSE (weight * (sum(source_size) OVER () - sum(CASE WHEN is_capped THEN 3 * source_size ELSE 0 END) OVER ()))::DOUBLE
                   / (sum(CASE WHEN is_capped THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target
  FROM capped),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, floor(b.target - b.whole * b.source_size)::BIGINT AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.h) AS same
  FROM sized d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (whole * size + CASE WHEN upto <= rest THEN size WHEN upto - same >= rest OR same = 0 THEN 0
                            ELSE floor((rest - (upto - same)) * size / same) END)::BIGINT AS taken
FROM placed
"""


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.round_trip(_table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "round_trip",
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
grams AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
counts AS (SELECT lang, phrase, k, count(*)::BIGINT AS a FROM grams GROUP BY lang, phrase, k HAVING count(*) >= 100),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
inner_ AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM candidates, (SELECT unnest(range(2, 5)) AS m) WHERE m < k)
  GROUP BY ALL),
free AS (SELECT c.* FROM candidates c LEFT JOIN inner_ i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < 100 * c.a),
cuts AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS cut FROM free),
scored AS (
  SELECT c.lang, c.phrase, c.a, h.a AS l, t.a AS r, n, cut, ((1000::HUGEINT * c.a * n) // (h.a::HUGEINT * t.a))::BIGINT AS score
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = array_to_string(w[1:cut], ' ')
  JOIN counts t ON t.lang = c.lang AND t.phrase = array_to_string(w[cut + 1:], ' ') JOIN totals n ON n.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media, "op2_language": op2_language, "op3_toxicity": op3_toxicity, "op4_substrings": op4_substrings,
    "op5_mixing": op5_mixing, "op6_lines": op6_lines, "op7_neighbours": op7_neighbours, "op8_minhash": op8_minhash,
    "op9_secrets": op9_secrets, "op10_sentencepiece": op10_sentencepiece, "op11_collocations": op11_collocations, "op12_whitening": op12_whitening,
    "op13_licenses": op13_licenses, "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op5_mixing": OP5_SQL, "op11_collocations": OP11_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
