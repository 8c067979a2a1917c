"""Secret scans: base patterns, and character Markov models compared by log-likelihood ratio. Built-in functions only.

Two first-order models of characters are counted from labelled samples: one of random strings (what the base patterns
find) and one of ordinary identifiers (every other token). A token of the text is reported when the first model makes
it likelier than the second by ``LEAST_MEAN`` a pair of characters and ``LEAST_TOTAL`` in all.

Positions come from regular expressions alone: the lengths of a text's matches and of the pieces between them add up
to the place of each match.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.llm.common import LAST_ID, documents, hash60, let, materialise

#: The base patterns. The last two find the same runs as without their least lengths, since a run is
#: taken whole or not at all.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
ORDINARY = r"[A-Za-z0-9+/_=-]{4,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
LEAST_VALUE = 8
#: Documents from which either model is counted: those with the smallest hashes of their ids.
SAMPLE = 5000
LEAST_MEAN = 0.5
LEAST_TOTAL = 12.0
BLOCK = 256


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda s, x: s + x["p"] + x["m"])


def located(text: Column, pattern: str, *, least: Callable[[Column], Column] | None = None) -> Column:
    """Matches of a pattern from left to right: array of (start, stop, match), in code points.

    Lengths are summed in blocks of ``BLOCK`` matches, so the work stays linear for texts with very many.
    """
    empty = F.expr("cast(array() as array<struct<start: int, stop: int, match: string>>)")

    def place(pair: Column) -> Column:
        items = F.zip_with(F.slice(pair["pieces"], F.lit(1), F.size(pair["matches"])), pair["matches"], lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m"), m.alias("match")))
        return let(items, sums)

    def sums(items: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: _total(F.slice(items, b * BLOCK + 1, F.lit(BLOCK))))
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))
        return let(starts, lambda s: F.transform(items, lambda x, i: placed(items, s, x, i)))

    def placed(items: Column, starts: Column, x: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        start = starts[block] + _total(F.slice(items, block * BLOCK + 1, i % BLOCK)) + x["p"]
        return let(start, lambda s: F.struct(s.alias("start"), (s + x["m"]).alias("stop"), x["match"].alias("match")))

    pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("pieces"))
    found = F.when(text.rlike(pattern), let(pair, place)).otherwise(empty)
    return F.filter(found, least) if least is not None else found


def _base(text: Column) -> dict[str, Column]:
    value = lambda m: F.regexp_extract(m["match"], ASSIGN, 1)
    return {"assign": located(text, ASSIGN, least=lambda m: F.length(value(m)) >= LEAST_VALUE), "access": located(text, ACCESS), "hex": located(text, HEX)}


def _characters(token: Column) -> Column:
    """Places in ``ALPHABET`` of a token's characters, from 1; 0 for others."""
    return F.transform(F.split(token, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))


def _pairs(token: Column) -> Column:
    """A number for each two adjacent characters of a token."""
    n = len(ALPHABET) + 1
    return let(_characters(token), lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: a * n + b))


def _counted(tokens: DataFrame) -> dict[int, int]:
    """Counts of the pairs of the column ``token``: no more rows than the alphabet has pairs."""
    return {r["pair"]: r["n"] for r in tokens.select(F.explode(_pairs(F.col("token"))).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).collect()}


def _drawn(rows: DataFrame, sample: int) -> DataFrame:
    """The texts of the ``sample`` ids with the smallest hashes; so many ids are broadcast, no more."""
    chosen = materialise(rows.select("doc_id").dropDuplicates().orderBy(hash60("doc_id"), "doc_id").limit(sample))
    return materialise(rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("text"))


def train(docs: DataFrame, *, sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratio of each pair of characters, random string over ordinary identifier.

    At most ``sample`` documents are counted for either: of those that hold what a base pattern finds, and of all.
    Without any secret in the table both models are even and no token is reported.
    """
    text = F.col("text")
    filled = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    holds = F.exists(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1)), lambda v: F.length(v) >= LEAST_VALUE) | text.rlike(ACCESS) | text.rlike(HEX)
    secret, rows = _drawn(filled.where(holds), sample), _drawn(filled, sample)
    base = _base(text)
    values = F.concat(F.transform(base["assign"], lambda m: F.regexp_extract(m["match"], ASSIGN, 1)), F.transform(base["access"], lambda m: m["match"]), F.transform(base["hex"], lambda m: m["match"]))
    random = _counted(secret.select(F.explode(F.array_distinct(values)).alias("token")))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = _counted(rows.select(F.explode(F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0))).alias("token")))
    n = len(ALPHABET) + 1
    if not random:
        return [0.0] * (n * n)
    return [_log_share(random, a, b, n) - _log_share(ordinary, a, b, n) for a in range(n) for b in range(n)]


def _log_share(counts: dict[int, int], a: int, b: int, n: int) -> float:
    row = sum(counts.get(a * n + k, 0) for k in range(n))
    return math.log((counts.get(a * n + b, 0) + 0.5) / (row + 0.5 * n))


def _ratio(token: Column, table: Column) -> Column:
    return F.aggregate(_pairs(token), F.lit(0.0), lambda s, p: s + F.element_at(table, p.cast("int") + 1))


def scan(docs: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """doc_id and an array of spans (start, kind, stop), in order of start, then kind as in ``KINDS``.

    A null text counts as empty and has no span; rows stay one to one. Markov spans that touch a base span are left out.
    """
    rows = documents(docs)
    table = F.split(F.lit(",".join(f"{v:.9g}" for v in train(rows, sample=sample))), ",").cast("array<double>")
    text = F.col("text")

    def likely(m: Column) -> Column:
        return let(_ratio(m["match"], table), lambda r: (r >= LEAST_TOTAL) & (r >= LEAST_MEAN * (F.length(m["match"]) - 1)))

    def tagged(found: Column, kind: int) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["stop"].alias("stop")))

    filled = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = F.concat(*[tagged(found, k) for k, found in enumerate(_base(text).values())])
    both = F.struct(base.alias("base"), tagged(located(text, TOKEN, least=likely), 3).alias("more"))
    apart = let(both, lambda s: F.concat(s["base"], F.filter(s["more"], lambda m: ~F.exists(s["base"], lambda x: (x["start"] < m["stop"]) & (m["start"] < x["stop"])))))
    return filled.select("doc_id", F.array_sort(apart).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["stop"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = written(F.filter("spans", lambda s: s["kind"] < 3))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
