"""License scans: ordered signature rules over a text's words. Built-in functions only.

1. A prefilter: texts without any of the stems in ``license_rules.STEMS`` are done; of the others the words are taken in
   lower case, one space apart.
2. Of the rules, hundreds of regexes, those are tried whose keyword the text holds.
3. Detections may overlap. One that lies within another is suppressed if the other's tier is as low or lower; of equal
   places the rule with the lower tier, then the earlier one, is kept. Detections of a document are gone through once, in
   order of their start, with the furthest end so far of every tier beside them.

Places of the base phrases are counted apart from the rules and are never suppressed.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.llm.common import documents, let, materialise
from partita.llm.license_rules import STEMS, rules

#: What is no word, words of a text in any case, and the base phrases with their labels.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: How sure a detection of each tier is.
CONFIDENCE = {1: 1.0, 2: 0.95, 3: 0.8, 4: 0.5}
BLOCK = 256
DETECTION = "array<struct<start: bigint, stop: bigint, tier: int, rank: int, label: string>>"


def whole_words(regex: str) -> str:
    return f"(?<= )(?:{regex})(?= )"


def _may_hold(text: Column) -> Column:
    """True if a text holds a stem; stems of several words may have anything but words between them."""
    low = F.lower(text)
    single = [low.contains(s) for s in STEMS if " " not in s]
    several = [low.contains(s.split()[0]) & low.rlike(APART.join(re.escape(w) for w in s.split())) for s in STEMS if " " in s]
    return reduce(lambda a, b: a | b, single + several)


def normalised(text: Column) -> Column:
    """The words of a text in lower case (A-Z only) with a space before, between and behind them."""
    return F.regexp_replace(F.concat(F.lit(" "), F.translate(text, UPPER, LOWER), F.lit(" ")), APART, " ")


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s + x["p"] + x["m"])


def places(words: Column, regex: Column) -> Column:
    """First word and the word after the last of each match, from left to right: array of (start, stop).

    Words are counted by the spaces in and between the matches, summed in blocks of ``BLOCK`` matches, so the work stays
    linear for texts with very many.
    """

    def sums(items: Column) -> Column:
        count = F.greatest(F.size(items) - 1, F.lit(0))
        blocks = F.transform(F.sequence(F.lit(0), F.floor(count / BLOCK).cast("int")), lambda b: _total(F.slice(items, b * BLOCK + 1, F.lit(BLOCK))))
        begins = F.aggregate(blocks, F.array(F.lit(-1).cast("long")), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))
        return let(begins, lambda s: F.transform(items, lambda x, i: place(items, s, x, i)))

    def place(items: Column, begins: Column, x: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        start = begins[block] + _total(F.slice(items, block * BLOCK + 1, i % BLOCK)) + x["p"]
        return let(start, lambda s: F.struct(s.alias("start"), (s + x["m"] + 1).alias("stop")))

    matches = F.regexp_extract_all(words, regex, F.lit(0))
    return let(matches, lambda m: let(F.zip_with(F.slice(F.split(words, regex, -1), F.lit(1), F.size(m)), m, lambda p, x: F.struct(_spaces(p).alias("p"), _spaces(x).alias("m"))), sums))


def _base(words: Column) -> Column:
    """label, start and stop of the places of the base phrases."""

    def of(phrase: str, label: str) -> Column:
        return F.transform(places(words, F.lit(whole_words(phrase))), lambda m: F.struct(F.lit(label).alias("label"), m["start"].alias("start"), m["stop"].alias("stop")))

    return F.when(words.contains(" license "), F.concat(*[of(*pair) for pair in BASE]))


def _detections(words: Column) -> Column:
    """All matches of all rules whose keyword the words hold."""
    table = F.array(*[F.struct(F.lit(tier).alias("tier"), F.lit(rank).alias("rank"), F.lit(label).alias("label"), F.lit(keyword).alias("keyword"), F.lit(whole_words(regex)).alias("regex")) for rank, (tier, keyword, label, regex) in enumerate(rules())])
    tried = F.filter(table, lambda r: words.contains(r["keyword"]))
    each = F.transform(tried, lambda r: F.transform(places(words, r["regex"]), lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), r["tier"].alias("tier"), r["rank"].alias("rank"), r["label"].alias("label"))))
    return F.flatten(each)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (label, start, stop) and found (start, stop, tier, rank, label) of every row of ``docs``.

    Places are words, from 0, ends exclusive; ``found`` has the detections that are left, in order. Rows stay one to
    one, those with equal or null ids too; a null or empty text has no words and nothing found.
    """
    text = F.col("text")
    rows = documents(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = let(normalised(text), lambda words: F.struct(_base(words).alias("base"), _detections(words).alias("found")))
    first = rows.select("row", "doc_id", F.regexp_count("text", F.lit(ANY_WORD)).cast("long").alias("n_words"), F.when(_may_hold(text), made).alias("made"))
    written = materialise(first.select("row", "doc_id", "n_words", F.coalesce("made.base", F.expr("cast(array() as array<struct<label: string, start: bigint, stop: bigint>>)")).alias("base"), F.coalesce("made.found", F.expr(f"cast(array() as {DETECTION})")).alias("found")))
    before = Window.partitionBy("row").orderBy("start", F.desc("stop"), "tier", "rank").rowsBetween(Window.unboundedPreceding, -1)
    spans = written.select("row", F.inline("found"))
    furthest = F.coalesce(*[F.when(F.col("tier") == t, F.max(F.when(F.col("tier") <= t, F.col("stop"))).over(before)) for t in CONFIDENCE])
    kept = spans.withColumn("furthest", furthest).where(F.col("furthest").isNull() | (F.col("furthest") < F.col("stop")))
    left = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "tier", "rank", "label"))).alias("left"))
    return written.select("row", "doc_id", "n_words", "base").join(left, "row", "left").select("doc_id", "n_words", "base", F.coalesce("left", F.expr(f"cast(array() as {DETECTION})")).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (that of the surest detection)."""
    labels = lambda *of: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(c, lambda x: x["label"]) for c in of]))), ",")
    sure = F.create_map(*[x for t, c in CONFIDENCE.items() for x in (F.lit(t), F.lit(c))])
    score = F.coalesce(F.array_max(F.transform("found", lambda d: sure[d["tier"]])), F.lit(0.0))
    starts = F.transform("base", lambda b: b["start"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("base").alias("base_labels"), labels("base", "found").alias("labels"), score.alias("score"),
    )
