"""Mixing sources to target weights by hash-threshold histograms.

Every document has 60 hash bits. A source's budget becomes a hash threshold: words are summed by source and by the
highest 12 bits, the bucket in which the budget ends is found from at most 4096 sums, and only that bucket is summed
again by its next 12 bits, down to single hashes. Documents are then filtered by comparing hashes; none are sorted.

Targets share all words by the weights 5, 2, 1 (repeating over the sources in code point order, null last) and stop
at ``MAX_REPEATS`` times a source's own words; the excess goes to the others by weight until no target is above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.llm.common import WORD, documents, hash60, materialise

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
LEVEL_BITS = 12
LEVELS = 5


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; null text: 0) and h (60 bits of the id)."""
    return documents(docs, keep=("source",)).select("doc_id", F.col("source").cast("string").alias("source"), _size("text").alias("size"), hash60("doc_id").alias("h"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: source, source_size, target. Whole numbers decide who is capped, so engines agree.

    Sources in ascending order of cap over weight are capped as long as their share of what is left exceeds the cap;
    this is where repeated resharing ends.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (place + 1).cast("int"))
    cap = F.col("source_size") * max_repeats
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = sums.withColumn("weight", weight).select("*", left.alias("left"), weight_left.alias("weight_left"))
    capped = ranked.withColumn("capped", cap * F.col("weight_left") <= F.col("weight") * F.col("left"))
    free = F.sum("source_size").over(everything) - F.sum(F.when(F.col("capped"), cap).otherwise(0)).over(everything)
    free_weight = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything)
    share = (F.col("weight") * free).cast("double") / free_weight.cast("double")
    return capped.select("source", "source_size", F.when(F.col("capped"), cap.cast("double")).otherwise(share).alias("target"))


def _same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per source: the target, ``whole`` repeats of every document, and the boundary of one more.

    Documents with h < ``bound`` get one repeat more; those with h = ``bound`` share the ``rest`` words that are left
    of the budget (``bound_size`` words carry that hash, nearly always those of one document).
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = wanted.withColumn("whole", whole).select(
        "source", "source_size", "target", "whole",
        F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long").alias("rest"),
        F.lit(0).cast("long").alias("bound"), F.lit(0).cast("long").alias("bound_size"),
    )
    state = materialise(state)
    for level in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - level)
        inside = sized.alias("d").join(state.alias("s"), _same_source("d", "s") & (F.shiftright("d.h", shift + LEVEL_BITS) == F.col("s.bound")))
        histogram = inside.groupBy("d.source", F.shiftright("d.h", shift).alias("bucket")).agg(F.sum("d.size").alias("words"))
        running = Window.partitionBy("source").orderBy("bucket")
        histogram = histogram.withColumn("upto", F.sum("words").over(running)).alias("b")
        # The budget ends in the first bucket whose running sum exceeds it.
        over = histogram.join(state.select("source", "rest").alias("s"), _same_source("b", "s") & (F.col("b.upto") > F.col("s.rest")))
        ends = over.groupBy("b.source").agg(F.min(F.struct("b.bucket", "b.words", "b.upto")).alias("e")).alias("e")
        state = materialise(
            state.alias("s").join(ends, _same_source("s", "e"), "left").select(
                "s.source", "s.source_size", "s.target", "s.whole",
                F.coalesce(F.col("s.rest") - (F.col("e.e.upto") - F.col("e.e.words")), F.lit(0)).alias("rest"),
                F.coalesce(F.col("e.e.bucket"), F.lit(-1)).alias("bound"),
                F.coalesce(F.col("e.e.words"), F.lit(0)).alias("bound_size"),
            )
        )
    return state


def _extra(d: str, s: str) -> Column:
    """Words of one more repeat that a document gives: all below the boundary, a share of the rest at it."""
    part = F.floor(F.col(f"{s}.rest") * F.col(f"{d}.size") / F.col(f"{s}.bound_size"))
    at_bound = (F.col(f"{d}.h") == F.col(f"{s}.bound")) & (F.col(f"{s}.bound_size") > 0)
    return F.when(F.col(f"{d}.h") < F.col(f"{s}.bound"), F.col(f"{d}.size")).when(at_bound, part).otherwise(0).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, whole (full repeats) and extra (words of one more repeat).

    ``whole * size + extra`` words of a document are taken: at most ``MAX_REPEATS`` times its size, and over a source
    its target rounded down. A null or empty text has size 0 and takes 0; a null source is a source of its own; rows
    that share an id share its hash and are treated alike; an empty table gives an empty result.
    """
    sized = materialise(measure(docs))
    state = thresholds(sized, targets(sized))
    joined = sized.alias("d").join(state.alias("s"), _same_source("d", "s"))
    return joined.select("d.doc_id", "d.source", "d.size", "s.source_size", "s.target", "s.whole", _extra("d", "s").alias("extra"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, with its columns: none, or up to ``MAX_REPEATS`` times.

    ``docs`` has doc_id, text and source. A document at its source's boundary gives its first words only; its text is
    then cut after them. Thresholds are compared with each row where it is read, so no text is shuffled.
    """
    sized = materialise(measure(docs))
    state = thresholds(sized, targets(sized))
    rows = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("source"), _size("text").alias("size"), hash60("doc_id").alias("h"))
    joined = rows.alias("d").join(state.alias("s"), _same_source("d", "s"))
    taken = joined.select("row", "d.size", "whole", _extra("d", "s").alias("extra")).withColumn("repeats", (F.col("whole") + (F.col("extra") > 0).cast("long")).cast("int"))
    every = taken.where((F.col("repeats") > 0) & (F.col("size") > 0)).select("*", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("repeat"))
    first_words = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("extra").cast("int")), "")
    cut = (F.col("repeat") > F.col("whole")) & (F.col("extra") < F.col("size"))
    return every.select(*[(F.when(cut, first_words).otherwise(F.col("row.text")) if c == "text" else F.col(f"row.{c}")).alias(c) for c in docs.columns])
