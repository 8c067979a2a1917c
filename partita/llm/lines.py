"""Line dedup by a deletion-neighbourhood join. Built-in functions only.

Two lines are near when at most one character is inserted, deleted or replaced (``MAX_EDITS``), however short they are.
Of lines that are near, the earliest (by document id, then line number) is kept: a line is removed when the same line,
or a near one, occurs earlier. Blank lines are always kept.

1. Equal lines are counted together first, by 128 hash bits, so a line that a third of all documents hold is one row
   after the map-side combine.
2. Of two lines one edit apart, one half is the same in both. Lines that share no half hash with another one (four a
   line) have no near line and go no further; this loses nothing.
3. The others emit the deletion variants of the half that can differ as hashed keys. Keys of the first kind name the variant and the place of the
   deletion: all lines that share one differ in that place only. Keys of the second kind name the variant alone and
   meet the line that equals it. Either group holds at most one line for each letter and place, since lines are
   distinct by then, so no group grows with the data.
4. In a group of the first kind every line is paired with the earliest, in one of the second kind with the line that
   the variants equal. The edit distance of each pair is verified, and the later line of a pair that holds is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.llm.common import LAST_ID, documents, let, materialise

MAX_EDITS = 1
PLACE, VARIANT, ITSELF = 0, 1, 2


def _text_key(text: str) -> Column:
    """31 bits of a text, above its line numbers: they tell rows apart that share an id."""
    return F.shiftleft(F.xxhash64(text).bitwiseAND(2**31 - 1), 32)


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no and line of every line that is not blank; null texts have none.

    ``line_no`` has the line's number (from 0) in its lower half and bits of the text above.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), _text_key("text").alias("key"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return rows.where(F.trim("line") != "").select("doc_id", (F.col("key") + F.col("at")).alias("line_no"), "line")


def _keyed(lines: DataFrame) -> DataFrame:
    return lines.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _halves(line: Column, n: Column) -> Column:
    """Hashes of the halves that a near line of the same, the next or the last length would share."""

    def of(length: Column) -> list[Column]:
        half = F.floor(length / 2).cast("int")
        rest = (length - half).cast("int")
        return [F.xxhash64(length, F.lit(0), F.substring(line, F.lit(1), half)), F.xxhash64(length, F.lit(1), F.substring(line, n - rest + 1, rest))]

    return F.array(*of(n), *of(n - 1))


def _variants(line: Column, n: Column, early: Column, late: Column) -> Column:
    """Keys of a line's deletion variants: by variant and place, by variant alone, and the line itself.

    Only the half in which a near line can differ is varied: the places after the shared first half (``late``) or those
    before the shared second half (``early``), or both.
    """
    half = F.floor((n - 1) / 2).cast("int")
    first, last = F.when(early, 1).otherwise(half + 1), F.when(late, n).otherwise(n - half)
    # Deleting any of equal neighbours gives one variant; keys by variant alone are kept once.
    one = F.transform(F.sequence(first, last), lambda i: F.struct(i.alias("i"), F.xxhash64(F.concat(F.substring(line, F.lit(1), i - 1), F.substring(line, i + 1, n))).alias("v")))
    alone = lambda v, length: F.xxhash64(v, F.lit(-1), length)
    named = lambda key, role: F.struct(key.alias("key"), F.lit(role).alias("role"))
    itself = F.array(named(alone(F.xxhash64(line), n), ITSELF))
    return let(one, lambda x: F.concat(
        F.transform(x, lambda e: named(F.xxhash64(e["v"], e["i"], n), PLACE)),
        F.transform(F.array_distinct(F.transform(x, lambda e: alone(e["v"], n - 1))), lambda k: named(k, VARIANT)), itself,
    ))


def near_lines(lines: DataFrame) -> DataFrame:
    """doc_id and line_no of the first places of distinct lines to remove, for a line near an earlier one.

    ``lines`` has doc_id, line_no, line, h1, h2, one row for each place.
    """
    n = F.length("line")
    halves = _halves(F.col("line"), n)
    first = F.min(F.struct("doc_id", "line_no")).alias("at")
    distinct = materialise(lines.select("h1", "h2", "doc_id", "line_no", halves.alias("halves")).groupBy("h1", "h2").agg(first, F.first("halves").alias("halves")))
    keys = distinct.select("at", F.posexplode("halves").alias("which", "half"))
    # A half shared by two distinct lines has two different first places.
    shared = keys.groupBy("half").agg(F.min("at").alias("a"), F.max("at").alias("b")).where(F.col("a") != F.col("b")).select("half")
    first_half = F.col("which") % 2 == 0
    blocked = keys.join(shared, "half", "left_semi").groupBy("at").agg(F.bool_or(~first_half).alias("early"), F.bool_or(first_half).alias("late")).select("at.doc_id", "at.line_no", "early", "late")
    some = materialise(lines.select("doc_id", "line_no", "line").join(blocked, ["doc_id", "line_no"]).dropDuplicates(["doc_id", "line_no"]))

    keyed = _variants(F.col("line"), F.length("line"), F.col("early"), F.col("late"))
    emitted = some.select(F.struct("doc_id", "line_no").alias("at"), F.inline(keyed))
    role = lambda r: F.when(F.col("role") == r, F.col("at"))
    groups = emitted.groupBy("key").agg(F.array_sort(F.collect_set(role(PLACE))).alias("places"), F.collect_set(role(VARIANT)).alias("variants"), F.min(role(ITSELF)).alias("itself"))
    pair = lambda a, b: F.struct(a.alias("early"), b.alias("late"))
    same_place = F.transform(F.slice("places", F.lit(2), F.size("places")), lambda m: pair(F.col("places")[0], m))
    with_itself = F.when(F.col("itself").isNotNull(), F.transform("variants", lambda m: F.when(m < F.col("itself"), pair(m, F.col("itself"))).otherwise(pair(F.col("itself"), m))))
    pairs = groups.select(F.inline(F.concat(same_place, F.coalesce(with_itself, F.slice(same_place, 1, 0))))).distinct()
    early = some.select(F.struct("doc_id", "line_no").alias("early"), F.col("line").alias("early_line"))
    late = some.select(F.struct("doc_id", "line_no").alias("late"), F.col("line").alias("late_line"))
    checked = pairs.join(early, "early").join(late, "late")
    near = F.levenshtein("early_line", "late_line", MAX_EDITS)
    return checked.where((near >= 0) & (near <= MAX_EDITS)).select("late.doc_id", "late.line_no").distinct()


def dedup_lines(docs: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n_lines, n_removed of every document: ``text`` keeps the lines that have no earlier near line.

    The columns in ``keep`` are passed on.

    A null text stays null (0 lines), an empty text has one blank line and stays empty. Null ids count as the last
    ones. Rows that share an id follow each other by a hash of their texts; those with the same text too keep the same
    lines.
    """
    rows = documents(docs, keep=keep)
    keyed = _keyed(split_lines(rows.select("doc_id", "text")))
    firsts = keyed.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("at")).select("at.doc_id", "at.line_no")
    kept = firsts.join(near_lines(keyed), ["doc_id", "line_no"], "left_anti")
    low = F.lit(2**32 - 1)
    by_doc = kept.groupBy(F.col("doc_id").alias("kept_id"), F.col("line_no").bitwiseAND(F.lit(-(2**32))).alias("kept_key")).agg(F.collect_set(F.col("line_no").bitwiseAND(low).cast("int")).alias("kept"))
    joined = rows.join(by_doc, (F.coalesce("doc_id", F.lit(LAST_ID)) == F.col("kept_id")) & (_text_key("text") == F.col("kept_key")), "left")

    def rejoin(lines: Column) -> Column:
        blank = F.filter(F.transform(lines, lambda line, i: F.when(F.trim(line) == "", i)), lambda i: i.isNotNull())
        places = F.array_sort(F.array_distinct(F.concat(blank, F.array_intersect(F.coalesce("kept", F.expr("cast(array() as array<int>)")), F.sequence(F.lit(0), F.size(lines) - 1)))))
        return F.struct(F.array_join(F.transform(places, lambda i: lines[i]), "\n").alias("text"), F.size(lines).alias("n"), F.size(places).alias("kept"))

    made = joined.select("doc_id", *keep, F.when(F.col("text").isNotNull(), let(F.split("text", "\n", -1), rejoin)).alias("m"))
    return made.select("doc_id", *keep, F.col("m.text").alias("text"), F.coalesce("m.n", F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.col("m.n") - F.col("m.kept"), F.lit(0)).cast("long").alias("n_removed"))
