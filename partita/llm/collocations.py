"""Phrase collocation mining by top-order marginalisation.

Every word of a piece starts a window: its lead columns are the next words, up to ``LENGTH`` in all, padded where the
piece ends. Only these longest windows are counted; Spark's ROLLUP sums them to the counts of all shorter phrases, since
a phrase occurs as often as a window starts with it. No n-gram of another length is ever made.

A phrase that occurs ``LEAST`` times has words, pairs and triples of words that do. So a first pass counts hashes of
words and of adjacent pairs, a second those of triples of frequent pairs, and what occurs often sets a bit of a table of
fixed size (``BITS``). A window is padded from the first word, pair or triple on whose bit is not set. This loses
nothing: hashes that meet only keep a window longer, and the counts are taken afterwards, from words.

All passes read texts in parts of some ``CHUNK`` bytes that end where a piece ends, and count within them before
anything is shuffled. Counts by lang and phrase are sums with a map-side combine, joins with the counts of parts of a
phrase are salted, and the first of a language are found by salt before they are ranked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partita.llm.common import materialise, slices

LENGTH = 5
LEAST = 100
TOP = 2000
#: A candidate goes if a longer one that holds it occurs at least this share (in hundredths) as often.
ABSORBED = 100
#: Binary logarithm of the bits of the table of frequent words and pairs: 8 MB.
BITS = 26
CHUNK = 4_000_000
#: Windows that a task holds before it combines them, and passes them on if half as many are left.
HELD = 1_000_000
SALT = 16
NO_LANGUAGE = "und"

BREAKS = b".,;:!?\n\x0b\x0c\r"
_BREAK = re.compile(rb"[.,;:!?\n-\r]")
_SPACED = bytes(10 if b in BREAKS else 32 if b == 9 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
WORDS = [f"w{k}" for k in range(1, LENGTH + 1)]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Texts of a language, joined by line feeds, some ``CHUNK`` bytes at once; longer ones are cut where pieces end."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            at = 0
            while len(text) - at > CHUNK:
                end = m.end() if (m := _BREAK.search(text, at + CHUNK)) else len(text)
                yield lang, text[at:end]
                at = end
            held.setdefault(lang, []).append(text[at:])
            size += len(text) - at
            if size >= CHUNK:
                yield from ((k, b"\n".join(v)) for k, v in held.items())
                held, size = {}, 0
    yield from ((k, b"\n".join(v)) for k, v in held.items())


def _words(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of the words in order, -1 where a piece ends, and the distinct words."""
    # Of bytes, lower() changes A-Z only. Ends of pieces become words of their own; of two spaces, an empty one is left.
    found = data.lower().translate(_SPACED).replace(b"\n", b" \n ").split(b" ")
    words = list(dict.fromkeys(found))
    number = {w: k for k, w in enumerate(w for w in words if w and w != b"\n")}
    ids = np.fromiter(map((number | {b"\n": -1, b"": -2}).__getitem__, found), np.int64, len(found))
    return ids[ids != -2], list(number)


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = (a ^ (a >> np.uint64(29))) * _MIX + b
    return mixed ^ (mixed >> np.uint64(32))


def _counted(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 65536].view(np.int64)), pa.array(counts[at : at + 65536])], ["h", "c"])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, c: how often the words and the adjacent pairs with a hash occur in a part."""
    for lang, data in _parts(batches):
        ids, words = _words(data)
        if not words:
            continue
        h = _hashes(lang, words)
        left, right = ids[:-1], ids[1:]
        near = (left >= 0) & (right >= 0)
        pairs, often = np.unique(left[near] * len(words) + right[near], return_counts=True)
        yield from _counted(h, np.bincount(ids[ids >= 0], minlength=len(words)))
        yield from _counted(_pair(h[pairs // len(words)], h[pairs % len(words)]), often)


class _Linked:
    """A part's words with what the table tells: which are frequent, and where a word may be followed by the next."""

    def __init__(self, lang: str, data: bytes, table: np.ndarray):
        self.ids, self.words = _words(data)
        self.h = _hashes(lang, self.words)
        self.good = (self.ids >= 0) & _set(table, self.h)[self.ids] if self.words else np.zeros(len(self.ids), bool)
        self.pair = np.zeros(len(self.ids) + LENGTH, bool)
        both = np.flatnonzero(self.good[:-1] & self.good[1:])
        self.pair[both] = _set(table, _pair(self.h[self.ids[both]], self.h[self.ids[both + 1]]))

    def triples(self) -> np.ndarray:
        """Where three words begin whose two pairs are frequent."""
        return np.flatnonzero(self.pair[:-1] & self.pair[1:])

    def triple_hashes(self, at: np.ndarray) -> np.ndarray:
        a, b, c = (self.h[self.ids[at + k]] for k in range(3))
        return _pair(_pair(a, b), c)


def _sketch_triples(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lang, data in _parts(batches):
        part = _Linked(lang, data, table)
        yield from _counted(*np.unique(part.triple_hashes(part.triples()), return_counts=True))


def _bits(counted: DataFrame, least: int, bits: int) -> np.ndarray:
    """The table: a bit for each hash (h) whose counts (c) reach ``least``; 2 ** ``bits`` bits at any size of the input."""
    often = counted.groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    slot = F.shiftright(F.col("h").bitwiseAND(2**bits - 1), 6).alias("slot")
    slots = often.select(slot, F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("held")).toArrow()
    table = np.zeros(2 ** (bits - 6), np.int64)
    table[slots.column("slot").to_numpy()] = slots.column("held").to_numpy()
    return table.view(np.uint64)


def frequent_bits(texts: DataFrame, least: int, bits: int) -> np.ndarray:
    """Bits of all words, adjacent pairs and triples that occur ``least`` times, and of few others."""
    pairs = _bits(texts.mapInArrow(_sketch, "h long, c long"), least, bits)
    shared = texts.sparkSession.sparkContext.broadcast(pairs)
    return pairs | _bits(texts.mapInArrow(lambda batches: _sketch_triples(batches, shared.value), "h long, c long"), least, bits)


def _set(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & np.uint64(len(table) * 64 - 1)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


class _Windows:
    """Longest windows of a task and their counts, as numbers: of the language and the words, 0 where padded."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {b"": 0}
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, lang: str, data: bytes) -> Iterator[pa.RecordBatch]:
        part = _Linked(lang, data, self.table)
        ids, v = part.ids, len(part.words)
        if not v:
            return
        triple = np.zeros_like(part.pair)
        at = part.triples()
        triple[at] = _set(self.table, part.triple_hashes(at))
        single = np.bincount(ids[part.good & ~part.pair[: len(ids)]], minlength=v)
        alone, start = np.flatnonzero(single), np.flatnonzero(part.pair)
        columns, open_ = [ids[start], ids[start + 1]], np.ones(len(start), bool)
        for k in range(2, LENGTH):
            open_ &= triple[start + k - 2]
            columns.append(np.where(open_, ids[np.minimum(start + k, len(ids) - 1)], v))
        used = np.unique(np.concatenate([alone, *columns]))
        if len(self.number) + len(used) >= 1 << 21:
            yield from self.emptied()
        known = np.zeros(v + 1, np.int64)
        known[used] = [self.number.setdefault(part.words[i], len(self.number)) if i < v else 0 for i in used.tolist()]
        own = self.number.setdefault(b"\n" + lang.encode(), len(self.number))  # no word has a line feed
        pad = np.zeros(len(alone) + 1, np.int64)
        w = [known[c] for c in columns]
        head, rest = (own << 42) + (w[0] << 21) + w[1], (w[2] << 42) + (w[3] << 21) + w[4]
        lone = (own << 42) + (np.append(known[alone], 0) << 21)
        rare = int((ids >= 0).sum() - part.good.sum())
        self.held.append((np.concatenate([head, lone]), np.concatenate([rest, pad]), np.concatenate([np.ones(len(head), np.int64), single[alone], [rare]])))
        self.size += len(head) + len(lone)
        if self.size > HELD:
            self._combine()
            if self.size > HELD // 2:
                yield from self.emptied()

    def _combine(self) -> None:
        head, rest, n = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((rest, head))
        head, rest, n = head[order], rest[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (rest[1:] != rest[:-1])]))
        self.held, self.size = [(head[first], rest[first], np.add.reduceat(n, first))], len(first)

    def emptied(self) -> Iterator[pa.RecordBatch]:
        """lang, w1 to w5 (empty where padded) and c of the distinct windows so far."""
        if self.held:
            self._combine()
            (head, rest, n), names, low = self.held[0], pa.array(list(self.number), pa.binary()), (1 << 21) - 1
            for at in range(0, len(n), 65536):
                h, r = head[at : at + 65536], rest[at : at + 65536]
                places = [h >> 42, (h >> 21) & low, h & low, r >> 42, (r >> 21) & low, r & low]
                yield pa.RecordBatch.from_arrays([*(names.take(pa.array(x)) for x in places), pa.array(n[at : at + 65536])], ["lang", *WORDS, "c"])
        self._clear()


def phrase_counts(docs: DataFrame, *, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """lang, length, phrase, words, a: all phrases of 1 to ``LENGTH`` words that occur ``least`` times, and with length 0
    the number of words of each language."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    table = texts.sparkSession.sparkContext.broadcast(frequent_bits(texts, least, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows(table.value)
        for lang, data in _parts(batches):
            yield from windows.add(lang, data)
        yield from windows.emptied()

    schema = f"lang binary, {', '.join(f'{w} binary' for w in WORDS)}, c long"
    made = texts.mapInArrow(run, schema).withColumn("lang", F.expr("substring(cast(lang as string), 2)"))
    longest = made.groupBy("lang", *WORDS).agg(F.sum("c").alias("c"))
    rolled = longest.rollup("lang", *WORDS).agg(F.sum("c").alias("a"), F.grouping_id().alias("level"))
    length = (LENGTH - F.bit_count("level")).cast("int")  # summed-up columns have their bits set, from the last on
    sized = rolled.where(F.col("level") < 2**LENGTH).select("lang", length.alias("length"), F.array(*[F.col(w).cast("string") for w in WORDS]).alias("padded"), "a")
    whole = (F.col("length") == 0) | ((F.col("a") >= least) & (F.element_at("padded", F.greatest(F.col("length"), F.lit(1))) != ""))
    kept = sized.where(whole).select("lang", "length", F.slice("padded", F.lit(1), F.col("length")).alias("words"), "a")
    return kept.select("lang", "length", F.array_join("words", " ").alias("phrase"), "words", "a")


def _inner(words: Column, length: Column) -> Column:
    """Shorter phrases of two words or more inside a phrase."""
    at = F.transform(F.sequence(F.lit(2), length - 1), lambda n: F.transform(F.sequence(F.lit(1), length - n + 1), lambda s: F.array_join(F.slice(words, s, n), " ")))
    return F.array_distinct(F.flatten(at))


def _with_part(rows: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """``rows`` with the count of the phrase in ``part``; a part that many phrases share is dealt by salt."""
    salted = counts.select(F.col("lang"), F.col("phrase").alias(part), F.col("a").alias(name), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)).cast("int")).join(salted, ["lang", part, "salt"]).drop("salt")


def collocations(docs: DataFrame, *, least: int = LEAST, top: int = TOP, absorbed: int = ABSORBED, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the first ``top`` phrases of 2 to 5 words.

    score = floor(1000 * a * n / (l * r)) of the cut with the lowest score, the first of equals; ranked by score, then
    a, both descending, then phrase by its UTF-8 bytes. A null text counts as empty, a null lang as ``und``; rows count
    as often as they are there; an empty table, or one without a frequent phrase, gives no rows.
    """
    counts = materialise(phrase_counts(docs, least=least, bits=bits))
    totals = materialise(counts.where("length = 0").select("lang", F.col("a").alias("n")))
    known = counts.where("length > 0").select("lang", "phrase", "a")
    candidates = counts.where("length > 1")
    longest = candidates.where("length > 2").select("lang", F.explode(_inner(F.col("words"), F.col("length"))).alias("phrase"), F.col("a").alias("longer"))
    inside = longest.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = candidates.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < absorbed * F.col("a"), F.lit(True)))
    cuts = free.select("lang", "phrase", "a", "words", "length", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    head = F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head")
    tail = F.array_join(F.slice("words", F.col("k") + 1, F.col("length") - F.col("k")), " ").alias("tail")
    parted = _with_part(_with_part(cuts.select("lang", "phrase", "a", "k", head, tail), known, "head", "l"), known, "tail", "r").join(totals, "lang")
    score = F.expr("cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = parted.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    rows = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
