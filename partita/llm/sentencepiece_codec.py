"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The model is of the BPE kind, for which the admissible path is not the one of the largest sum of scores but the one
that the merges would leave. The pass goes over a text character by character. For every position it keeps one
backpointer: the only vocabulary piece that can end there next to the piece before it (``_Vocabulary.stays_apart``
says if merges ever cross the boundary of two pieces). What survives are the positions from which a piece may still
grow, each with its place in the trie of all pieces: no more than the longest piece has characters. As soon as the
paths from all of them meet in one boundary, the ids before it are committed and forgotten.

Which positions survive depends on the state and the next character alone, so transitions are remembered by those
two. The commonest meeting is in front of a space or a line end, with one state; ids from one such boundary to the next
are remembered by their characters as well. Either memory is bounded and makes room for what is used again.

Ids equal those of the sentencepiece library; decoding gives the text back, except that U+2581, by which the format
itself writes a space, comes back as a space.
"""

from __future__ import annotations

import gc
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from partita.llm.common import documents, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NEVER = float("inf")
#: Characters in front of which paths mostly meet, and what follows up to the next of them.
STOPS = (SPACE, "\n")
AHEAD = re.compile(f".[^{SPACE}\n]*", re.DOTALL)
#: Parts and transitions that a worker remembers, and the longest such part.
REMEMBERED = 150_000
TRANSITIONS = 300_000
LONGEST = 48
#: Pieces below a place in the trie up to which states that differ in nothing that matters are one.
FEW = 32


def read_vocabulary(path: str = MODEL) -> dict:
    """Pieces with ids and merge ranks, byte pieces, and how each piece comes about; a few MB at most."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    known = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    ids = {model.id_to_piece(i): i for i in known}
    ranks = {model.id_to_piece(i): -model.get_score(i) for i in known}
    made = {}
    for piece in ids:
        parts: list[tuple[str, str]] = []
        if len(piece) > 1 and merge(piece, ranks, parts) == [piece]:
            made[piece] = parts[-1]
    raw = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
    return {"ids": ids, "ranks": ranks, "made": made, "raw": raw, "unknown": model.unk_id(), "pieces": _pieces(model, known, n)}


def _pieces(model, known: list[int], n: int) -> list[str]:
    named = [""] * n
    for i in known:
        named[i] = model.id_to_piece(i)
    return named


def merge(text: str, ranks: dict[str, float], parts: list | None = None) -> list[str]:
    """BPE by its definition: always the adjacent pair of the lowest rank, the leftmost of equals."""
    symbols, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
    queue = [(ranks[p], i, p) for i in range(len(text) - 1) if (p := text[i : i + 2]) in ranks]
    heapq.heapify(queue)
    while queue:
        _, i, pair = heapq.heappop(queue)
        j = after[i]
        if not symbols[i] or j >= len(symbols) or symbols[i] + symbols[j] != pair or len(symbols[j]) == 0:
            continue
        if parts is not None:
            parts.append((symbols[i], symbols[j]))
        symbols[i], symbols[j], after[i] = pair, "", after[j]
        if after[i] < len(symbols):
            before[after[i]] = i
            if (p := pair + symbols[after[i]]) in ranks:
                heapq.heappush(queue, (ranks[p], i, p))
        if before[i] >= 0 and (p := symbols[before[i]] + pair) in ranks:
            heapq.heappush(queue, (ranks[p], before[i], p))
    return [s for s in symbols if s]


class _Node:
    """A place in the trie of all pieces, with what is known of the pieces before it."""

    __slots__ = ("apart", "below", "ends", "firsts", "ids", "kinds", "text", "whole")

    def __init__(self, text: str, ids: bytes = b""):
        self.text, self.ids, self.below, self.whole = text, ids, {}, len(text) == 1
        self.ends: list[_Node] | None = None
        self.forget()

    def forget(self) -> None:
        self.apart: dict[str, bool] | None = None
        self.kinds: dict[str, str] | None = None
        self.firsts: dict[bytes, str] | None = None


class _State(dict):
    """Transitions by character: state after it, length and ids of the piece that ends there, and if paths meet before.

    ``walks`` is what may still grow: in turn the piece that ends before it and its place in the trie, the longest first.
    The last of them is the piece that ends here, so all transitions to a state are one of two.
    """

    __slots__ = ("joined", "meets", "met", "of", "walks")

    def __init__(self, of: _Vocabulary, walks: tuple):
        self.of, self.walks, self.meets = of, walks, None
        self.joined = self.met = None

    def reached(self, length: int, ids: bytes, meet: bool) -> tuple[_State, int, bytes, bool]:
        """The transition to this state, the same object wherever it starts."""
        said = self.met if meet else self.joined
        if said is None:
            said = (self, length, ids, meet)
            if meet:
                self.met = said
            else:
                self.joined = said
        return said

    def forget(self) -> None:
        self.clear()
        self.joined = self.met = None

    def __missing__(self, c: str) -> tuple[_State, int, bytes, bool]:
        said = self[c] = self.of.step(self, c)
        return said


class _Vocabulary:
    """The tables of one model, with what a worker has remembered."""

    def __init__(self, tables: dict):
        self.ids, self.ranks, self.made, self.raw = tables["ids"], tables["ranks"], tables["made"], tables["raw"]
        self.unknown, self.pieces = tables["unknown"], tables["pieces"]
        self.window = max(map(len, self.ranks), default=1)
        self.root = _Node("")
        for piece in self.ranks:
            at = self.root
            for k, c in enumerate(piece, 1):
                if c not in at.below:
                    at.below[c] = _Node(piece[:k], self._ids(piece[:k]))
                at = at.below[c]
            at.whole = at.whole or piece in self.made
        self.formed: dict[str, float] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.states: dict[tuple, _State] = {}
        self.answers = self.meetings = self.widest = 0
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.start = self._state(None, self.root)
        # A byte below 128 is a character by itself; longer ones are put together from runs of byte pieces.
        back = {i: b for b, i in self.raw.items()}
        self.pieces = [chr(b) if (b := back.get(i, 255)) < 128 else p for i, p in enumerate(self.pieces)] if back else self.pieces
        self.bytes_of = {i: b for i, b in back.items() if b >= 128}
        self.is_byte = np.isin(np.arange(len(self.pieces)), list(self.bytes_of))

    def when(self, piece: str) -> float:
        """The largest rank among the merges that make a piece."""
        if (t := self.formed.get(piece)) is None:
            t = max(self.ranks[piece], *map(self.when, self.made[piece])) if piece in self.made else -1.0
            self.formed[piece] = t
        return t

    def spine(self, piece: str, side: int) -> list[tuple[str, float, float]]:
        """Outermost piece after outermost piece on one side: text, rank, and when the part joined to it is ready."""
        if (known := self.spines[side].get(piece)) is None:
            steps, at = [], piece
            while at in self.made:
                steps.append((at, self.ranks[at], self.when(self.made[at][1 - side])))
                at = self.made[at][side]
            known = self.spines[side][piece] = [(at, NEVER, NEVER), *reversed(steps), ("", NEVER, NEVER)]
        return known

    def stays_apart(self, left: str, right: str) -> bool:
        """True if merges that make both pieces are all done before any could join them across their boundary.

        Both sides grow merge by merge; the lower rank goes first, the leftmost of equals, and a merge waits for the
        part it joins. The pair is broken if a piece made across the boundary has its turn before both are whole. Runs
        of spaces have equal ranks throughout, so of two of them the leftmost merge goes first, as the definition has it.
        """
        if left[-1] == right[-1] == SPACE:
            return merge(left + right, self.ranks) == [left, right]
        lefts, rights, ranks = self.spine(left, 1), self.spine(right, 0), self.ranks
        i = j = 0
        clock = -1.0
        while True:
            across = ranks.get(lefts[i][0] + rights[j][0], NEVER)
            _, a, ready = lefts[i + 1]
            if ready > clock and ready > a:
                a = ready
            _, b, ready = rights[j + 1]
            if ready > clock and ready > b:
                b = ready
            if across < a and across <= b and across != NEVER:
                return False
            if a == b == NEVER:
                return True
            if a <= b:
                i += 1
                clock = max(clock, a)
            else:
                j += 1
                clock = max(clock, b)

    def _state(self, *walks: str | _Node | None) -> _State:
        if (state := self.states.get(walks)) is None:
            state = self.states[walks] = _State(self, walks)
        return state

    def step(self, state: _State, c: str) -> tuple[_State, int, bytes, bool]:
        grown, piece, ids, meet = [], None, b"", True
        for left, node in zip(state.walks[::2], state.walks[1::2]):
            if (below := node.below.get(c)) is None:
                continue
            meet = meet and node is self.root
            if piece is None and below.whole and (left is None or self._apart(left, below)):
                piece, ids = below.text, below.ids
            if below.below:
                grown.append((left, below))
        if piece is None:
            piece, ids = c, self._ids(c)
        # Where no piece reaches across, what is before says nothing about what follows.
        walks = [x for left, below in grown for x in (None if meet else self._kind(left, below), below)]
        self.answers += 1
        return self._state(*walks, piece, self.root).reached(len(piece), ids, meet)

    def _apart(self, left: str, node: _Node) -> bool:
        if node.apart is None:
            node.apart = {}
        if (said := node.apart.get(left)) is None:
            said = node.apart[left] = self.stays_apart(left, node.text)
        return said

    def _kind(self, left: str | None, node: _Node) -> str | None:
        """Of the pieces before a place, one that stays apart from the same pieces below it, if those are few."""
        if node.ends is None:
            node.ends, todo = [], list(node.below.values())
            while todo:
                at = todo.pop()
                todo += at.below.values()
                if at.whole:
                    node.ends.append(at)
            if len(node.ends) > FEW:
                node.ends = []
        if left is None or not node.ends:
            return left
        if node.kinds is None:
            node.kinds, node.firsts = {}, {}
        if (kind := node.kinds.get(left)) is None:
            # Answers that only tell kinds apart are not kept: they are many, and few are asked again.
            said = bytes([self.stays_apart(left, end.text) for end in node.ends])
            kind = node.kinds[left] = node.firsts.setdefault(said, left)
        return kind

    def _meets(self, state: _State) -> bool:
        """True if paths meet at the end of a text that leads to a state, whatever stop follows."""
        if state.meets is None:
            state.meets = all(state[c][3] for c in STOPS)
        return state.meets

    def _walk(self, text: str, at: int) -> tuple[bytes, int, _State]:
        """Ids from a boundary on to the next one before a space or line end, that boundary, and the state there.

        ``back`` has the transition to each place since the last boundary. If no boundary came for two windows, the
        paths of all that survive are followed back to where they meet.
        """
        state, base, out, back, most = self.start, at, [], [], 2 * self.window
        for at in range(at, len(text)):
            said = state[text[at]]
            if said[3] and at > base:
                out += self._committed(back, at - base)
                if text[at] in STOPS:
                    return b"".join(out), at, state
                base, back = at, []
            elif len(back) >= most:
                alive = [len(back) - len(node.text) for node in state.walks[1::2]]
                if (met := max(set.intersection(*(set(self._path(back, p)) for p in alive)))) > 0:
                    out += self._committed(back, met)
                    base, back = base + met, back[met:]
            back.append(said)
            state = said[0]
        return b"".join(out + self._committed(back, len(back))), len(text), state

    def _committed(self, back: list, at: int) -> list[bytes]:
        """The ids of the path up to a place on which all that survive agree."""
        self.meetings += 1
        if len(back) > self.widest:
            self.widest = len(back)
        out = []
        while at > 0:
            _, length, ids, _ = back[at - 1]
            out.append(ids)
            at -= length
        out.reverse()
        return out

    @staticmethod
    def _path(back: list, at: int) -> list[int]:
        path = [at]
        while at > 0:
            at -= back[at - 1][1]
            path.append(at)
        return path

    def _ids(self, piece: str) -> bytes:
        if (i := self.ids.get(piece)) is not None:
            return array("i", [i]).tobytes()
        return array("i", [self.raw.get(b, self.unknown) for b in piece.encode()]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of each text as 32-bit numbers."""
        if self.answers > TRANSITIONS:
            self._forget()
        collects = gc.isenabled()
        gc.disable()  # nothing below makes garbage in circles, and what is remembered is much to go through
        try:
            return [None if t is None else self._encode(SPACE + t.replace(" ", SPACE)) if t else b"" for t in texts]
        finally:
            if collects:
                gc.enable()

    def close(self) -> None:
        """Ends what refers to itself, so that a vocabulary goes with the last reference to it."""
        for state in self.states.values():
            state.forget()  # states know each other
        self.states, self.start = {}, None

    def _forget(self) -> None:
        self.close()
        self.spines, self.answers = ({}, {}), 0
        nodes = [self.root]
        while nodes:
            node = nodes.pop()
            node.forget()
            nodes += node.below.values()
        self.start = self._state(None, self.root)

    def _encode(self, text: str) -> bytes:
        """All ids of a text: from boundary to boundary, by what is remembered or by a walk."""
        out, done, past = [], 0, 0
        for part in AHEAD.findall(text):
            if done >= past:  # else a walk went on through this part
                ids = self.known.get(part)
                if ids is None:
                    ids, past = self._learned(part, text, done)
                out.append(ids)
            done += len(part)
        return b"".join(out)

    def _learned(self, part: str, text: str, at: int) -> tuple[bytes, int]:
        """Ids from a boundary on and where they end; remembered if paths meet after ``part`` whatever stop follows."""
        if (ids := self.older.get(part)) is None:
            ids, end, state = self._walk(text, at)
            if end != at + len(part) or len(part) > LONGEST or not self._meets(state):
                return ids, end
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        self.known[part] = ids
        return ids, at + len(part)

    def decode(self, ids: np.ndarray) -> str:
        pieces = self.pieces
        text = "".join(map(pieces.__getitem__, ids.tolist()))
        if (at := self.is_byte[ids]).any():
            chunks, start = [], 0
            edges = np.flatnonzero(np.diff(np.concatenate([[0], at.view(np.int8), [0]])))
            for a, b in edges.reshape(-1, 2):
                chunks += ["".join([pieces[i] for i in ids[start:a].tolist()]), bytes(self.bytes_of[i] for i in ids[a:b].tolist()).decode(errors="replace")]
                start = b
            text = "".join([*chunks, *[pieces[i] for i in ids[start:].tolist()]])
        return text.replace(SPACE, " ").removeprefix(" ")


    def decode_all(self, column: pa.ListArray) -> list[str | None]:
        values, ends, null = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
        return [None if null[k] else self.decode(values[ends[k] : ends[k + 1]]) for k in range(len(column))]


def _listed(codes: list[bytes | None]) -> pa.ListArray:
    """Ids as an Arrow column."""
    ends = np.cumsum([0] + [len(c or b"") // 4 for c in codes], dtype=np.int64)
    values = pa.array(np.frombuffer(b"".join([c or b"" for c in codes]), np.int32))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values, mask=pa.array([c is None for c in codes]))


class _Shared:
    """The tables as they are sent, and in a worker the vocabulary made of them: kept from task to task, with all that it
    remembers, for as long as the worker's tasks have this broadcast. Then all of it goes at once, back to the system."""

    def __init__(self, tables: dict):
        self.__setstate__(tables)

    def __getstate__(self) -> dict:
        return self.tables

    def __setstate__(self, tables: dict) -> None:
        self.tables, self.made = tables, None

    def vocabulary(self) -> _Vocabulary:
        if self.made is None:
            self.made = _Vocabulary(self.tables)
        return self.made

    def __del__(self):
        if self.made is not None:
            self.made.close()
            self.made = None
            pa.system_memory_pool().release_unused()


def _sent(docs: DataFrame, path: str) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(_Shared(read_vocabulary(path)))


def encode(docs: DataFrame, *, model: str = MODEL) -> DataFrame:
    """doc_id, text, ids (array of int) of every whole text.

    A null text has null ids and an empty text none; the rows of ``docs`` stay one to one, repeated rows included.
    """
    shared = _sent(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.vocabulary()
        for batch in slices(batches):
            ids = _listed(vocabulary.encode(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), ids], ["doc_id", "text", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, *, model: str = MODEL) -> DataFrame:
    """The columns of ``encoded`` and ``decoded``, the text that its ids stand for (null for null).

    A column of that name is replaced.
    """
    encoded = encoded.drop("decoded")
    shared = _sent(encoded, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.vocabulary()
        for batch in slices(batches):
            texts = vocabulary.decode_all(batch.column("ids"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes) + ", decoded string")


def round_trip(docs: DataFrame, *, model: str = MODEL) -> DataFrame:
    """doc_id, ids, decoded and round_trip: whether a text's ids stand for it again, the mark of a space read as a space.

    Texts are decoded within the batch that encodes them, so one process does both and the text is sent once. Null texts
    have null ids and come back as null.
    """
    shared = _sent(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.vocabulary()
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            ids = _listed(vocabulary.encode(texts))
            back = vocabulary.decode_all(ids)
            same = [d == (t if t is None else t.replace(SPACE, " ")) for d, t in zip(back, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(back, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "ids", "decoded", "round_trip"])

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string, round_trip boolean")
