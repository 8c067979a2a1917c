"""What a worker keeps between tasks, and when it goes."""

from __future__ import annotations

import gc
import random
import weakref

import pytest

from partita.llm import sentencepiece_codec as sc


@pytest.fixture(scope="module")
def shared_with_texts():
    shared = sc._Shared(sc.read_vocabulary())
    draw = random.Random(3)
    texts = [" ".join("".join(draw.choices("abcdeilmnorstuäé", k=draw.randint(1, 12))) for _ in range(200)) for _ in range(40)]
    return shared, texts, shared.vocabulary().encode(texts)


def test_transitions_to_a_state_are_one_of_two_objects(shared_with_texts):
    states = shared_with_texts[0].vocabulary().states.values()
    told = [id(said) for state in states for said in state.values()]
    n, different, most = len(told), len(set(told)), 2 * len(states)
    assert n > 2 * different  # each was an object of its own
    assert different <= most


def test_answers_that_only_tell_kinds_apart_are_not_kept(shared_with_texts):
    nodes, kept, kinds = [shared_with_texts[0].vocabulary().root], 0, 0
    while nodes:
        node = nodes.pop()
        kept, kinds = kept + len(node.apart or ()), kinds + len(node.kinds or ())
        nodes += node.below.values()
    assert kept < 2 * kinds  # it was some nine for each kind


def test_a_vocabulary_starts_anew_after_it_forgot(shared_with_texts):
    shared, texts, ids = shared_with_texts
    vocabulary = shared.vocabulary()
    vocabulary.known, vocabulary.older = {}, {}
    vocabulary._forget()
    assert vocabulary.encode(texts) == ids
    assert ids[:3] == [sc.array("i", [vocabulary.ids[p] for p in sc.merge(sc.SPACE + t.replace(" ", sc.SPACE), vocabulary.ranks)]).tobytes() for t in texts[:3]]


def test_a_vocabulary_goes_with_its_broadcast_without_a_collector():
    shared = sc._Shared(sc.read_vocabulary())
    shared.vocabulary().encode(["one text and another", None, ""])
    there = weakref.ref(shared.vocabulary())
    gc.disable()
    try:
        del shared
        gone = there() is None
    finally:
        gc.enable()
    assert gone
