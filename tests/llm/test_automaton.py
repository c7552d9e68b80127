"""The tokenization automaton on small lists of merges, against plain byte-pair encoding."""

import itertools

import numpy as np
import pytest

from colloquy.llm.bpe import Automaton


def merged(letters, merges):
    """Ids by the rule: the earliest merge that applies joins all its pairs, from the left, until none applies."""
    parts = list(letters)
    for left, right in merges:  # a merge can't apply again once it has been passed
        i = 0
        while i < len(parts) - 1:
            if parts[i] == left and parts[i + 1] == right:
                parts[i : i + 2] = [left + right]
            i += 1
    return parts


LISTS = [
    [("a", "b"), ("ab", "a"), ("b", "c"), ("aba", "bc")],
    [("a", "a"), ("aa", "a"), ("b", "aa"), ("aa", "aa")],
    [("b", "a"), ("a", "b"), ("ba", "ba"), ("ab", "c"), ("c", "ba"), ("baba", "c")],
    [("c", "c"), ("a", "cc"), ("cc", "cc"), ("b", "a"), ("ba", "cc"), ("acc", "b")],
]


def automaton(merges):
    tokens = ["a", "b", "c", *dict.fromkeys(x + y for x, y in merges)]
    return Automaton({t: i for i, t in enumerate(tokens)}, merges), tokens


@pytest.mark.parametrize("merges", LISTS)
def test_every_arc(merges):
    """An arc is left exactly where the two tokens, spelt out together, are encoded as themselves; of tokens that some
    word is encoded to, as all of a trained list are."""
    machine, tokens = automaton(merges)
    real = [(i, t) for i, t in enumerate(tokens) if merged(t, merges) == [t]]
    for (x, a), (y, b) in itertools.product(real, repeat=2):
        assert machine.arc(x, y) == (merged(a + b, merges) == [a, b]), (a, b)


@pytest.mark.parametrize("merges", LISTS)
def test_every_short_word(merges):
    machine, tokens = automaton(merges)
    for n in range(8):
        for word in itertools.product("abc", repeat=n):
            assert [tokens[i] for i in machine.encode(list(word))] == merged(word, merges), word


def test_random_merges():
    rng = np.random.default_rng(9)
    for _ in range(30):
        tokens, merges = ["a", "b", "c"], []
        while len(merges) < 9:
            pair = (tokens[rng.integers(len(tokens))], tokens[rng.integers(len(tokens))])
            if pair[0] + pair[1] not in tokens and len(pair[0] + pair[1]) < 7:
                merges.append(pair)
                tokens.append(pair[0] + pair[1])
        # as a trained list: every token can be made from its letters
        made = [m for m in merges if merged(m[0] + m[1], merges) == [m[0] + m[1]]]
        if len(made) < len(merges):
            continue
        machine, names = automaton(merges)
        for _ in range(60):
            word = [str(c) for c in rng.choice(list("abc"), rng.integers(1, 14))]
            assert [names[i] for i in machine.encode(word)] == merged(word, merges), (merges, word)
