"""A fixed public vocabulary of pieces as an automaton, and dynamic programming over a trie of distinct words.

Words that share a prefix share its trie nodes, so what the program computes for a prefix is computed once. All nodes of
one depth are computed together in numpy.
"""

from __future__ import annotations

import functools

import numpy as np

WORD_START = "▁"


class Automaton:
    """A trie of pieces: `step` follows characters, `piece` is the id of the piece that ends in a state or -1."""

    def __init__(self, pieces: list[str]):
        nodes: dict[tuple[int, str], int] = {}
        ends = {}
        for i, piece in enumerate(pieces):
            at = 0
            for ch in piece:
                at = nodes.setdefault((at, ch), len(nodes) + 1)
            ends[at] = i
        keys = np.array([(a << 21) + ord(ch) for a, ch in nodes], np.int64)
        to = np.fromiter(nodes.values(), np.int64, len(nodes))
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]
        self.piece = np.full(len(nodes) + 1, -1, np.int64)
        for at, i in ends.items():
            self.piece[at] = i
        self.longest = max(map(len, pieces), default=0)

    def step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is none. states and chars are int64."""
        key = (states << 21) + chars
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model by id; control, unknown and byte pieces are empty strings."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return ["" if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) else sp.id_to_piece(i) for i in range(sp.get_piece_size())]


def codes(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of all items in a row, and where each item starts (and the end)."""
    flat = np.frombuffer("".join(items).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    starts = np.zeros(len(items) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, items), np.int64, len(items)), out=starts[1:])
    return flat, starts


def over_trie(auto: Automaton, items: list[str], first: np.ndarray, combine):
    """Values at the last node of each item of `items` (no empty ones).

    A node's value is a row of numbers, `first` at the root. combine(chars, ends) makes those of a depth: chars, the last
    character of each node; ends, a list of (rows, pieces, values): the nodes at which a piece ends, the pieces, and the
    values at the nodes where they begin.
    """
    flat, starts = codes(items)
    lens = np.diff(starts)
    out = np.zeros((len(items), len(first)))
    alive = np.arange(len(items))
    node = np.zeros(len(items), np.int64)  # of each item alive, among the nodes of the last depth
    value = first[None, :].astype(float)  # of the nodes of the last depth
    opened: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # by length so far: nodes, states, values at the begin
    depth = 0
    while len(alive):
        key, back = np.unique((node << 21) + flat[starts[alive] + depth], return_inverse=True)
        parent, chars = key >> 21, key & ((1 << 21) - 1)
        # what is open at the parents goes on with each child's character
        position = np.searchsorted(parent, np.arange(len(value) + 1))  # the children of a node are in a row
        grown = []
        for rows, states, values in [(np.arange(len(value)), np.zeros(len(value), np.int64), value), *opened]:
            n = position[rows + 1] - position[rows]
            pick = np.repeat(np.arange(len(rows)), n)
            child = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(position[rows], n)
            to = auto.step(states[pick], chars[child])
            ok = to >= 0
            if ok.any():
                grown.append((child[ok], to[ok], values[pick[ok]]))
        ends = []
        for rows, states, values in grown:
            p = auto.piece[states]
            ok = p >= 0
            ends.append((rows[ok], p[ok], values[ok]))
        value_new = combine(chars, ends, value[parent])
        done = lens[alive] == depth + 1
        out[alive[done]] = value_new[back[done]]
        alive, node = alive[~done], back[~done]
        # only nodes that some item goes through stay
        used, node = np.unique(node, return_inverse=True)
        at = np.full(len(value_new), -1)
        at[used] = np.arange(len(used))
        value = value_new[used]
        opened = [(at[r[k]], s[k], v[k]) for r, s, v in grown if len(k := np.flatnonzero(at[r] >= 0))]
        depth += 1
    return out
