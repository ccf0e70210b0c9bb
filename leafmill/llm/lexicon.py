"""A minimal acyclic transducer from words to token ids, in flat arrays.

Words with the same continuations share their suffix states. Every arc carries
an output; the outputs on a word's path add up to the word's row in a table of
ids. Arcs lie in a double array: the arc of state s for byte b is slot
``base[s] + b``, valid if ``owner[slot] == s``. All arrays are one file that any
number of processes map, and words are looked up many at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

MAGIC = 0x4C455831
PARTS = ("base", "final", "owner", "target", "output", "offsets", "ids")


class _Builder:
    """States of a minimal automaton, made from words in ascending order."""

    def __init__(self) -> None:
        self.arcs: list[dict[int, int] | None] = [{}]  # None: an equal state stands for it
        self.ends: list[bool] = [False]
        self.register: dict[tuple, int] = {}
        self.path: list[tuple[int, int, int]] = []  # (state, byte, child) of the last word, not yet shared
        self.last = b""

    def add(self, word: bytes) -> None:
        common = 0
        for a, b in zip(word, self.last, strict=False):
            if a != b:
                break
            common += 1
        self._share(common)
        state = self.path[-1][2] if self.path else 0
        for byte in word[common:]:
            child = len(self.arcs)
            self.arcs.append({})
            self.ends.append(False)
            self.arcs[state][byte] = child
            self.path.append((state, byte, child))
            state = child
        self.ends[state] = True
        self.last = word

    def _share(self, keep: int) -> None:
        while len(self.path) > keep:
            state, byte, child = self.path.pop()
            key = (self.ends[child], *self.arcs[child].items())
            same = self.register.setdefault(key, child)
            self.arcs[state][byte] = same
            if same != child:
                self.arcs[child] = None

    def finish(self) -> None:
        self._share(0)
        self.register.clear()


def compile_lexicon(words: Sequence[bytes], ids: Sequence[Sequence[int]]) -> bytes:
    """The file for distinct words in ascending byte order and their ids."""
    builder = _Builder()
    for word in words:
        builder.add(word)
    builder.finish()
    # number the reachable states; below[s]: words that end at or under s
    order, number, stack = [], {0: 0}, [0]
    while stack:
        state = stack.pop()
        order.append(state)
        for child in builder.arcs[state].values():
            if child not in number:
                number[child] = len(number)
                stack.append(child)
    below: dict[int, int] = {}
    walk = [(0, False)]
    while walk:
        state, ready = walk.pop()
        if state in below:
            continue
        if ready:
            below[state] = builder.ends[state] + sum(below[c] for c in builder.arcs[state].values())
        else:
            walk.append((state, True))
            walk.extend((c, False) for c in builder.arcs[state].values() if c not in below)
    base = np.zeros(len(order) + 1, np.int32)
    final = np.zeros(len(order) + 1, np.int32)
    slots: dict[int, tuple[int, int, int]] = {}
    free = 1
    for state in sorted(order, key=lambda s: -len(builder.arcs[s])):
        arcs, n = builder.arcs[state], number[state]
        final[n] = builder.ends[state]
        if not arcs:
            continue
        first, tried = min(arcs), 0
        at = free = max(free, first)
        while any(at - first + b in slots for b in arcs):
            at, tried = at + 1, tried + 1
        if tried > 64:  # this stretch is nearly full: later states start after it
            free = at - 32
        base[n], passed = at - first, int(builder.ends[state])
        for byte in sorted(arcs):
            slots[at - first + byte] = (n, number[arcs[byte]], passed)
            passed += below[arcs[byte]]
    size = max(slots, default=0) + 257
    owner, target, output = (np.full(size, fill, np.int32) for fill in (-1, len(order), 0))
    for slot, (n, child, passed) in slots.items():
        owner[slot], target[slot], output[slot] = n, child, passed
    lengths = [len(x) for x in ids]
    offsets = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))).astype(np.int32)
    flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
    parts = [base, final, owner, target, output, offsets, flat]
    head = np.array([MAGIC, max(map(len, words), default=0), *map(len, parts)], np.int32)
    return b"".join(x.tobytes() for x in (head, *parts))


class Lexicon:
    """A compiled file, mapped into memory."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, np.int32, "r")
        if data[0] != MAGIC:
            raise ValueError(f"not a lexicon: {path}")
        self.longest, at = int(data[1]), 2 + len(PARTS)
        for name, n in zip(PARTS, data[2:at].tolist(), strict=True):
            setattr(self, name, np.asarray(data[at : at + n]))
            at += n
        self.lengths = np.diff(self.offsets)

    def rows(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each word ``text[start : start + length]`` its row of ids, or -1."""
        dead = len(self.base) - 1
        order = np.argsort(-lengths, kind="stable")
        order = order[np.searchsorted(-lengths[order], -self.longest) :]
        at, left = starts[order], -lengths[order]
        state, total = np.zeros(len(order), np.int32), np.zeros(len(order), np.int32)
        for place in range(self.longest if len(order) else 0):
            n = int(np.searchsorted(left, -place))  # words longer than place
            if not n:
                break
            now = state[:n]
            slot = self.base[now] + text[at[:n] + place]
            good = self.owner[slot] == now
            state[:n] = np.where(good, self.target[slot], dead)
            total[:n] += self.output[slot]
        found = np.full(len(lengths), -1, np.int32)
        found[order] = np.where(self.final[state] == 1, total, -1)
        return found
