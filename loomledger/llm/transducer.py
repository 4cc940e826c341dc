"""Minimal acyclic transducers: sorted byte strings to their ordinals.

States that accept the same rest are one state, so common endings are kept once, as common beginnings are. An arc's output is the number of
strings that come before those behind it at its state; the outputs along a string's path add up to its ordinal, its place in the sorted
list. Building takes memory for the states and the path of one string; looking up takes all of a batch's strings along together, a byte at a
time.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class Builder:
    """Takes strings in ascending order, each once, and freezes what no later string can change."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.words: list[int] = []  # strings that a frozen state accepts
        self.labels: list[bytes] = []
        self.targets: list[tuple[int, ...]] = []
        self.finals: list[bool] = []
        #: Open states along the last string: final, labels, targets of frozen children.
        self.path: list[list] = [[False, bytearray(), []]]
        self.last: bytes | None = None

    def _freeze(self, state: list) -> int:
        final, labels, targets = state[0], bytes(state[1]), tuple(state[2])
        at = self.known.setdefault((final, labels, targets), len(self.words))
        if at == len(self.words):
            self.finals.append(final)
            self.labels.append(labels)
            self.targets.append(targets)
            self.words.append(final + sum(self.words[t] for t in targets))
        return at

    def _close(self, depth: int) -> None:
        """Freeze the open states deeper than depth."""
        while len(self.path) > depth + 1:
            child = self._freeze(self.path.pop())
            self.path[-1][2].append(child)

    def add(self, word: bytes) -> None:
        if self.last is not None and word <= self.last:
            raise ValueError("strings have to ascend")
        old = self.last or b""
        shared = next((i for i, (a, b) in enumerate(zip(old, word, strict=False)) if a != b), min(len(old), len(word)))
        self._close(shared)
        for byte in word[shared:]:
            self.path[-1][1].append(byte)
            self.path.append([False, bytearray(), []])
        self.path[-1][0] = True
        self.last = word

    def build(self) -> Transducer:
        self._close(0)
        root = self._freeze(self.path[0])
        sizes = np.fromiter(map(len, self.labels), dtype=np.int64, count=len(self.labels))
        of = np.repeat(np.arange(len(sizes)), sizes)
        targets = np.fromiter((t for row in self.targets for t in row), dtype=np.int64, count=len(of))
        finals = np.array(self.finals, dtype=bool)
        behind = np.array(self.words, dtype=np.int64)[targets]
        # Strings before an arc: the state's own, and those behind the arcs to its left.
        total = np.concatenate(([0], np.cumsum(behind)))
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        output = total[:-1] - total[starts[of]] + finals[of]
        keys = of * 256 + np.frombuffer(b"".join(self.labels), dtype=np.uint8)
        return Transducer(keys, targets, output, finals, root, self.words[root])


class Transducer:
    """Arcs sorted by state and byte: keys (256 x state + byte), targets, outputs; which states are final; the first state; strings."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray, output: np.ndarray, finals: np.ndarray, root: int, size: int) -> None:
        self.keys, self.targets, self.output, self.finals, self.root, self.size = keys, targets, output, finals, root, size

    def packed(self) -> bytes:
        head = np.array([len(self.keys), len(self.finals), self.root, self.size], dtype="<i8")
        return b"".join(x.tobytes() for x in (head, self.keys.astype("<i8"), self.output.astype("<i8"), self.targets.astype("<i4"), self.finals.astype("u1")))

    @classmethod
    def unpacked(cls, raw: bytes) -> Transducer:
        arcs, states, root, size = (int(x) for x in np.frombuffer(raw, "<i8", 4))
        keys, output = np.frombuffer(raw, "<i8", arcs, 32), np.frombuffer(raw, "<i8", arcs, 32 + 8 * arcs)
        return cls(keys, np.frombuffer(raw, "<i4", arcs, 32 + 16 * arcs), output, np.frombuffer(raw, "u1", states, 32 + 20 * arcs).astype(bool), root, size)

    def ordinals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The ordinal of each string data[start:end] of bytes, -1 of those not in the list."""
        found = np.full(len(starts), -1, dtype=np.int64)
        alive = np.arange(len(starts))
        state, total, at = np.full(len(starts), self.root, dtype=np.int64), np.zeros(len(starts), np.int64), starts.astype(np.int64)
        while len(alive):
            over = at == ends[alive]
            if over.any():
                done = over & self.finals[state]
                found[alive[done]] = total[done]
                going = ~over
                alive, state, total, at = alive[going], state[going], total[going], at[going]
            if not len(alive) or not len(self.keys):
                break
            key = state * 256 + data[at]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            going = self.keys[arc] == key
            arc = arc[going]
            alive, total, at, state = alive[going], total[going] + self.output[arc], at[going] + 1, self.targets[arc].astype(np.int64)
        return found


def build(words: Iterable[bytes]) -> Transducer:
    builder = Builder()
    for word in words:
        builder.add(word)
    return builder.build()
