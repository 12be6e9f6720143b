"""A HAT-trie over sequences of word ids that counts them: hash containers under a shallow trie, as numpy arrays inside a task.

A node of the trie is reached by the ids consumed so far and divides the next id's range among its children. A child is a hash
container, which counts all rest sequences of its range, or a node one id further down. A container that outgrows its limit bursts:
over several next ids it splits its range in two, over one it becomes a node. Sequences arrive in sorted batches, so a child gets
a slice, and a container takes a slice in a few vectorised probes. When all containers together outgrow the budget, whole subtrees,
the largest first, leave as sorted runs.

Ids are 64-bit numbers without sign that are spread evenly; a trie holds sequences of one length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from orelayer.llm.hashing import ODD, mixed

FIRST, LAST = 0, (1 << 64) - 1


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``keys`` in order, with their counts added up."""
    if not len(keys):
        return keys, counts
    order = np.lexsort(keys.T[::-1])
    keys, counts = keys[order], counts[order]
    opens = np.ones(len(keys), bool)
    opens[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    return keys[opens], np.add.reduceat(counts, np.flatnonzero(opens))


def row_hashes(keys: np.ndarray) -> np.ndarray:
    """One spread 64-bit number per row."""
    found = keys[:, 0].copy()
    for column in keys.T[1:]:
        found = mixed(found * np.uint64(ODD) + column)
    return found


class Container:
    """An open-addressing table from rest sequences to counts. A slot with count 0 is free."""

    def __init__(self, width: int, slots: int = 256):
        self.keys, self.counts, self.used = np.zeros((slots, width), np.uint64), np.zeros(slots, np.int64), 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add counts above 0 of distinct keys."""
        if 2 * (self.used + len(keys)) > len(self.counts):
            held, before = self.entries()
            slots = 1 << (3 * (self.used + len(keys))).bit_length()
            self.__init__(self.keys.shape[1], slots)
            self._probe(held, before)
        self._probe(keys, counts)

    def _probe(self, keys: np.ndarray, counts: np.ndarray) -> None:
        # The high bits choose the child, so the low bits choose the slot.
        mask = len(self.counts) - 1
        slot = (row_hashes(keys) & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.counts[at] == 0
            self.keys[at[free]] = keys[left[free]]  # of several that want a free slot, one gets it
            mine = (self.keys[at] == keys[left]).all(axis=1)
            self.used += int((mine & free).sum())
            self.counts[at[mine]] += counts[left[mine]]
            left = left[~mine]
            slot[left] = (slot[left] + 1) & mask

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.counts)
        return self.keys[at], self.counts[at]

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(*self.entries())


class Node:
    """Children over the range of the next id: ``lows[i]`` is the first id of child ``i``; a child that has got nothing is None."""

    def __init__(self, width: int, limit: int):
        self.width, self.limit, self.lows, self.children = width, limit, np.array([FIRST], np.uint64), [None]

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add sorted distinct sequences."""
        cuts = [0, *np.searchsorted(keys[:, 0], self.lows[1:]).tolist(), len(keys)]
        grown = []
        for i, child in enumerate(self.children):
            low, high = cuts[i], cuts[i + 1]
            if low == high:
                continue
            if isinstance(child, Node):
                child.add(keys[low:high, 1:], counts[low:high])
                continue
            if child is None:
                child = self.children[i] = Container(self.width)
            child.add(keys[low:high], counts[low:high])
            if child.used > self.limit:
                grown.append(i)
        for i in reversed(grown):
            self._burst(i)

    def _burst(self, i: int) -> None:
        keys, counts = self.children[i].run()
        first = keys[:, 0]
        if first[0] != first[-1]:
            middle = first[len(first) // 2]
            cut = int(np.searchsorted(first, middle if middle != first[0] else middle + np.uint64(1)))
            halves = []
            for part in (slice(0, cut), slice(cut, None)):
                half = Container(self.width)
                half.add(keys[part], counts[part])
                halves.append(half)
            self.children[i : i + 1] = halves
            self.lows = np.insert(self.lows, i + 1, first[cut])
            for j in (i + 1, i):
                if self.children[j].used > self.limit:
                    self._burst(j)
        elif self.width > 1:
            node = Node(self.width - 1, self.limit)
            node.add(keys[:, 1:], counts)
            own = int(first[0])
            high = int(self.lows[i + 1]) - 1 if i + 1 < len(self.lows) else LAST
            lows, children = [own], [node]
            if own > int(self.lows[i]):
                lows, children = [int(self.lows[i]), own], [None, node]
            if own < high:
                lows, children = [*lows, own + 1], [*children, None]
            self.lows = np.concatenate([self.lows[:i], np.array(lows, np.uint64), self.lows[i + 1 :]])
            self.children[i : i + 1] = children

    def size(self, i: int) -> int:
        child = self.children[i]
        if child is None:
            return 0
        return sum(child.size(j) for j in range(len(child.children))) if isinstance(child, Node) else child.used

    def run(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """All sequences under a child, sorted, with their counts."""
        child = self.children[i]
        if isinstance(child, Container):
            return child.run()
        parts = [child.run(j) for j in range(len(child.children)) if child.children[j] is not None]
        rest, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
        return np.column_stack([np.full(len(rest), self.lows[i]), rest]), counts


class HatTrie:
    """Counts sequences of ``width`` ids; holds at most about ``budget`` distinct ones and spills the others as runs."""

    def __init__(self, width: int, budget: int = 1 << 20, limit: int = 1 << 15):
        self.width, self.budget, self.limit = width, budget, limit
        self.root = Node(width, limit)

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Count sequences, in any order and repeated; gives the runs that had to leave."""
        self.root.add(*summed(keys, np.ones(len(keys), np.int64) if counts is None else counts))
        sizes = [self.root.size(i) for i in range(len(self.root.children))]
        held = sum(sizes)
        if held <= self.budget:
            return
        for i in np.argsort(sizes)[::-1].tolist():
            yield self.root.run(i)
            self.root.children[i] = None
            held -= sizes[i]
            if held <= self.budget // 2:
                return

    def spill(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Everything that is left, subtree by subtree; the trie is empty after that."""
        for i, child in enumerate(self.root.children):
            if child is not None:
                yield self.root.run(i)
        self.root = Node(self.width, self.limit)


def encoded(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run as bytes: each first id once with the number of its sequences, then rest ids and counts in as few bytes as they need."""
    opens = np.flatnonzero(np.concatenate([[True], keys[1:, 0] != keys[:-1, 0]])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(opens, len(keys)))
    kinds = [np.min_scalar_type(int(v.max(initial=0))) for v in (sizes, counts)]
    head = np.array([keys.shape[1], len(keys), len(opens), kinds[0].itemsize, kinds[1].itemsize], np.int64)
    parts = [head, keys[opens, 0], sizes.astype(kinds[0]), np.ascontiguousarray(keys[:, 1:].T), counts.astype(kinds[1])]
    return b"".join(p.tobytes() for p in parts)


def decoded(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    width, rows, firsts, a, b = np.frombuffer(run, np.int64, 5).tolist()
    at = 40
    first = np.frombuffer(run, np.uint64, firsts, at)
    at += 8 * firsts
    sizes = np.frombuffer(run, f"u{a}", firsts, at)
    at += a * firsts
    rest = np.frombuffer(run, np.uint64, rows * (width - 1), at).reshape(width - 1, rows)
    at += 8 * rows * (width - 1)
    counts = np.frombuffer(run, f"u{b}", rows, at).astype(np.int64)
    return np.column_stack([np.repeat(first, sizes.astype(np.int64)), *rest]), counts
