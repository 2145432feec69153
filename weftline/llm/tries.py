"""Burst tries over bytes with counters by source at the leaves: inner nodes branch by a byte, containers hold sorted leaves as arrays.

Depth, and with it all recursion, is bounded by DEEPEST.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from weftline.llm.common import text_bytes

#: Leaves of a container before it bursts into a node, and the depth from which containers do not.
BURST, DEEPEST = 1 << 12, 32


class Leaves:
    """Terms in the order of bytes, each once, and counters (term's place, source, n, docs) by place and source."""

    __slots__ = ("terms", "place", "source", "n", "docs")

    def __init__(self, terms: pa.Array, place: np.ndarray, source: np.ndarray, n: np.ndarray, docs: np.ndarray):
        self.terms, self.place, self.source, self.n, self.docs = terms, place, source, n, docs

    @classmethod
    def of(cls, terms: pa.Array, place: np.ndarray, source: np.ndarray, n: np.ndarray, docs: np.ndarray) -> Leaves:
        """From terms in any order, repeated ones too, and counters of them in any order: equal ones are summed."""
        coded = terms.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy().astype(np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        width = int(source.max(initial=0)) + 1
        key = rank[coded.indices.to_numpy()][place] * width + source
        by = np.argsort(key)
        key = key[by]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else by
        sums = [np.add.reduceat(x[by], first) if len(key) else x for x in (n, docs)]
        return cls(coded.dictionary.take(pa.array(order)), key[first] // width, key[first] % width, *sums)

    def merged(self, other: Leaves) -> Leaves:
        both = lambda a, b: np.concatenate([a, b])
        terms = pa.concat_arrays([self.terms, other.terms])
        return Leaves.of(terms, both(self.place, other.place + len(self.terms)), both(self.source, other.source), both(self.n, other.n), both(self.docs, other.docs))

    def branches(self, depth: int) -> Iterator[tuple[int, Leaves]]:
        """Leaves by their byte at ``depth``, -1 for the term that ends there; all before is the same."""
        raw, bounds = text_bytes(self.terms)
        at = bounds[:-1] + depth
        ends = at >= bounds[1:]
        byte = np.where(ends, -1, raw[np.where(ends, 0, at)].astype(np.int64)) if len(raw) else np.full(len(at), -1)
        cuts = [0, *(np.flatnonzero(np.diff(byte)) + 1).tolist(), len(byte)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            a, b = np.searchsorted(self.place, [lo, hi])
            yield int(byte[lo]), Leaves(self.terms.slice(lo, hi - lo), self.place[a:b] - lo, self.source[a:b], self.n[a:b], self.docs[a:b])


class Trie:
    """A node at some depth: a container of leaves, or children by their next byte."""

    __slots__ = ("held", "children")

    def __init__(self):
        self.held, self.children = None, {}

    def add(self, leaves: Leaves, depth: int = 0) -> None:
        """Add leaves that share their first ``depth`` bytes with this node."""
        if self.children:
            for byte, part in leaves.branches(depth):
                self.children.setdefault(byte, Trie()).add(part, depth + 1)
            return
        self.held = leaves if self.held is None else self.held.merged(leaves)
        if len(self.held.terms) > BURST and depth < DEEPEST:
            held, self.held = self.held, None
            for byte, part in held.branches(depth):
                child = self.children[byte] = Trie()
                child.add(part, depth + 1)

    def merge(self, other: Trie) -> None:
        """Add all leaves of another trie."""
        for leaves in other.containers():
            self.add(leaves)

    def containers(self) -> Iterator[Leaves]:
        """The containers in the order of bytes."""
        if self.held is not None:
            yield self.held
        for byte in sorted(self.children):
            yield from self.children[byte].containers()

