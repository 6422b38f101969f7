"""A generalised suffix automaton over word ids, for finding windows of test items in token streams."""

from __future__ import annotations

from collections.abc import Iterable

_WIDTH = 32  # a transition's key is state << 32 | word


class SuffixAutomaton:
    """Accepts every run of consecutive words of every item.

    ``window``: the length at which a common run counts; items shorter than that count as a whole.
    ``items``: (label, words); a label may be None, then its windows count but name no item.
    """

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.go: dict[int, int] = {}
        self.link, self.length = [-1], [0]
        self._out: list[dict[int, int]] = [{}]
        ids = []
        for label, words in items:
            if words:
                ids.append((label, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))
        for _, seq in ids:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        for state, out in enumerate(self._out):
            for w, to in out.items():
                self.go[state << _WIDTH | w] = to
        del self._out
        self.shortest = min((min(len(s), window) for _, s in ids), default=0)
        self.full: dict[int, list[str]] = {}
        self.short: dict[int, list[tuple[int, list[str]]]] = {}
        self._label(ids)

    def _state(self, length: int) -> int:
        self.link.append(0)
        self.length.append(length)
        self._out.append({})
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        clone = self._state(self.length[p] + 1)
        self._out[clone] = dict(self._out[q])
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self._out[p].get(w) == q:
            self._out[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if (q := self._out[last].get(w)) is not None:  # another item already has this run
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and w not in self._out[p]:
            self._out[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self._out[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def _label(self, ids: list[tuple[str | None, list[int]]]) -> None:
        full: dict[int, set[str]] = {}
        short: dict[int, dict[int, set[str]]] = {}
        for label, seq in ids:
            size, state = min(len(seq), self.window), 0
            for k, w in enumerate(seq, 1):
                state = self.go[state << _WIDTH | w]
                if k < size:
                    continue
                at = self._suffix(state, size)
                to = full.setdefault(at, set()) if size == self.window else short.setdefault(at, {}).setdefault(size, set())
                if label is not None:
                    to.add(label)
        self.full = {s: sorted(x) for s, x in full.items()}
        self.short = {s: [(n, sorted(x)) for n, x in sorted(by.items())] for s, by in short.items()}
        # the nearest state on the suffix path, itself included, that ends a short item; 0 for none
        self.ends = [0] * len(self.length)
        if short:
            for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
                self.ends[s] = s if s in self.short else self.ends[self.link[s]]

    def _suffix(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of what ``state`` has matched."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def scan(self, ids: list[int], start: int, stop: int, hits: list[tuple[int, int]], labels: set[str]) -> None:
        """Adds to ``hits`` the (start, end) of each window that occurs in ids[start:stop], to ``labels`` its items."""
        go, link, length, window, ends = self.go, self.link, self.length, self.window, self.ends
        state = matched = 0
        for i in range(start, stop):
            w = ids[i]
            while (to := go.get(state << _WIDTH | w)) is None and state:
                state = link[state]
                matched = length[state]
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= window:
                at = self._suffix(state, window)
                hits.append((i + 1 - window, i + 1))
                labels.update(self.full[at])
            at = ends[state]
            while at:
                for n, names in self.short[at]:
                    if n <= matched:
                        hits.append((i + 1 - n, i + 1))
                        labels.update(names)
                at = ends[link[at]]
