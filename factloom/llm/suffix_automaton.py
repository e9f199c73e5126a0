"""Generalised suffix automaton over token sequences, and matching statistics of a stream against it."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator


class SuffixAutomaton:
    """Recognises every run of tokens of every added sequence; at most two states for each token added.

    `places[state]` maps a sequence's number to the indexes, in order, after each of its occurrences of the
    state's strings.
    """

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.places: list[dict[int, list[int]]] = [{}]
        self.sizes: list[int] = []

    def _state(self, length: int, after: dict, link: int) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.places.append({})
        return len(self.next) - 1

    def _split(self, parent: int, token: Hashable, old: int) -> int:
        copy = self._state(self.length[parent] + 1, dict(self.next[old]), self.link[old])
        self.link[old] = copy
        while parent >= 0 and self.next[parent].get(token) == old:
            self.next[parent][token] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, token: Hashable) -> int:
        known = self.next[last].get(token)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, token, known)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return new

    def add(self, tokens: Iterable[Hashable]) -> int:
        """Adds a sequence and returns its number."""
        number, last, n = len(self.sizes), 0, 0
        for token in tokens:
            last = self._extend(last, token)
            n += 1
        self.sizes.append(n)
        return number

    def place(self, sequences: Iterable[Iterable[Hashable]]) -> None:
        """Fills `places` for the added sequences, given again in order: to be called once, after the last add()."""
        for number, tokens in enumerate(sequences):
            state = 0
            for end, token in enumerate(tokens, 1):
                state = self.next[state][token]
                for s in self.ancestors(state):
                    self.places[s].setdefault(number, []).append(end)

    def state_of(self, tokens: Iterable[Hashable]) -> int:
        """The state that holds a run of tokens, or -1."""
        state = 0
        for token in tokens:
            state = self.next[state].get(token, -1)
            if state < 0:
                return -1
        return state

    def ancestors(self, state: int) -> Iterator[int]:
        while state > 0:
            yield state
            state = self.link[state]

    def step(self, state: int, length: int, token: Hashable) -> tuple[int, int]:
        """The longest suffix of (what was matched + token) that occurs, as (state, length)."""
        while state > 0 and token not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(token)
        return (to, length + 1) if to is not None else (0, 0)
