"""A suffix automaton of several word strings: built online, kept as flat arrays, walked word by word."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

ROOT = 0


def build(strings: Sequence[Sequence[int]]) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """(transitions by state, suffix links, longest lengths) of the automaton that accepts every suffix of every string.

    A string starts again at the root; where the way it takes is there already, no new state is made unless the state
    also ends longer strings, in which case it is split.
    """
    goes: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]

    def state(to: dict[int, int], above: int, length: int) -> int:
        goes.append(to)
        link.append(above)
        longest.append(length)
        return len(goes) - 1

    def split(p: int, q: int, word: int) -> int:
        """The part of ``q`` that ends with what leads from ``p``."""
        half = state(dict(goes[q]), link[q], longest[p] + 1)
        link[q] = half
        while p >= 0 and goes[p].get(word) == q:
            goes[p][word] = half
            p = link[p]
        return half

    for string in strings:
        last = ROOT
        for word in string:
            q = goes[last].get(word)
            if q is not None:
                last = q if longest[q] == longest[last] + 1 else split(last, q, word)
                continue
            new = state({}, ROOT, longest[last] + 1)
            p = last
            while p >= 0 and word not in goes[p]:
                goes[p][word] = new
                p = link[p]
            if p >= 0:
                q = goes[p][word]
                link[new] = q if longest[q] == longest[p] + 1 else split(p, q, word)
            last = new
    return goes, link, longest


class Matcher:
    """The automaton of the items of one shard, with the windows that each state ends.

    ``window`` words of an item in a row are a window; an item of fewer words is one as a whole.
    """

    def __init__(self, strings: Sequence[Sequence[int]], window: int) -> None:
        self.goes, self.link, self.longest = build(strings)
        #: (state, length) -> the items with a window of that length that ends there.
        self.ends: dict[tuple[int, int], list[int]] = defaultdict(list)
        for item, string in enumerate(strings):
            length, state = min(window, len(string)), ROOT
            for at, word in enumerate(string):
                state = self._above(self.goes[state][word], length)
                if at + 1 >= length and (not (own := self.ends[state, length]) or own[-1] != item):
                    own.append(item)
        #: Lengths of windows by state, shortest first.
        self.lengths: dict[int, list[int]] = defaultdict(list)
        for state, length in sorted(self.ends):
            self.lengths[state].append(length)
        #: The next state up the links, itself included, that ends a window.
        self.next = [ROOT] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.longest.__getitem__):
            self.next[state] = state if state in self.lengths else self.next[self.link[state]]

    def _above(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of what leads to ``state``."""
        while state and self.longest[self.link[state]] >= length:
            state = self.link[state]
        return state

    def matches(self, words: Sequence[int]) -> Iterator[tuple[int, int, list[int]]]:
        """(place behind the window, its length, items) of every window that occurs; -1 stands for an unknown word."""
        state = have = 0
        for at, word in enumerate(words):
            while state and word not in self.goes[state]:
                state = self.link[state]
                have = self.longest[state]
            state = self.goes[state].get(word, ROOT)
            have = have + 1 if state else 0
            end = self.next[state]
            while end:
                for length in self.lengths[end]:
                    if length <= have:
                        yield at + 1, length, self.ends[end, length]
                end = self.next[self.link[end]]
