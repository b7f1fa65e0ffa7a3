"""Induced sorting and the permuted common prefixes against sorted slices."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from tiltmeter.llm import suffixes


@pytest.mark.parametrize("seed", range(40))
def test_random_strings(seed):
    draw = np.random.default_rng(seed)
    strings = [bytes(draw.integers(97, 97 + draw.integers(1, 5), draw.integers(1, 90)).tolist()) for _ in range(draw.integers(1, 7))]
    check(strings)


def check(strings):
    text = np.concatenate([np.r_[np.frombuffer(s, np.uint8) + 1, 0] for s in strings]).astype(np.uint8)
    room = np.concatenate([np.arange(len(s), -1, -1) for s in strings])
    raw = text.tobytes()
    order = suffixes.suffix_array(text, 10**9)
    read = [raw[i : raw.index(0, i) + 1] for i in order]
    assert len(order) == len(text) - len(strings) and read == sorted(read)
    for length in (8, 13, 24):
        count = Counter(raw[i : i + length] for i in range(len(raw)) if room[i] >= length)
        want = [bool(room[i] >= length and count[raw[i : i + length]] > 1) for i in range(len(raw))]
        for stride in (3, 48):
            assert suffixes.repeated_starts(text, room, length, stride).tolist() == want


def test_long_runs_and_all_bytes():
    check([b"a" * 3000, b"a" * 700 + b"b", bytes(range(1, 245)) * 3, "日本語の文".encode() * 20])
