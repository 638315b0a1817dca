"""Sketches never separate linked sets, in a leaf or in a tree."""

import numpy as np
import pytest

from shelfwise.llm.signature_tree import connect_sketches, sketch


@pytest.mark.parametrize("bases", [2, 40])
@pytest.mark.parametrize("percent", [80, 85])
def test_sketches_connect_what_is_linked(bases, percent):
    rng = np.random.default_rng(bases)
    sets = []
    for _ in range(bases):
        base = rng.integers(0, 1 << 64, rng.integers(1, 400), dtype="uint64")
        for _ in range(4):
            keep = base[rng.random(len(base)) < 0.93]
            sets.append(np.unique(keep if len(keep) else base))
    args = [int(s[:1].view("int64")[0]) for s in sets], [len(s) for s in sets], [sketch(s) for s in sets], percent
    root = list(range(len(sets)))
    for j, k in connect_sketches(*args, list(range(len(sets)))):
        root = [root[j] if r == root[k] else r for r in root]
    linked = 0
    for j, s in enumerate(sets):
        for k in range(j):
            common = len(np.intersect1d(s, sets[k]))
            if 100 * common >= percent * (len(s) + len(sets[k]) - common):
                linked += 1
                assert root[j] == root[k]
    assert linked
    assert connect_sketches(*args, [0] * len(sets)) == []
    # Unrelated sets stay apart mostly, so that groups do not chain.
    assert len(set(root)) >= bases // 2
