"""The grid range-join of segment counts: every pair within the bits meets in a cell."""

import itertools
import random

import numpy as np
import pytest

from gridsmith.llm import simhash


@pytest.mark.parametrize("bits", range(6))
def test_all_pairs_within_the_bits_meet(bits):
    r = random.Random(bits)
    fps = []
    for _ in range(40):
        x = r.choice([0, (1 << 64) - 1, r.getrandbits(64)])
        fps += [x, *(x ^ sum(1 << b for b in r.sample(range(64), r.randint(0, bits))) for _ in range(6))]
        pair = 2 * r.randrange(32)  # both bits of a segment, and of its neighbour
        fps.append(x ^ (3 << pair) if bits > 1 else x)
    fp = np.array(fps, np.uint64)
    cells = [set() for _ in fps]
    for cell, which in simhash.grid_cells(fp, bits):
        for c, w in zip(cell.tolist(), which.tolist(), strict=True):
            cells[w].add(c)
    assert max(map(len, cells)) <= 1 + 2 * 16 + 1 + 2 * 16
    near = 0
    for a, b in itertools.combinations(range(len(fps)), 2):
        apart = (fps[a] ^ fps[b]).bit_count()
        assert np.bitwise_count(simhash.popcount_code(fp[[a]]) ^ simhash.popcount_code(fp[[b]]))[0] <= apart
        if apart <= bits:
            near += 1
            assert cells[a] & cells[b]
    assert near > 40
