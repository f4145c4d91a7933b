import time

import numpy as np
import pytest

from flowlens.llm.lists import pack, slices, unpack


@pytest.mark.parametrize("bits", [48, 64])
@pytest.mark.parametrize("ranges", [1, 2, 3, 7, 1000, 999_983, (1 << 31) - 1])
def test_slices_cut_the_hash_space_evenly(bits, ranges):
    rng = np.random.default_rng(ranges)
    edges = [((i << bits) + ranges - 1) // ranges for i in {1, 2, ranges // 2, ranges - 1} if 0 < i < ranges]
    values = {0, 1, (1 << bits) - 1, *edges, *[e - 1 for e in edges]} | set(rng.integers(0, 1 << 47, 500).tolist())
    values = np.array(sorted(values), np.uint64)
    got = [(i, v) for i, a, b in slices(values, ranges, bits) for v in values[a:b].tolist()]
    assert got == [((v * ranges) >> bits, v) for v in values.tolist()]
    assert slices(values[:0], ranges, bits) == []


def test_work_does_not_grow_with_the_ranges():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 48, 20_000).astype(np.uint64))
    spent = []
    for ranges in (1_000, 100_000_000):
        begin = time.process_time()
        for _ in range(5):
            slices(values, ranges, 48)
        spent.append(time.process_time() - begin)
    assert spent[1] < 0.5


def test_pack_round_trip():
    for values in ([], [0], [5, 5 + (1 << 40)], [1, 2, 1 << 63, (1 << 64) - 1]):
        assert unpack(pack(np.array(values, np.uint64))).tolist() == values
