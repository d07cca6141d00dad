"""Cut blocks: boxes that fill the block, volumes against unrefined cuts, and sums of cell weights."""

import random

import pytest
from gnomon.operators import block_cuts, partition


def test_boxes_fill_random_blocks_and_are_never_worse():
    r, within, n = random.Random(3), 0, 0
    for _ in range(60):
        dims, weights = [r.randint(4, 30) for _ in range(r.choice([2, 3]))], [r.randint(1, 9) for _ in range(r.randint(1, 12))]
        plain, boxes = partition.split_block(dims, weights), block_cuts.cut_block(dims, weights)
        seen = set()
        for b in boxes:
            cells = {tuple(c) for c in _cells(b)}
            assert cells and not cells & seen
            seen |= cells
        assert len(seen) == len(set(_cells([(0, d) for d in dims])))
        a, b = (max(block_cuts.deviations(x, weights)) for x in (plain, boxes))
        assert b <= a + 1e-9
        within, n = within + (b <= 1), n + 1
    assert within >= 0.9 * n


def _cells(box):
    from itertools import product

    return product(*[range(*r) for r in box])


def test_parts_keep_their_weights_and_too_many_parts_raise():
    boxes = block_cuts.cut_block((10, 10, 10), [6, 3, 1])
    assert [block_cuts.volume(b) for b in boxes] == [600, 300, 100]
    assert sorted(block_cuts.volume(b) for b in block_cuts.cut_block((2, 2, 2), [1] * 8)) == [1] * 8
    with pytest.raises(ValueError):
        block_cuts.cut_block((2, 2, 1), [1] * 5)


def test_cell_weights(spark):
    """Layers of growing weight: sums follow the weights, not the volumes; nulls weigh nothing; local numbers fill each box."""
    dims = (6, 8, 20)
    heavy = lambda g: None if g % 11 == 0 else 1.0 + (g - 1) // 48
    cells = spark.createDataFrame([(g, heavy(g)) for g in range(1, 961)], "cell long, w double")
    got = block_cuts.by_cell_weights(cells, dims, [1, 1, 2, 1, 3], "w").collect()
    assert sorted(r["cell"] for r in got) == list(range(1, 961))
    total, sums = sum(heavy(g) or 0 for g in range(1, 961)), {}
    for r in got:
        sums[r["part"]] = sums.get(r["part"], 0) + (heavy(r["cell"]) or 0)
    for p in range(5):
        lnums = sorted(r["lnum"] for r in got if r["part"] == p)
        assert lnums == list(range(1, len(lnums) + 1))
        assert abs(sums[p] / total - [1, 1, 2, 1, 3][p] / 8) < 0.06
    assert block_cuts.by_cell_weights(cells.limit(0), dims, [1, 1], "w").count() == 0
    one = block_cuts.by_cell_weights(cells, dims, [1], "w").collect()
    assert all(r["part"] == 0 and r["lnum"] == r["cell"] for r in one)
