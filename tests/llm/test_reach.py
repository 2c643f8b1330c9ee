"""The listed share of a sketch leaves at most the stated chance of a miss."""

from math import comb

import pytest

from lexatlas.llm import near_dedup


@pytest.mark.parametrize("similar", [80, 85, 90])
def test_reach_keeps_the_stated_bound(similar):
    size, p = near_dedup.SKETCH, similar / 100
    missed = lambda reach: sum(comb(size, k) * p**k * (1 - p) ** (size - k) for k in range(size - reach + 1))
    reach = near_dedup.prefix_reach(size, similar)
    assert missed(reach) <= 1e-10 < missed(reach - 1)
