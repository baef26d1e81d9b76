from __future__ import annotations

import math
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidewake.load import STEPS, Histogram, doubts, open_loop


def filled(values):
    h = Histogram()
    for x in values:
        h.record(x)
    return h


@given(st.lists(st.floats(1e-6, 1e4), min_size=1, max_size=200), st.sampled_from([1, 50, 90, 99, 100]))
def test_percentiles(values, q):
    true = sorted(values)[max(1, math.ceil(q / 100 * len(values))) - 1]
    assert true <= filled(values).percentile(q) <= true * (1 + 1 / STEPS) * (1 + 1e-12)


@given(st.lists(st.floats(1e-6, 1e4)), st.lists(st.floats(1e-6, 1e4)))
def test_merged_histograms_are_those_of_all_values(a, b):
    h = filled(a)
    h.merge(filled(b))
    assert h == filled(a + b) and len(h) == len(a) + len(b)


def test_nothing_recorded():
    assert math.isnan(Histogram().percentile(50))


def test_a_stall_counts_for_the_calls_that_wait():
    calls = []

    def run():
        calls.append(1)
        if len(calls) == 1:
            time.sleep(0.5)

    load = open_loop(run, rate=40, seconds=1, workers=1)
    assert len(calls) == len(load.due) == 40 and load.failed == 0
    # 20 calls were due in the half second; their service took no time
    assert load.service.percentile(90) < 0.05 < 0.2 < load.due.percentile(75)


def test_failed_calls_are_counted_apart():
    load = open_loop(lambda: 1 / 0, rate=50, seconds=0.2, workers=2)
    assert load.failed == 10 and len(load.due) == 0
    with pytest.raises(ValueError):
        open_loop(lambda: None, rate=0, seconds=1)


def test_doubts():
    assert doubts(load=0.5, cpus=8, free=0.9) == []
    assert len(doubts(load=7, cpus=8, free=0.9)) == 1 and len(doubts(load=7, cpus=8, free=0.01)) == 2
    assert isinstance(doubts(), list)
