"""Budgets composed from ranges against the sequential rules."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.operators import budgets


def next_fit(sizes, max_size, max_units):
    out, batch, count, total = [], 0, 0, 0
    for n in sizes:
        if count and (count >= max_units or total + n > max_size):
            batch, count, total = batch + 1, 0, 0
        count, total = count + 1, total + n
        out.append(batch)
    return out


def greedy(sizes, max_size, max_units):
    out, count, total = [], 0, 0
    for k, n in enumerate(sizes):
        if count < max_units and (total + n <= max_size or not count):
            count, total = count + 1, total + n
            out.append(k)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(1, 20), st.integers(1, 6), st.integers(1, 7))
def test_ranges_compose(sizes, max_size, max_units, cut):
    """A walk over the heads of short ranges ends each of them in the state of the whole pass."""
    batches = next_fit(sizes, max_size, max_units)
    count, total, batch = 0, 0, -1
    for a in range(0, len(sizes), cut):
        piece = sizes[a : a + cut]
        rows = pd.DataFrame(budgets.heads(np.array(piece, np.int64), max_size, max_units))
        begun, count, total = budgets.enter(rows, count, total, max_size, max_units)
        batch += begun
        end = a + len(piece)
        assert batch == batches[end - 1]
        mine = [k for k in range(end) if batches[k] == batch]
        assert (count, total) == (len(mine), sum(sizes[k] for k in mine))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=60), st.integers(1, 30), st.integers(1, 6), st.integers(1, 9))
def test_what_may_be_taken_holds_what_is_taken(sizes, max_size, max_units, cut):
    kept = set()
    for a in range(0, len(sizes), cut):
        piece = np.array(sizes[a : a + cut])
        kept |= {a, *(a + budgets.may_be_taken(piece, max_units)).tolist()}
    order = sorted(kept)
    assert [order[k] for k in greedy([sizes[k] for k in order], max_size, max_units)] == greedy(sizes, max_size, max_units)


@pytest.mark.parametrize("most", [7, 1 << 20])
def test_as_the_sequential_rules(spark, most):
    rng = random.Random(8)
    groups = {f"g{g}": [rng.choice([0, 1, 3, 8, 20, 60]) for _ in range(n)] for g, n in enumerate([1, 2, 9, 40, 400])} | {None: [5] * 30}
    rows = [(g, i, n if n or i % 2 else None, "x") for g, sizes in groups.items() for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "g string, i int, s int, __other string").repartition(5)
    got = budgets.budget_batches(df, "s", ["i"], 50, 6, "g", most).collect()
    assert sorted(((r["g"], r["i"], r["batch"]) for r in got), key=repr) == sorted(((g, i, b) for g, s in groups.items() for i, b in enumerate(next_fit(s, 50, 6))), key=repr)
    taken = budgets.budget_selection(df, "s", ["i"], 50, 6, "g", most).collect()
    assert sorted(((r["g"], r["i"]) for r in taken), key=repr) == sorted(((g, i) for g, s in groups.items() for i in greedy(s, 50, 6)), key=repr)
    assert budgets.budget_batches(df.limit(0), "s", ["i"], 50, 6, "g").count() == 0 and budgets.budget_selection(df.limit(0), "s", ["i"], 50, 6, "g").count() == 0


def test_a_selection_keeps_few_units_of_a_range():
    sizes = np.random.default_rng(2).permutation(20_000)
    assert len(budgets.may_be_taken(sizes, 10)) < 200
