import math
import random

import numpy as np
import pytest

from bindery.llm import hard_negatives
from bindery.llm.hard_negatives import mine_hard_negatives, segment_lengths, summarise

SCHEMA = "vec_id bigint, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


def brute(rows, every, positives=5, negatives=3, low=50, high=95):
    usable = set()
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.add((i, tuple(math.floor(256 * x) for x in v), label))
    usable = sorted(usable)
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for anchor in usable:
        if anchor[0] % every:
            continue
        ranked = sorted((-score(anchor[1], r[1]), r[0], r[2] == anchor[2]) for r in usable if r != anchor)
        for s, p, _ in [r for r in ranked if r[2]][:positives]:
            fits = [r for r in ranked if not r[2] and low * -s <= 100 * -r[0] <= high * -s]
            out += [(anchor[0], p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(fits[:negatives])]
    return sorted(out)


def result(spark, rows, schema=SCHEMA, **how):
    return sorted(map(tuple, mine_hard_negatives(spark.createDataFrame(rows, schema), **how).collect()))


def vectors(seed, n, dim, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    rows = []
    for i in range(n):
        label = int(rng.integers(labels))
        v = centres[label] * 0.4 + rng.normal(size=dim)
        rows.append((i, (v / np.linalg.norm(v)).tolist(), label))
    return rows


@pytest.mark.parametrize(("dim", "small"), [(64, False), (64, True), (5, True), (1, False)])
def test_rows_are_those_of_all_scores(spark, monkeypatch, dim, small):
    if small:
        monkeypatch.setattr(hard_negatives, "BLOCK", 50)
        monkeypatch.setattr(hard_negatives, "CHUNK", 3)
    rows = vectors(dim, 400, dim)
    assert result(spark, rows, every=10) == brute(rows, 10)


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-90, 90, (2, 64))
    parts = [summarise(x[None, :])[0].astype(float) for x in (a, b)]
    at, spreads = 0, []
    for length in segment_lengths(64):
        k = 64 // length
        mean = length * (parts[0][at:at + k] @ parts[1][at:at + k])
        spread = parts[0][at + k:at + 2 * k] @ parts[1][at + k:at + 2 * k]
        assert abs(a @ b - mean) <= spread + 1e-2
        spreads.append(spread)
        at += 2 * k
    assert spreads == sorted(spreads, reverse=True)


def test_most_pairs_are_never_scored(monkeypatch):
    """Smooth vectors: a few means say nearly all."""
    rng, scored = np.random.default_rng(3), []
    ints = np.repeat(rng.integers(-90, 90, (600, 8)), 8, axis=1) + rng.integers(-4, 4, (600, 64))
    import pyarrow as pa

    table = pa.table({
        "vec_id": np.arange(600), "mark": np.zeros(600, int), "label": np.arange(600) % 3,
        "ints": pa.array(ints.tolist()), "summary": pa.array(summarise(ints).tolist()),
    })
    plain = hard_negatives.Pairs.exact
    monkeypatch.setattr(hard_negatives.Pairs, "exact", lambda self, i, j: scored.append(len(i)) or plain(self, i, j))
    side = hard_negatives.Side(table, 64)
    i, j, score = hard_negatives._nearest(hard_negatives.Pairs(side, side, slice(0, 60)), 5)
    whole = ints[:60] @ ints.T
    whole[side.labels[:60][:, None] != side.labels[None, :]] = -10**9
    whole[np.arange(60), np.arange(60)] = -10**9
    assert np.array_equal(np.sort(score.reshape(60, 5), axis=1), np.sort(whole, axis=1)[:, -5:])
    assert sum(scored) < 60 * 200 // 5


def test_ties_repeats_and_one_hot_label(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)], 0 if i % 3 else 1) for i in range(200)]
    rows += rows[:30] + [(5, [1.0, 1.0, 1.0, 1.0], 1), (50, [1.0, 0.5, 0.0, 0.0], 2)]
    assert result(spark, rows, every=25) == brute(rows, 25)


def test_odd_rows(spark):
    rows = vectors(7, 60, 8, 2)
    rows += [
        (100, None, 1), (110, [1.0, None], 1), (120, [NAN] * 8, 1), (130, [INF] * 8, 0), (None, [1.0] * 8, 1),
        (140, [1.0] * 8, None), (150, [], 1), (160, [1.0, 2.0], 0), (170, [0.5] * 11, 1),
    ]
    assert result(spark, rows, every=10) == brute(rows, 10)
    assert result(spark, []) == []
    assert result(spark, [(0, [1.0], 1)]) == []
    wide = [(*r, "x", "y", 1) for r in rows]
    more = f"{SCHEMA}, mark string, rank string, a int"
    assert result(spark, wide, more, every=10) == brute(rows, 10)
    huge = mine_hard_negatives(spark.createDataFrame([(0, [1e300], 1), (1, [1e300], 1), (2, [1.0], 0)], SCHEMA))
    assert huge.collect() == []
