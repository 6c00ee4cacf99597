"""Smoothers in blocks, and quantiles by search, equal their plain forms."""

import numpy as np
import pytest

from fluxloom.operators import quantiles as Q
from fluxloom.operators import smoothing as H
from fluxloom.operators import spatial as G
from fluxloom.operators import stack as S


def series(n, seed):
    rng = np.random.default_rng(seed)
    x = np.sort(rng.choice(4 * n, n, replace=False))
    y = np.sin(x / n) + rng.normal(0, 0.2, n) + (rng.random(n) < 0.02) * 5
    return x, y


@pytest.mark.parametrize("frac", [0.02, 0.3])
def test_lowess_in_blocks_equals_whole_series(spark, frac):
    long, short = series(1500, 1), series(60, 2)
    rows = [(k, 0, int(a), float(b)) for k, (x, y) in enumerate((long, short)) for a, b in zip(x, y, strict=True)]
    stack = spark.createDataFrame(rows + [(2, 0, 5, None)], "x long, y long, day long, v double").repartition(5)
    days = [0, 3, 700, 2222, 5999, 6100]
    got = H.lowess(stack, "v", days, frac=frac, short=100, block=64)
    found = {(r.x, r.day): r.v for r in got.collect()}
    for k, (x, y) in enumerate((long, short)):
        f = frac
        while not np.isfinite(want := H.lowess_fit(x.astype(float), y, np.array(days, float), f, 3)).all():
            f += 0.05
        assert [found[k, d] for d in days] == pytest.approx(want.tolist(), abs=1e-9)
    assert len(found) == 12


def test_lowess_in_blocks_tries_again_with_more_points(spark):
    x, y = series(300, 3)
    stack = spark.createDataFrame([(0, 0, int(a), float(b)) for a, b in zip(x, y, strict=True)], "x long, y long, day long, v double")
    got = H.lowess(stack, "v", [10, 20], frac=0.005, short=100, block=16).orderBy("day").collect()
    want = H.lowess_fit(x.astype(float), y, np.array([10.0, 20.0]), 0.055, 3)
    assert [r.v for r in got] == pytest.approx(want.tolist(), abs=1e-9)


@pytest.mark.parametrize("block", [1, 7, 64, 400])
def test_kalman_in_blocks_equals_whole_series(spark, block):
    rng = np.random.default_rng(4)
    seen = rng.normal(0, 1, (3, 333)).cumsum(axis=1)
    seen[rng.random(seen.shape) < 0.6] = np.nan
    seen[1, :100] = seen[1, 200:300] = np.nan
    seen[2, 40:] = np.nan
    rows = [(k, 5, d, float(v)) for k, s in enumerate(seen) for d, v in enumerate(s) if np.isfinite(v)]
    stack = spark.createDataFrame(rows + [(9, 5, 1, None)], "x long, y long, day long, v double").repartition(5)
    got = H.kalman(stack, "v", 332, block=block)
    found = {(r.x, r.day): r.v for r in got.collect()}
    assert len(found) == 3 * 333
    want = H.kalman_fit(seen, 0.01, 0.05)
    assert max(abs(found[k, d] - want[k, d]) for k in range(3) for d in range(333)) < 1e-9


def test_quantiles_of_large_groups_equal_percentile(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(0, 1, 4001), "b": np.r_[np.full(3000, 2.5), rng.normal(0, 1e6, 999)], "c": rng.integers(0, 4, 2000).astype(float), None: rng.exponential(1e-9, 1500), "small": rng.normal(0, 1, 20), "same": np.full(1200, -3.0)}
    groups["a"][7] = 1e300
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    asked = {"low": 0.05, "middle": 0.5, "high": 0.9, "top": 1.0}
    found = {r.k: r for r in Q.exact_quantiles(df, ["k"], "v", asked, small=1000, few=10).collect()}
    assert set(found) == {*groups, "none"} and found["none"].middle is None
    for k, vs in groups.items():
        assert [found[k][n] for n in asked] == pytest.approx([float(np.quantile(vs, q)) for q in asked.values()], rel=1e-12)
    every = np.concatenate(list(groups.values()))
    assert Q.exact_quantiles(df, [], "v", {"m": 0.5}, small=100, few=10).first().m == pytest.approx(np.median(every), rel=1e-12)
    assert Q.exact_quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0


@pytest.mark.parametrize("buckets", [0, 1, 3, 50, 1000])
def test_nearest_scene_in_buckets_of_time(spark, buckets):
    rng = np.random.default_rng(6)
    scenes = [(p, int(d), float(d) + p) for p in range(4) for d in sorted({*rng.integers(0, 40, 5), *rng.integers(300, 420, 6)})] + [(4, 200, 1.5)]
    rows = [(int(rng.integers(0, 6)) if k % 3 else 0, float(rng.integers(-10, 440)) / 2, k) for k in range(600)]
    got = G.nearest_in_time(spark.createDataFrame(rows, "p long, day double, k long"), spark.createDataFrame(scenes, "p long, day long, v double"), ["p"], buckets=buckets)
    end, want = max(d for _, d, _ in scenes), []
    for p, t, k in rows:
        own = [(abs(t - d), d, v) for q, d, v in scenes if q == p]
        if own and 0 <= t <= end:
            _, d, v = min(own)
            want.append((p, t, k, d, v))
    assert sorted((r.p, r.day, r.k, r.scene_day, r.v) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("size", [1, 3, 9, 31])
def test_box_means_equal_copies_of_each_pixel(spark, size):
    rng = np.random.default_rng(7)
    cells = {(int(x), int(y)): None if rng.random() < 0.2 else float(rng.normal()) for x, y in rng.integers(-4, 18, (150, 2))}
    grid = spark.createDataFrame([(x, y, v) for (x, y), v in cells.items()], "x long, y long, v double")
    half = size // 2
    copies = {(i, j): 1.0 for i in range(-half, half + 1) for j in range(-half, half + 1)}
    rows = lambda df: {(r.x, r.y): r.v for r in df.collect()}
    got, want = rows(S.smear(grid, "v", size)), rows(S.smear(grid, "v", size, kernel=copies))
    assert set(got) == set(cells) and {k for k, v in got.items() if v is None} == {k for k, v in want.items() if v is None}
    assert all(v is None or v == pytest.approx(want[k], abs=1e-9) for k, v in got.items())
