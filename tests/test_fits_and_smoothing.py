"""Fits find planted parameters; smoothers and searches agree with plain forms of themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.operators import model as V
from fluxloom.operators import smoothing as H
from fluxloom.operators import spatial as G
from fluxloom.operators import stack as S
from fluxloom.operators import training as L
from fluxloom.sources import config as C

SCHEMA = "veg_class int, t2m double, tcorr double, evi double, W2 double, par double, Ps double, Ws double, Ts double"


def rows(rng, n=600):
    out = []
    for cls in (1, 2):
        for k in range(n):
            t = float(rng.uniform(-5, 30))
            out.append((cls, t, t, *map(float, rng.uniform(0.1, 0.9, 2)), 0.0 if k % 3 == 0 else float(rng.uniform(10, 1500)), *map(float, rng.uniform(0.2, 1, 3))))
    return out


def test_modified_fit_finds_planted_parameters(spark):
    rng, coefficients = np.random.default_rng(3), [2.0, 0.1, 0.002, 1.5, 0.4, 0.03, 0.001]
    df = spark.createDataFrame(rows(rng), SCHEMA)
    d = F.when(F.col("t2m") < 6, 6 - 0.4 * (6 - F.col("t2m"))).otherwise(F.col("t2m"))
    w = F.col("W2")
    respiration = sum(c * t for c, t in zip(coefficients, (F.lit(1.0), d, d * d, F.col("evi"), w, w * d, w * d * d), strict=True))
    light = F.col("Ps") * F.col("Ws") * F.col("Ts") * F.col("evi") * F.col("par") / (1 + F.col("par") / 300)
    df = df.withColumn("nee", respiration - 0.2 * F.col("veg_class") * light)
    dark = V.fit_modified_respiration(df, [0.0, 6.0, 12.0], [0.2, 0.4])
    assert {(r["veg_class"], r["tcrit"], r["tmult"]) for r in dark.collect()} == {(1, 6.0, 0.4), (2, 6.0, 0.4)}
    for r in V.fit_modified_nee(df, dark, [75.0, 150.0, 300.0, 600.0]).collect():
        assert r["par0"] == pytest.approx(300) and r["lamb"] == pytest.approx(0.2 * r["veg_class"], rel=1e-6) and r["mse"] < 1e-9
        assert [r[m] for m in V.MODIFIED] == pytest.approx(coefficients, rel=1e-5)


def test_lowess_windows_equal_all_distances():
    rng = np.random.default_rng(5)
    x = np.sort(rng.choice(900, 70, replace=False)).astype(float)
    y, at, k = np.sin(x / 90) + rng.normal(0, 0.1, 70), np.array([0.0, 55.0, 200.5, 899.0]), 17

    def lines(points, robust):
        distance = np.abs(points[:, None] - x[None, :])
        reach = np.sort(distance, axis=1)[:, k - 1 : k]
        w = np.where(distance < reach, (1 - np.minimum(1, distance / reach) ** 3) ** 3, 0) * robust
        out = []
        for p, own in zip(points, w, strict=True):
            slope, centre = np.polyfit(x, y, 1, w=np.sqrt(own))
            out.append(slope * p + centre)
        return np.array(out)

    robust = np.ones(70)
    for _ in range(3):
        miss = np.abs(y - lines(x, robust))
        robust = np.clip(1 - (miss / (6 * np.median(miss))) ** 2, 0, None) ** 2
    assert H.lowess_fit(x, y, at, 0.25, 3) == pytest.approx(lines(at, robust), abs=1e-7)


def test_kalman_equals_a_least_squares_path(spark, monkeypatch):
    """The smoother's means are the most likely path of a random walk; few series a call."""
    monkeypatch.setattr(H, "TOGETHER", 2)
    rng, last, q, r = np.random.default_rng(6), 25, 0.01, 0.05
    seen = {(x, 0): {int(d): float(rng.normal()) for d in rng.choice(last + 1, 9, replace=False)} for x in range(7)}
    df = spark.createDataFrame([(x, y, d, v) for (x, y), s in seen.items() for d, v in s.items()], "x long, y long, day long, evi double")
    got = {}
    for row in H.kalman(df, "evi", last).collect():
        got.setdefault((row["x"], row["y"]), {})[row["day"]] = row["evi"]
    for key, s in seen.items():
        h, g = np.zeros((last + 1, last + 1)), np.zeros(last + 1)
        h[0, 0], g[0] = 1.0, s[min(s)]  # the prior: variance 1
        for d in range(last):
            h[d, d] += 1 / q
            h[d + 1, d + 1] += 1 / q
            h[d, d + 1] -= 1 / q
            h[d + 1, d] -= 1 / q
        for d, v in s.items():
            h[d, d] += 1 / r
            g[d] += v / r
        assert [got[key][d] for d in range(last + 1)] == pytest.approx(np.linalg.solve(h, g))


def test_nearest_search_over_far_gaps(spark):
    rng = np.random.default_rng(7)
    cells = [(int(x), int(y), 9) for x, y in {tuple(p) for p in rng.integers(0, 200, (300, 2)).tolist()}]
    wanted = [(500, 500, 1), (0, 203, 2), (203, 0, 3)]
    grid = spark.createDataFrame(cells + wanted, "x long, y long, code int")
    got = {(r["x"], r["y"]): r["code"] for r in G.nearest_of_class(grid, 9, [1, 2, 3]).collect()}
    for x, y, _ in cells:
        assert got[x, y] == min(((x - a) ** 2 + (y - b) ** 2, a, b, c) for a, b, c in wanted)[3]
    assert G.nearest_of_class(grid.where("code = 9"), 9, [1]).where("code <> 9").count() == 0
    assert G.nearest_of_class(grid.where(F.lit(False)), 9, [1]).count() == 0


def test_numbers_of_ranges_run_on(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 3)
    out = L.numbered(df, ["g"], L.hash_rank("id"), "id").collect()
    for g in range(3):
        own = sorted((r for r in out if r["g"] == g), key=lambda r: r["_rn"])
        assert [r["_rn"] for r in own] == list(range(1, len(own) + 1)) and own[0]["_n"] == len(own)


def test_class_configuration_from_a_file(spark, tmp_path):
    path = tmp_path / "classes.yaml"
    path.write_text("forest:\n  veg_class: 1\n  class_numbers: [20, 21]\n  tmin: -4\n  topt: 15\n  tmax: 38\ncity:\n  veg_class: 8\n  class_numbers: [50]\n")
    lc_map, coefficients = C.load_class_config(spark, str(path))
    assert {tuple(r) for r in lc_map.collect()} == {(20, 1), (21, 1), (50, 8)}
    assert [tuple(r) for r in coefficients.collect()] == [(1, -4.0, 15.0, 38.0, -4.0)]
