"""Hand-made cases and invariants of the operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.functions import expr as X
from fluxloom.functions import masks as M
from fluxloom.functions import physics as P
from fluxloom.operators import footprint as K
from fluxloom.operators import model as V
from fluxloom.operators import smoothing as H
from fluxloom.operators import spatial as G
from fluxloom.operators import stack as S
from fluxloom.operators import training as L
from fluxloom.sources import config as C


def one(spark, c, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_z")).select(c.alias("v")).first()["v"]


def test_missing_stays_missing(spark):
    null = F.lit(None).cast("double")
    assert one(spark, X.at_least(null, 0)) is None
    assert one(spark, X.clip(null, 0, 1)) is None
    assert one(spark, X.safe_divide(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, X.safe_divide(F.lit(1.0), F.lit(0.0), 7)) == 7
    assert one(spark, X.clip(F.lit(1.5), 0, 1, to_null=True)) is None
    assert one(spark, X.sentinel(F.lit(-9999.0))) is None


def test_cloud_overrides_snow(spark):
    px = spark.createDataFrame([(11, 0.5), (9, 0.5), (4, 0.5), (7, 0.5)], "scl int, nir double")
    p = M.PRODUCTS["sentinel2"]
    got = M.apply_masks(M.mask_bad(px, p), p, ["nir"]).collect()
    assert [(r["is_snow"], r["nir"]) for r in got] == [(True, None), (False, None), (False, 0.5), (False, None)]


def test_a_snowy_scene_makes_the_day_snow(spark):
    t = dt.datetime(2020, 1, 1, 5)
    rows = [(0, 0, t, False, 0.2), (0, 0, t + dt.timedelta(hours=3), True, None), (0, 0, t + dt.timedelta(days=2), False, 0.4), (0, 0, t + dt.timedelta(days=2, hours=1), False, 0.6), (0, 0, t + dt.timedelta(days=3), False, None)]
    got = S.merge_same_day(spark.createDataFrame(rows, "x int, y int, scene_ts timestamp, is_snow boolean, evi double"), ["evi"]).orderBy("day").collect()
    assert [(r["day"], r["is_snow"], r["evi"]) for r in got] == [(0, True, None), (2, False, 0.5), (3, False, None)]


def test_snow_runs(spark):
    v = [0.5, None, None, 0.7, None, 0.6]
    snow = [False, True, True, False, True, False]
    rows = [(0, 0, k, s, x) for k, (s, x) in enumerate(zip(snow, v, strict=True))]
    got = S.replace_snow_runs(spark.createDataFrame(rows, "x int, y int, day long, is_snow boolean, evi double"), "evi", 2).orderBy("day").collect()
    low = np.quantile([0.5, 0.7, 0.6], 0.05)
    assert [r["evi"] if r["evi"] is None else round(r["evi"], 9) for r in got] == [0.5, round(low, 9), round(low, 9), 0.7, None, 0.6]


def test_nearest_scene_ties_take_the_earlier(spark):
    scenes = spark.createDataFrame([(1, 0, 10.0), (1, 10, 20.0), (2, 4, 1.0)], "site int, day int, evi double")
    rows = spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (1, 0, "c"), (1, 11, "late"), (2, 9, "d"), (3, 1, "none")], "site int, day int, k string")
    got = {r["k"]: (r["scene_day"], r["evi"]) for r in G.nearest_in_time(rows, scenes, ["site"]).collect()}
    assert got == {"a": (0, 10.0), "b": (10, 20.0), "c": (0, 10.0), "d": (4, 1.0)}


def test_longitudes_wrap(spark):
    m = spark.createDataFrame([(x, 0.0) for x in (-179.0, -10.0, 0.0, 10.0, 179.0)], "lon double, lat double")
    assert sorted(r["lon"] for r in G.met_select(m, lon=(170, -170)).collect()) == [-179.0, 179.0]
    assert one(spark, P.lon180(F.lit(190.0))) == -170.0 and one(spark, P.lon360(F.lit(-10.0))) == 350.0
    with pytest.raises(ValueError, match="together"):
        G.met_select(m, t0=1)


def test_sinusoidal_round_trip_and_tiles(spark):
    x, y = P.sinusoidal(F.lit(10.5), F.lit(48.1))
    lon, lat = P.sinusoidal_inverse(x, y)
    assert math.isclose(one(spark, lon), 10.5) and math.isclose(one(spark, lat), 48.1)
    h, v = P.lonlat_to_tile(F.lit(10.5), F.lit(48.1))
    assert (one(spark, h), one(spark, v)) == (18, 4)
    assert one(spark, P.tile3deg_name(F.lit(-0.5), F.lit(-179.5))) == "S03W180"


def test_regridding_a_constant_gives_the_constant(spark):
    fine, coarse = G.axis(12, 0.0, 1.0, spark), G.axis(5, 0.7, 2.4, spark)
    w = G.conservative_weights(fine, fine, coarse, coarse)
    values = spark.range(144).select((F.col("id") % 12).alias("sx"), F.floor(F.col("id") / 12).alias("sy"), F.lit(3.5).alias("v"))
    full = G.coverage(w, ["dx", "dy"]).where("is_fully_covered")
    got = G.regrid(values, w, "v", ["sx", "sy"], ["dx", "dy"]).join(full, ["dx", "dy"]).collect()
    assert len(got) == 25 and all(math.isclose(r["v"], 3.5) for r in got)


def test_lowess_reproduces_a_line_and_kalman_a_constant(spark):
    rows = [(0, 0, d, 0.2 + 0.001 * d, 0.4) for d in range(0, 120, 3)] + [(1, 1, d, None, None) for d in range(0, 120, 3)]
    stack = spark.createDataFrame(rows, "x int, y int, day long, line double, flat double")
    got = H.lowess(stack, "line", [0, 10, 55, 119]).orderBy("day").collect()
    assert [r["x"] for r in got] == [0] * 4
    assert np.allclose([r["line"] for r in got], [0.2, 0.21, 0.255, 0.319], atol=1e-9)
    flat = H.kalman(stack, "flat", 119).collect()
    assert len(flat) == 120 and np.allclose([r["flat"] for r in flat], 0.4)


def test_kalman_equals_a_plain_filter(spark):
    rng = np.random.default_rng(1)
    obs = {int(d): float(v) for d, v in zip(range(0, 60, 4), rng.normal(size=15), strict=True)}
    stack = spark.createDataFrame([(0, 0, d, v) for d, v in obs.items()], "x int, y int, day long, v double")
    m, p, steps = obs[0], 1.0, []
    for d in range(60):
        mp, pp = m, p if d == 0 else p + 0.01
        k = pp / (pp + 0.05) if d in obs else 0.0
        m, p = mp + k * (obs.get(d, mp) - mp), (1 - k) * pp
        steps.append((m, p, mp, pp))
    out = [steps[-1][0]]
    for d in range(58, -1, -1):
        out.append(steps[d][0] + steps[d][1] / steps[d + 1][3] * (out[-1] - steps[d + 1][2]))
    got = [r["v"] for r in H.kalman(stack, "v", 59).orderBy("day").collect()]
    assert np.allclose(got, out[::-1])


def test_temperature_scale(spark):
    df = spark.createDataFrame([(15.0,), (-5.0,), (38.0,), (50.0,), (10.0,)], "t double").withColumns({"tmin": F.lit(-4.0), "topt": F.lit(15.0), "tmax": F.lit(38.0)})
    got = [r["s"] for r in df.select(V.t_scale("t").alias("s")).collect()]
    assert got[0] == 1 and got[1] == got[3] == 0 and got[2] == 0 and 0 < got[4] < 1


def test_planted_parameters_are_found(spark):
    rng = np.random.default_rng(2)
    rows = []
    for cls, (lamb, par0, a, b) in {1: (0.2, 400.0, 0.2, 1.0), 2: (0.1, 250.0, 0.3, -1.0)}.items():
        for k in range(300):
            par, t, evi = (0.0 if k % 3 == 0 else float(rng.uniform(10, 1500))), float(rng.uniform(-5, 30)), float(rng.uniform(0.2, 0.8))
            nee = max(a * t + b, 0) - lamb * evi * par / (1 + par / par0)
            rows.append((cls, par, t, evi, 1.0, 1.0, 1.0, nee))
    df = spark.createDataFrame(rows, "veg_class int, par double, tcorr double, evi double, Ps double, Ws double, Ts double, nee double")
    dark = V.fit_respiration(df)
    found = {r["veg_class"]: r for r in dark.collect()}
    assert math.isclose(found[1]["alpha"], 0.2, rel_tol=0.05) and found[2]["mse"] < 0.05
    start = V.fit_nee(df, dark, [100, 200, 400, 800])
    start = start.select("veg_class", "lamb", "par0").join(dark.select("veg_class", "alpha", "beta"), "veg_class")
    fitted = {r["veg_class"]: r for r in V.fit_combined(df, start, steps=12).collect()}
    for cls, want in {1: (0.2, 400.0), 2: (0.1, 250.0)}.items():
        assert math.isclose(fitted[cls]["lamb"], want[0], rel_tol=0.02) and math.isclose(fitted[cls]["par0"], want[1], rel_tol=0.02)


def test_footprints_sum_to_one_after_normalising(spark):
    obs = spark.createDataFrame([("s", 1, 3.0, 0.4, 200.0, -0.1, 10.0), ("s", 2, 2.0, -9999.0, 20.0, 0.2, 10.0)], "site string, t int, u double, ustar double, wd double, zl double, z double")
    cells = K.grid(spark, 1500.0, 50)
    for f in (K.ffp(K.inputs(obs), cells), K.km(K.inputs(obs), cells)):
        sums = {r["t"]: r["s"] for r in K.normalise(f, ["site", "t"]).groupBy("t").agg(F.sum("footprint").alias("s")).collect()}
        assert math.isclose(sums[1], 1.0) and sums[2] is None
    assert all(math.isclose(one(spark, K.gamma(F.lit(x))), math.gamma(x), rel_tol=1e-10) for x in (0.3, 1.0, 1.7, 4.2))


def test_folds_are_disjoint_and_complete(spark):
    times = spark.range(103).select(F.col("id").alias("t"))
    got = L.split_random(times, ["t"], 4, 0.2).toPandas()
    assert (got.groupby("fold").size() == 103).all()
    assert (got[got.role == "test"].groupby("t").size() == 1).all()
    assert sorted(got[got.role == "test"].groupby("fold").size()) == [25, 26, 26, 26]


def test_lags_must_be_positive(spark):
    with pytest.raises(ValueError, match="positive"):
        L.lag_matrix(spark.range(3).select("id"), ["id"], ["id"], [0])


def test_class_config(spark):
    lc_map, coef = C.load_class_config(spark, {"a": {"veg_class": 1, "class_numbers": [-1], "tmin": -4, "topt": 15, "tmax": 38}, "b": {"veg_class": 2, "class_numbers": [-1, 30]}})
    assert {r["code"]: r["veg_class"] for r in lc_map.collect()} == {-1: 2, 30: 2}
    assert [tuple(r) for r in coef.collect()] == [(1, -4.0, 15.0, 38.0, -4.0)]


def test_streaming_days(spark, tmp_path):
    from fluxloom.streaming.incremental import daily_scenes

    t = dt.datetime(2020, 1, 1, 5)
    rows = [(0, 0, t + dt.timedelta(hours=9 * k), k == 3, float(k)) for k in range(40)]
    spark.createDataFrame(rows, "x int, y int, scene_ts timestamp, is_snow boolean, evi double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("x int, y int, scene_ts timestamp, is_snow boolean, evi double").parquet(f"{tmp_path}/in")
    q = daily_scenes(stream, ["evi"]).writeStream.format("memory").queryName("days").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {str(r["date"]): r["evi"] for r in spark.table("days").collect()}
    assert got["2020-01-01"] == (0 + 1 + 2) / 3
    assert got["2020-01-02"] is None
