"""Training tables, cross-validation folds, losses and response curves."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import at_least, col, safe_divide


def hash_rank(*cols: str, seed: str = "42") -> Column:
    return F.md5(F.concat(*[F.col(c).cast("string") for c in cols], F.lit(seed)))


def hours_since_rain(df: DataFrame, keys: list[str], rain: str, threshold: float = 0.1, step: float = 0.5, ts: str = "t") -> DataFrame:
    """Hours since the last rain above the threshold, missing before the first."""
    w = Window.partitionBy(*keys).orderBy(ts)
    df = df.withColumn("_n", F.row_number().over(w))
    last = F.last(F.when(F.col(rain) > threshold, F.col("_n")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("hours_since_rain", (F.col("_n") - last) * step).drop("_n")


def rolling_sum(df: DataFrame, keys: list[str], value: str, n: int, ts: str = "t", out: str = "rolling") -> DataFrame:
    """Sum of the last n rows, this one included; fewer at the start."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(-(n - 1), 0)
    return df.withColumn(out, F.sum(value).over(w))


def lag_matrix(df: DataFrame, keys: list[str], values: list[str], lags: list[int], ts: str = "t") -> DataFrame:
    """An array of the row and its lags for each value; rows that lack one are dropped."""
    if any(k <= 0 for k in lags):
        raise ValueError("lags are positive")
    w = Window.partitionBy(*keys).orderBy(ts)
    df = df.withColumns({f"{v}_{k}": F.lag(v, k).over(w) for v in values for k in lags})
    df = df.dropna(subset=[*values, *[f"{v}_{k}" for v in values for k in lags]])
    names = [f"{v}_{k}" for v in values for k in lags]
    return df.withColumns({f"{v}_lags": F.array(v, *[f"{v}_{k}" for k in lags]) for v in values}).drop(*names)


def skip_first(df: DataFrame, keys: list[str], k: int, ts: str = "t") -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(ts))
    return df.withColumn("_n", n).where(F.col("_n") > k).drop("_n")


def losses(y: str, sigma: str, predicted: str, floor: float = 0.4) -> list[Column]:
    """Gaussian and Laplace negative log-likelihood and mean square, as aggregates."""
    s = F.greatest(F.col(sigma), F.lit(floor))
    miss = F.col(y) - F.col(predicted)
    b = s / math.sqrt(2)
    return [
        F.avg(miss * miss / (2 * s * s) + 0.5 * F.ln(2 * math.pi * s * s)).alias("gaussian_nll"),
        F.avg(F.abs(miss) / b + F.ln(2 * b)).alias("laplace_nll"),
        F.avg(miss * miss).alias("mse"),
    ]


def gpp_ceiling(gpp: str, weight: float = 1.0, ceiling: float = 40.0) -> Column:
    return weight * F.avg(at_least(F.col(gpp) - ceiling, 0))


def ratio_penalty(df: DataFrame, pixel: list[str], most: float, floor: float = 1.0) -> DataFrame:
    """One row: mean excess of daytime Reco / GPP over the pixels that exceed the ratio."""
    day = lambda c: F.sum(F.when(F.col("is_day"), F.col(c)))
    ratio = df.groupBy(*pixel).agg((day("reco") / F.greatest(day("gpp"), F.lit(floor)) - most).alias("excess"))
    return ratio.where("excess > 0").agg(F.coalesce(F.avg("excess"), F.lit(0.0)).alias("penalty"))


def sample_weights(df: DataFrame, a: str, b: str, role: str = "role", bins: int = 20, alpha: float = 0.5, most: float = 5.0) -> DataFrame:
    """Weights 1 / count ** alpha of two-dimensional bins of the training rows (1 for bins without
    any), over their mean and at most `most`. The top edge falls in a bin of its own."""
    train = F.col(role) == "train"
    edge = df.where(train).agg(*[f(c).alias(f"_{n}{i}") for i, c in enumerate((a, b)) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    binned = df.crossJoin(F.broadcast(edge))
    for i, c in enumerate((a, b)):
        width = (F.col(f"_hi{i}") - F.col(f"_lo{i}")) / bins
        binned = binned.withColumn(f"_b{i}", F.floor(safe_divide(F.col(c) - F.col(f"_lo{i}"), width, 0)).cast("int"))
    counts = binned.where(train).groupBy("_b0", "_b1").agg(F.count("*").alias("_n"))
    raw = F.coalesce(1 / F.pow(F.col("_n"), alpha), F.lit(1.0))
    weighted = binned.join(F.broadcast(counts), ["_b0", "_b1"], "left").withColumn("_raw", raw)
    mean = weighted.where(train).agg(F.avg("_raw").alias("_mean"))
    weighted = weighted.crossJoin(F.broadcast(mean)).withColumn("weight", F.least(F.lit(most), F.col("_raw") / F.col("_mean")))
    return weighted.select(*df.columns, "weight")


#: Draws that one row of a plan makes.
DRAWS = 100_000


def numbered(df: DataFrame, by: list[str], order: Column, *keys: str) -> DataFrame:
    """Add _rn, the number of a row in its group by a hash (hexadecimal) and keys, from 1 on, and
    _n, the group's rows. Rows are numbered in ranges of the hash, and the rows of the ranges
    before are added, so no task holds a group."""
    df = df.withColumn("_hash", order).withColumn("_range", F.substring("_hash", 1, 3))
    sizes = df.groupBy(*by, "_range").agg(F.count("*").alias("_k"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_k").over(before), F.lit(0)), "_n": F.sum("_k").over(Window.partitionBy(*by))}).drop("_k")
    rn = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_hash", *keys))
    return df.join(sizes, [*by, "_range"]).withColumn("_rn", rn + F.col("_before")).drop("_hash", "_range", "_before")


def temperature_balance(df: DataFrame, t: str, keys: list[str], factor: int = 2, lo: int = -2, hi: int = 30, step: int = 4) -> DataFrame:
    """Draw rows with replacement so that each right-closed temperature bin has the least of
    factor times its rows and the largest bin's rows. Draws are by hash, the same in each run."""
    b = F.when((F.col(t) > lo) & (F.col(t) <= hi), F.ceil((F.col(t) - lo) / step).cast("int"))
    df = df.withColumn("bin", b).where("bin IS NOT NULL")
    sizes = df.groupBy("bin").agg(F.count("*").alias("n"))
    sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.max("n").alias("top")))).select("bin", "n", F.least(F.col("n") * factor, "top").alias("draws"))
    # Draws are made in blocks, so that a large bin's draws are not one row's.
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("draws") - 1) / DRAWS)))
    draws = sizes.withColumn("block", blocks).repartition("bin", "block")
    draws = draws.withColumn("draw", F.explode(F.sequence(F.col("block") * DRAWS + 1, F.least("draws", (F.col("block") + 1) * DRAWS))))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", "bin", "draw", F.lit("42"))), 1, 12), 16, 10).cast("long") % F.col("n") + 1
    rows = numbered(df, ["bin"], hash_rank(*keys), *keys).withColumnRenamed("_rn", "rn").drop("_n")
    return draws.select("bin", pick.alias("rn")).join(rows, ["bin", "rn"]).drop("rn")


def split_random(times: DataFrame, keys: list[str], k: int, val: float, test: float = 0.0) -> DataFrame:
    """Roles of each time in each fold, of exact sizes, by hash order. One fold: int(n * test),
    then int(rest * val). More: sizes n // k, one more for the first n % k; validation from the
    rest of each fold."""
    ranked = numbered(times.select(*keys).distinct().withColumn("_all", F.lit(0)), ["_all"], hash_rank(*keys), *keys)
    ranked = ranked.withColumn("_rank", F.col("_rn") - 1).drop("_rn", "_all")
    if k == 1:
        tests = F.floor(F.col("_n") * test)
        vals = F.floor((F.col("_n") - tests) * val)
        role = F.when(F.col("_rank") < tests, "test").when(F.col("_rank") < tests + vals, "val").otherwise("train")
        return ranked.select(*keys, F.lit(0).alias("fold"), role.alias("role"))
    size, extra = F.floor(F.col("_n") / k), F.col("_n") % k
    first = extra * (size + 1)
    own = F.when(F.col("_rank") < first, F.floor(F.col("_rank") / (size + 1))).otherwise(extra + F.floor((F.col("_rank") - first) / F.greatest(size, F.lit(1))))
    folds = ranked.withColumn("_own", own).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).drop("_n")
    folds = folds.withColumn("_rest", F.col("_own") != F.col("fold"))
    folds = numbered(folds, ["fold", "_rest"], hash_rank(*keys, seed="val"), *keys)
    role = F.when(~F.col("_rest"), "test").when(F.col("_rn") <= F.floor(F.col("_n") * val), "val").otherwise("train")
    return folds.select(*keys, "fold", role.alias("role"))


def split_daywise(times: DataFrame, keys: list[str], k: int, val: float, block_days: int, ts: str = "t", test: float = 0.2) -> DataFrame:
    """Folds by blocks of consecutive days that have rows; one fold has at least one block of
    each role."""
    days = times.select(F.to_date(ts).alias("_date")).distinct()
    rank = F.dense_rank().over(Window.orderBy("_date")) - 1  # a row for each day
    blocks = days.withColumn("block", F.floor(rank / block_days).cast("long"))
    names = blocks.select("block").distinct()
    if k == 1:
        n = F.count("*").over(Window.partitionBy(F.lit(1)))
        order = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(hash_rank("block"), "block")) - 1
        tests = F.greatest(F.lit(1), F.floor(n * test))
        vals = F.greatest(F.lit(1), F.floor((n - tests) * val))
        role = F.when(order < tests, "test").when(order < tests + vals, "val").otherwise("train")
        roles = names.select("block", F.lit(0).alias("fold"), role.alias("role"))
    else:
        roles = split_random(names, ["block"], k, val)
    dated = times.withColumn("_date", F.to_date(ts)).join(F.broadcast(blocks), "_date")
    return dated.join(F.broadcast(roles), "block").select(*keys, "block", "fold", "role")


def split_years(times: DataFrame, keys: list[str], n_test: int = 1, val: float = 0.15, ts: str = "t") -> DataFrame:
    """The last years are for testing, validation takes whole days of the others."""
    years = times.select(F.year(ts).alias("_year")).distinct().withColumn("_back", F.dense_rank().over(Window.orderBy(F.desc("_year"))))
    days = times.select(F.to_date(ts).alias("_date")).distinct().withColumn("_year", F.year("_date")).join(F.broadcast(years), "_year")
    test = F.col("_back") <= n_test
    order = F.row_number().over(Window.partitionBy(test).orderBy(hash_rank("_date"), "_date"))
    n = F.count("*").over(Window.partitionBy(test))
    days = days.withColumn("role", F.when(test, "test").when(order <= F.floor(n * val), "val").otherwise("train")).select("_date", "role")
    return times.withColumn("_date", F.to_date(ts)).join(F.broadcast(days), "_date").select(*keys, "role")


def ice(samples: DataFrame, feature: str, points: int, score: Callable[[], Column], low: float = 0.03, pad: float = 0.0) -> DataFrame:
    """Response of each sample to a feature set to values from its 3rd percentile to its maximum."""
    span = samples.agg((F.percentile(feature, low) - pad).alias("_lo"), (F.max(feature) + pad).alias("_hi"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    grid = span.select("_lo", "_hi", steps.alias("step")).select("step", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("step") / max(1, points - 1)).alias("_at"))
    wide = samples.drop(feature).crossJoin(F.broadcast(grid)).withColumnRenamed("_at", feature)
    return wide.withColumn("response", score())


def pdp(curves: DataFrame, feature: str) -> DataFrame:
    """Median and 5-95 % band of the responses at each grid value."""
    return curves.groupBy("step", feature).agg(*[F.percentile("response", p).alias(n) for p, n in ((0.5, "median"), (0.05, "p05"), (0.95, "p95"))])


def normalised_curves(curves: DataFrame, keys: list[str]) -> DataFrame:
    top = F.max("response").over(Window.partitionBy(*keys))
    return curves.withColumn("response", safe_divide("response", F.nullif(top, F.lit(0.0))))


def random_subsample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """n rows by hash order, the same in each run."""
    return df.orderBy(hash_rank(*keys), *keys).limit(n)


#: Inputs of the two branches of a partitioning model, in order.
BRANCHES = {"gpp": ["par", "t2m", "vpd", "nirv"], "reco": ["t2m", "swc", "nirv"]}


def feature_matrix(df: DataFrame, branch: str, out: str = "features") -> DataFrame:
    """The inputs of a branch as one vector column for pyspark.ml."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=[c for c in BRANCHES[branch] if c in df.columns], outputCol=out, handleInvalid="skip").transform(df)


def day_mask(sw_pot: str = "sw_in_pot") -> Column:
    return col(sw_pot) > 0


def flux_mask(fractions: DataFrame, pixel: list[str], cls: int = 7, most: float = 0.99) -> DataFrame:
    share = F.coalesce(F.sum(F.when(F.col("veg_class") == cls, F.col("frac"))), F.lit(0.0))
    return fractions.groupBy(*pixel).agg((share < most).alias("flux_mask"))


def training_table(obs: DataFrame, stack: DataFrame, met: DataFrame, keys: list[str], met_ts: str = "valid_time") -> DataFrame:
    """Samples with stack values of their day and weather of the nearest hour, gaps as 0."""
    from .towers import met_at_towers

    joined = met_at_towers(obs, met, keys, met_ts=met_ts).join(stack, [*keys, "day"], "left")
    gaps = [c for c, kind in joined.dtypes if kind == "double" and c not in obs.columns]
    return joined.fillna(0.0, gaps)


def upscaling_table(met: DataFrame, stack: DataFrame, keys: list[str]) -> DataFrame:
    """The same for all pixels at requested times (columns keys, day, weather)."""
    joined = met.join(stack, [*keys, "day"], "left")
    return joined.fillna(0.0, [c for c, kind in stack.dtypes if kind == "double" and c not in keys])


def training_cube(samples: DataFrame, footprints: DataFrame, stack: DataFrame, classes: DataFrame, keys: list[str], cell: list[str]) -> DataFrame:
    """Each sample (keys, day, weather and flux) at each cell of its footprint (keys, cell,
    footprint), with the cell's stack values of the day and its land cover; gaps are 0."""
    values = [c for c, kind in stack.dtypes if kind == "double"] + [c for c in classes.columns if c not in cell]
    cube = footprints.join(samples, keys).join(stack, [*cell, "day"], "left").join(classes, cell, "left")
    return cube.fillna(0.0, ["footprint", *values])


def base_dataset(cube: DataFrame, keys: list[str], at: str = "step", flags: tuple[int, ...] = (0,), qc: str = "qc", least_share: float = 1e-6, least: float = 1e-5, lag: int = 0) -> DataFrame:
    """What a model is trained on: the cells that hold the site's footprint, times with a footprint
    and a good flux, without each site's first `lag` of them; a time's footprint sums up to 1."""
    from .footprint import crop_to_mass
    from .towers import qc_filter

    cropped = crop_to_mass(cube, keys, least_share)
    totals = qc_filter(cropped, list(flags), qc).groupBy(*keys, at).agg(F.sum("footprint").alias("_total")).where(F.col("_total") > least)
    if lag:
        totals = totals.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(at))).where(F.col("_rn") > lag).drop("_rn")
    return cropped.join(totals, [*keys, at]).withColumn("footprint", F.col("footprint") / F.col("_total")).drop("_total")
