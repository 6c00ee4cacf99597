"""LOWESS and the Kalman smoother over series of any length.

Many short series go to Python together, each whole. A long series is cut in blocks of time, so that
all cores work on it: LOWESS gives a block the points beside it that its fits reach, and takes the
median of all residuals between its rounds; the Kalman smoother first composes what a block does
to any state that enters it, then runs through the few blocks of a series, then through each block's
days with the state that enters it known.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .quantiles import exact_quantiles

PIXEL = ["x", "y"]
#: Series that one Python call smooths at most, points up to which a series is short, and the least
#: points or days of a block of a longer one.
TOGETHER, SHORT, BLOCK = 256, 50_000, 8192
#: Blocks of days that a step of the Kalman smoother holds.
ABREAST = 64
#: Numbers that one step of a fit holds for each of its arrays.
CELLS = 1 << 20


def lines(x: np.ndarray, y: np.ndarray, robust: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    """Locally weighted lines through the k nearest of sorted points, evaluated at `points`."""
    out = np.empty(len(points))
    # The k nearest of sorted points lie side by side; those farther away have no weight.
    firsts = np.searchsorted(x[: len(x) - k] + x[k:], 2 * points)
    step = max(1, CELLS // k)
    for a in range(0, len(points), step):
        p = points[a : a + step, None]
        at = firsts[a : a + step, None] + np.arange(k)
        near, values = x[at], y[at]
        distance = np.abs(p - near)
        reach = distance.max(axis=1, keepdims=True)
        with np.errstate(all="ignore"):
            w = distance / reach
            w = 1 - w * w * w
            np.clip(w, 0, None, out=w)
            w = w * w * w * robust[at]
            w /= w.sum(axis=1, keepdims=True)
            mean = np.einsum("ij,ij->i", w, near)
            near -= mean[:, None]
            centre = np.einsum("ij,ij->i", w, values)
            w *= near
            slope = np.einsum("ij,ij->i", w, values) / np.einsum("ij,ij->i", w, near)
        out[a : a + step] = centre + slope * (p[:, 0] - mean)
    return out


def bisquare(miss: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(1 - (miss / scale) ** 2, 0, None) ** 2 if scale > 0 else np.ones(len(miss))


def lowess_fit(x: np.ndarray, y: np.ndarray, at: np.ndarray, frac: float, rounds: int) -> np.ndarray:
    """Robust locally weighted lines through points sorted by x, evaluated at `at`."""
    k, robust = int(frac * len(x) + 1e-10), np.ones(len(x))
    if k < 2:
        return np.full(len(at), np.nan)
    for _ in range(rounds):
        miss = np.abs(y - lines(x, y, robust, x, k))
        scale = 6 * np.median(miss)
        if not np.isfinite(scale):
            return np.full(len(at), np.nan)
        robust = bisquare(miss, scale)
    return lines(x, y, robust, at, k)


def batched(points: DataFrame, keys: list[str]):
    """Groups of whole series, TOGETHER at most on average, and enough of them for all cores."""
    n = points.select(*keys).distinct().count()
    cores = points.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-n // TOGETHER), min(n, 4 * cores))
    # Ids of series are spread before they are hashed to a task.
    return points.withColumn("_batch", F.pmod(F.xxhash64(*keys), F.lit(groups))).groupBy("_batch")


def lowess(stack: DataFrame, value: str, days: list[int], keys: list[str] = PIXEL, frac: float = 0.25, rounds: int = 3, tries: int = 10, at: str = "day", short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """Smooth each series onto the days; a fit with a non-finite value is tried again with frac
    raised by 0.05, at most `tries` times. Series without a value give no row. Series of more than
    `short` points are fitted in blocks of at least `block` points."""
    wanted = np.array(sorted(days), float)
    points = stack.where(F.col(value).isNotNull() & F.col(at).isNotNull()).groupBy(*keys, F.col(at).cast("double").alias("_at")).agg(F.avg(value).alias("_v"))
    points = written(points)
    types = dict(stack.dtypes)

    def smooth(batch: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for key, series in batch.sort_values([*keys, "_at"]).groupby(keys, sort=False, dropna=False):
            x, y, f = series["_at"].to_numpy(), series["_v"].to_numpy(), frac
            for _ in range(tries):
                fitted = lowess_fit(x, y, wanted, f, rounds)
                if np.isfinite(fitted).all():
                    break
                f += 0.05
            parts.append((key, fitted))
        out = pd.DataFrame({k: np.repeat([p[0][j] for p in parts], len(wanted)) for j, k in enumerate(keys)})
        out["day"] = np.tile(wanted.astype("int64"), len(parts))
        values = pd.Series(np.concatenate([p[1] for p in parts]))
        out[value] = values.where(np.isfinite(values))
        return out

    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["day long", f"{value} double"])
    sizes = points.groupBy(*keys).agg(F.count("*").alias("_n"))
    long = sizes.where(F.col("_n") > short)
    if long.isEmpty():
        return batched(points, keys).applyInPandas(smooth, schema)
    few = batched(points.join(long.select(*keys), keys, "left_anti"), keys).applyInPandas(smooth, schema)
    return few.unionByName(long_lowess(points.join(long.select(*keys), keys, "left_semi"), wanted.tolist(), keys, frac, rounds, tries, block).withColumnRenamed("_v", value).select(*few.columns))


def numbered(points: DataFrame, wanted: list[float], keys: list[str]) -> DataFrame:
    """Points (keys, _at, _v) and the wanted places of each series, with _rank: how many points of the
    series lie before. No task sorts a whole series."""
    spark = points.sparkSession
    places = points.select(*keys).distinct().withColumn("_at", F.explode(F.from_json(F.lit(json.dumps(wanted)), "array<double>")))
    both = points.withColumn("_is", F.lit(0)).unionByName(places.withColumns({"_v": F.lit(None).cast("double"), "_is": F.lit(1)}))
    ranged = written(both.repartitionByRange(4 * spark.sparkContext.defaultParallelism, *keys, "_at", "_is").withColumn("_part", F.spark_partition_id()))
    mine = Window.partitionBy("_part", *keys).orderBy("_at", "_is").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = ranged.groupBy("_part", *keys).agg(F.sum(1 - F.col("_is")).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = ranged.withColumn("_own", F.sum(1 - F.col("_is")).over(mine))
    return local.join(before, ["_part", *keys]).withColumn("_rank", F.col("_before") + F.col("_own") - F.when(F.col("_is") == 0, 1).otherwise(0)).drop("_part", "_own", "_before")


def long_lowess(points: DataFrame, wanted: list[float], keys: list[str], frac: float, rounds: int, tries: int, block: int) -> DataFrame:
    """LOWESS of series (keys, _at, _v) by blocks: rows (keys, day, _v). Each block holds its own points
    and as many on each side as a fit takes; a block has at least a quarter of that number, so that a
    point is in nine blocks at most."""
    places, todo, out = written(numbered(points, wanted, keys)), None, None
    sizes = places.where("_is = 0").groupBy(*keys).agg(F.count("*").alias("_n"))
    for t in range(tries):
        share = sizes if todo is None else sizes.join(todo, keys, "left_semi")
        share = share.withColumn("_k", F.floor((frac + 0.05 * t) * F.col("_n") + 1e-10)).withColumn("_size", F.greatest(F.lit(block), F.floor(F.col("_k") / 4)))
        rows = places.join(share, keys).withColumn("_robust", F.lit(1.0))
        for _ in range(rounds):
            fitted = written(_blocks(rows.where("_is = 0"), keys))
            scale = exact_quantiles(fitted.withColumn("_miss", F.abs(F.col("_v") - F.col("_fit"))), keys, "_miss", {"_median": 0.5})
            off = F.abs(F.col("_v") - F.col("_fit")) / (6 * F.col("_median"))
            robust = F.when(F.col("_median") > 0, F.pow(F.greatest(1 - off * off, F.lit(0.0)), 2)).otherwise(1.0)
            again = fitted.join(scale, keys).select(*keys, "_rank", robust.alias("_w"))
            rows = places.where("_is = 1").join(share, keys).withColumn("_robust", F.lit(1.0)).unionByName(
                rows.where("_is = 0").drop("_robust").join(again, [*keys, "_rank"]).withColumnRenamed("_w", "_robust").select(*rows.columns))
        fitted = written(_blocks(rows, keys).where("_is = 1"))
        bad = fitted.where("_fit IS NULL").select(*keys).distinct()
        todo = bad if t < tries - 1 else bad.limit(0)
        good = fitted.join(todo, keys, "left_anti").select(*keys, F.col("_at").cast("long").alias("day"), F.col("_fit").alias("_v"))
        out = good if out is None else out.unionByName(good)
        if t == tries - 1 or todo.isEmpty():
            return out
    return out


def _blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with _fit: the line at each one's place, by the points and their weights."""
    last = F.floor((F.col("_n") - 1) / F.col("_size"))
    own = F.least(F.floor(F.col("_rank") / F.col("_size")), last)
    reach = F.sequence(F.greatest(F.floor((F.col("_rank") - F.col("_k")) / F.col("_size")), F.lit(0)), F.least(F.floor((F.col("_rank") + F.col("_k")) / F.col("_size")), last))
    copies = rows.withColumn("_own", own).withColumn("_block", F.explode(F.when(F.col("_is") == 0, reach).otherwise(F.array("_own"))))
    names = rows.columns

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_is", "ascending"), ("_rank", "ascending")])
        given = table["_is"].to_numpy() == 0
        x, y, robust = (table[c].to_numpy()[given] for c in ("_at", "_v", "_robust"))
        mine = np.flatnonzero(table["_own"].to_numpy() == table["_block"].to_numpy())
        k = table["_k"][0].as_py()
        asked = table["_at"].to_numpy()[mine]
        fitted = lines(x, y, robust, asked, k) if k >= 2 else np.full(len(mine), np.nan)
        kept = table.take(pa.array(mine)).select(names)
        return kept.append_column("_fit", pa.array(fitted, mask=~np.isfinite(fitted)))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", _fit double"
    return copies.groupBy(*keys, "_block").applyInArrow(fit, schema)


def kalman_fit(seen: np.ndarray, process: float, observation: float) -> np.ndarray:
    """Local-level Kalman smoother over the last axis of series (NaN where nothing was seen); the
    first value seen is the prior mean."""
    first = seen[np.arange(len(seen)), np.isfinite(seen).argmax(axis=1)]
    means, after, ahead, before = _filter(seen, first, np.ones(len(seen)), process, observation, True)
    return _smooth(means, after, ahead, before, None, process).T


def _filter(seen: np.ndarray, mean: np.ndarray, spread: np.ndarray, process: float, observation: float, starts: bool | np.ndarray) -> tuple:
    """Filtered means and variances of each day, and what was foretold for it, from the state that enters.
    Where a series starts, its first day adds no process variance."""
    n, days = seen.shape
    known = np.isfinite(seen)
    means, before, after, ahead = (np.empty((days, n)) for _ in range(4))
    m, p = mean, spread
    for d in range(days):
        ahead[d] = p + np.where(starts, 0.0, process) if d == 0 else p + process
        before[d] = m
        gain = np.where(known[:, d], ahead[d] / (ahead[d] + observation), 0.0)
        m = m + gain * (np.where(known[:, d], seen[:, d], m) - m)
        p = (1 - gain) * ahead[d]
        means[d], after[d] = m, p
    return means, after, ahead, before


def _smooth(means: np.ndarray, after: np.ndarray, ahead: np.ndarray, before: np.ndarray, following: np.ndarray | None, process: float) -> np.ndarray:
    """Smoothed means, given the smoothed mean of the day after the last one (missing at a series' end)."""
    means = means.copy()
    if following is not None:
        pull = after[-1] / (after[-1] + process)
        means[-1] += np.where(np.isfinite(following), pull * (np.nan_to_num(following) - means[-1]), 0.0)
    for d in range(len(means) - 2, -1, -1):
        means[d] += after[d] / ahead[d + 1] * (means[d + 1] - before[d + 1])
    return means


def kalman(stack: DataFrame, value: str, last: int, keys: list[str] = PIXEL, process: float = 0.01, observation: float = 0.05, block: int = BLOCK) -> DataFrame:
    """Smooth each series on the days 0 .. last; many series go to Python at a time. Series without a
    value give no row. Records of more than `block` days are smoothed in blocks of that many days."""
    points = stack.where(F.col(value).isNotNull() & F.col("day").between(0, last)).groupBy(*keys, "day").agg(F.avg(value).alias("_v"))
    types = dict(stack.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["day long", f"{value} double"])
    if last >= block:
        return blocked_kalman(points, last, keys, types, process, observation, block).withColumnRenamed("_v", value)

    def smooth(batch: pd.DataFrame) -> pd.DataFrame:
        groups = batch.groupby(keys, sort=False, dropna=False)
        number, first = groups.ngroup().to_numpy(), groups.head(1)
        seen = np.full((len(first), last + 1), np.nan)
        seen[number, batch["day"].to_numpy()] = batch["_v"].to_numpy()
        out = pd.DataFrame({k: np.repeat(first[k].to_numpy(), last + 1) for k in keys})
        out["day"] = np.tile(np.arange(last + 1), len(first))
        out[value] = kalman_fit(seen, process, observation).ravel()
        return out

    return batched(written(points), keys).applyInPandas(smooth, schema)


def blocked_kalman(points: DataFrame, last: int, keys: list[str], types: dict[str, str], process: float, observation: float, block: int) -> DataFrame:
    """The smoother by blocks of time: rows (keys, day, _v).

    The variance that leaves a block is a fraction of linear terms of the one that enters, the mean that
    leaves is linear in the one that enters, and the smoothed mean of a block's first day is linear in
    both that and the smoothed mean of the next block's first day. These few numbers of each block are
    composed over a series' blocks, forwards, then backwards."""
    firsts = points.groupBy(*keys).agg(F.min_by("_v", "day").alias("_first"))
    every = firsts.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(last // block)))).select(*keys, "_block", "_first")
    held = points.groupBy(*keys, F.floor(F.col("day") / block).cast("int").alias("_block")).agg(F.collect_list(F.struct((F.col("day") % block).cast("int").alias("d"), F.col("_v").alias("v"))).alias("_seen"))
    table = written(every.join(held, [*keys, "_block"], "left"))
    key_types = ", ".join(f"{k} {types[k]}" for k in keys)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (batch.slice(k, ABREAST) for k in range(0, batch.num_rows, ABREAST))

    def dense(batch: pa.RecordBatch) -> np.ndarray:
        seen = np.full((batch.num_rows, block), np.nan)
        lists = batch["_seen"]
        counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = lists.flatten()
        seen[np.repeat(np.arange(batch.num_rows), counts), flat.field("d").to_numpy()] = flat.field("v").to_numpy()
        return seen

    def variances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """p -> (a p + b) / (c p + e)."""
        for batch in some(batches):
            known = np.isfinite(dense(batch))
            starts = batch["_block"].to_numpy() == 0
            a, b, c, e = np.ones(len(known)), np.zeros(len(known)), np.zeros(len(known)), np.ones(len(known))
            for d in range(block):
                more = np.where(starts, 0.0, process) if d == 0 else process
                a, b = a + more * c, b + more * e
                k = known[:, d]
                a, b, c, e = np.where(k, observation * a, a), np.where(k, observation * b, b), np.where(k, a + observation * c, c), np.where(k, b + observation * e, e)
                size = np.abs(c) + np.abs(e)
                a, b, c, e = a / size, b / size, c / size, e / size
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), batch["_block"], *map(pa.array, (a, b, c, e))], [*keys, "_block", *"abce"])

    def enter(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks, p, entering = blocks.sort_values("_block"), 1.0, []
        for a, b, c, e in blocks[list("abce")].itertuples(index=False):
            entering.append(p)
            p = (a * p + b) / (c * p + e)
        return blocks[[*keys, "_block"]].assign(_p=entering)

    own = table.select(*keys, "_block", "_seen").mapInArrow(variances, f"{key_types}, _block int, a double, b double, c double, e double")
    table = written(table.join(own.groupBy(*keys).applyInPandas(enter, f"{key_types}, _block int, _p double"), [*keys, "_block"]))

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The mean that leaves: f + g * mean that enters; the smoothed first mean: r + s * mean that
        enters + u * smoothed first mean of the next block."""
        for batch in some(batches):
            seen, p, starts = dense(batch), batch["_p"].to_numpy(), batch["_block"].to_numpy() == 0
            zero, one = np.zeros(len(seen)), np.ones(len(seen))
            low = _filter(seen, zero, p, process, observation, starts)
            high = _filter(seen, one, p, process, observation, starts)
            f, g = low[0][-1], high[0][-1] - low[0][-1]
            r, s, u = (_smooth(*x, y, process)[0] for x, y in ((low, zero), (high, zero), (low, one)))
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), batch["_block"], batch["_first"], *map(pa.array, (f, g, r, s - r, u - r))], [*keys, "_block", "_first", *"fgrsu"])

    def meet(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks, entering = blocks.sort_values("_block"), []
        m = blocks["_first"].iloc[0]
        for f, g in blocks[["f", "g"]].itertuples(index=False):
            entering.append(m)
            m = f + g * m
        following, ahead = [np.nan] * len(blocks), m  # behind the last day nothing is smoothed: it follows the filter
        for k in range(len(blocks) - 1, -1, -1):
            following[k] = ahead
            r, s, u = blocks[["r", "s", "u"]].iloc[k]
            ahead = r + s * entering[k] + u * ahead
        return blocks[[*keys, "_block"]].assign(_m=entering, _next=following)

    own = table.select(*keys, "_block", "_first", "_p", "_seen").mapInArrow(means, f"{key_types}, _block int, _first double, f double, g double, r double, s double, u double")
    table = table.join(own.groupBy(*keys).applyInPandas(meet, f"{key_types}, _block int, _m double, _next double"), [*keys, "_block"])

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some(batches):
            seen, starts = dense(batch), batch["_block"].to_numpy() == 0
            found = _filter(seen, batch["_m"].to_numpy(), batch["_p"].to_numpy(), process, observation, starts)
            values = _smooth(*found, batch["_next"].to_numpy(), process).T.ravel()
            days = (batch["_block"].to_numpy().astype(np.int64)[:, None] * block + np.arange(block)).ravel()
            inside = np.flatnonzero(days <= last)
            row = pa.array(inside // block)
            yield pa.RecordBatch.from_arrays([*(batch[k].take(row) for k in keys), pa.array(days[inside]), pa.array(values[inside])], [*keys, "day", "_v"])

    return table.select(*keys, "_block", "_p", "_m", "_next", "_seen").mapInArrow(smooth, f"{key_types}, day long, _v double")
