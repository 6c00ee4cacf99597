"""The nearest of many targets by a separable distance transform.

Squared distance is a sum over the two axes. So a first pass goes down each column of targets and
finds, for each row that is asked about, the column's nearest target; a second pass goes along each of
these rows and takes the least sum: the columns' targets are parabolas over the row, of which the
lower envelope is built once and looked up for all points. That is two shuffles, by column and by
row, however far away targets are; the first pass gives a row for each row asked about and
column with targets, which for a raster is at most its own size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows asked about that are sent to the tasks at once.
ROWS = 1 << 16


def nearest_in_columns(ys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each row the index of the nearest of ascending ys, the lower of equals."""
    right = np.searchsorted(ys, rows)
    left, right = np.maximum(right - 1, 0), np.minimum(right, len(ys) - 1)
    return np.where(np.abs(rows - ys[left]) <= np.abs(ys[right] - rows), left, right)


def envelope(xs: np.ndarray, heights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of parabolas (x - xs)^2 + heights with ascending xs those on the lower envelope, and the places
    up to which each but the last is lowest, the earlier one at a tie."""
    kept, ends = [], []
    key = heights + xs * xs
    for k, (x, y) in enumerate(zip(xs.tolist(), key.tolist(), strict=True)):
        while kept:
            last = kept[-1]
            meet = (y - key[last]) / (2 * (x - xs[last]))
            if len(kept) == 1 or meet > ends[-1]:
                ends.append(meet)
                break
            kept.pop()
            ends.pop()
        kept.append(k)
    return np.array(kept, np.int64), np.array(ends)


def nearest_targets(points: DataFrame, targets: DataFrame, ids: list[str]) -> DataFrame:
    """For each point (ids, px, py) the columns of the nearest target (tx, ty and any others), the one of
    the least tx, then ty, of equals. Points without coordinates, or where there is no target, give no
    row; of targets in one place any one is taken."""
    points = points.where("px IS NOT NULL AND py IS NOT NULL").select(*ids, F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py"))
    targets = targets.where("tx IS NOT NULL AND ty IS NOT NULL")
    # A raster's height, or the number of places asked about.
    asked = np.array(sorted(r.py for r in points.select("py").distinct().collect()))
    names, parts = targets.columns, []
    by_column = targets.repartition("tx").sortWithinPartitions("tx", "ty")
    schema = T.StructType([T.StructField("_row", T.DoubleType()), *targets.schema])
    for k in range(0, max(1, len(asked)), ROWS):
        rows = asked[k : k + ROWS]

        def down(batches: Iterator[pa.RecordBatch], rows: np.ndarray = rows) -> Iterator[pa.RecordBatch]:
            def near(column: pa.Table) -> list[pa.RecordBatch]:
                found = column.take(pa.array(nearest_in_columns(column["ty"].to_numpy().astype(float), rows)))
                return found.add_column(0, "_row", pa.array(rows)).combine_chunks().to_batches()

            held: list[pa.Table] = []  # of the column that may go on in the next batch
            for batch in batches:
                table = pa.Table.from_batches([batch])
                xs = table["tx"].to_numpy()
                starts = [0, *(np.flatnonzero(xs[1:] != xs[:-1]) + 1).tolist()] if len(xs) else []
                for a, b in zip(starts, [*starts[1:], len(xs)], strict=True):
                    if held and held[-1]["tx"][0].as_py() != xs[a]:
                        yield from near(pa.concat_tables(held))
                        held = []
                    held.append(table.slice(a, b - a))
            if held:
                yield from near(pa.concat_tables(held))

        parts.append(by_column.mapInArrow(down, schema))
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)

    def along(asking: pa.Table, line: pa.Table) -> pa.Table:
        if not (asking.num_rows and line.num_rows):
            return pa.table({f.name: pa.array([], f.type) for f in [*(asking.schema.field(i) for i in ids), *(line.schema.field(n) for n in names)]})
        line = line.take(pa.array(np.argsort(line["tx"].to_numpy(), kind="stable")))
        xs, row = line["tx"].to_numpy().astype(float), line["_row"][0].as_py()
        lowest, ends = envelope(xs, (line["ty"].to_numpy() - row) ** 2)
        at = lowest[np.searchsorted(ends, asking["px"].to_numpy())]
        found = line.take(pa.array(at))
        return pa.table([*(asking[i] for i in ids), *(found[n] for n in names)], [*ids, *names])

    out = T.StructType([*points.select(*ids).schema, *targets.schema])
    return points.withColumn("_row", F.col("py")).groupBy("_row").cogroup(lines.groupBy("_row")).applyInArrow(along, out)
