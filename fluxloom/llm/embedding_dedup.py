"""Near-duplicate embeddings: spherical k-means cells and blocked cosine products.

Equal vectors are joined first and count by their number. Centroids are fitted on a bounded
sample; their number follows the rows. A vector is at home in the cell of its nearest
centroid h and visits the cell of each centroid c with

    x.h - x.c <= |h - c| * sqrt(2 - 2 * threshold) / 2.

Of two vectors u, v with a cosine of at least the threshold and homes a, b at least one visits
the other's home, as u.a - u.b and v.b - v.a sum up to (u - v).(a - b), at most
|u - v| * |a - b|. So no link is lost, whatever the dimension. Within a cell every home vector
is compared in double precision with all home and visiting vectors, visitors not with each
other; large cells are dealt out as pairs of blocks. A block sends one number of links for each
vector and a spanning set of the links it found, never all pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
link with nothing and are kept; vectors of different lengths never link; rows that repeat an id
count as vectors of their own; rows with a null id link like any other and get the least id of
their class, null if no member has one; an empty table gives an empty result; columns other
than id and vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize

#: Vectors of the sample that centroids are fitted on, rows of a cell, and centroids at most,
#: for each length of vectors; lengths of fewer than two cells' rows form one cell.
SAMPLE, CELL, CELLS = 16_384, 500, 2048
#: What rounding may take from a difference of cosines.
ROUNDING = 1e-9
#: Vectors of a block, and rows of it that are compared with all of it at once.
BLOCK, TILE = 4096, 512


def fit(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means: k unit centroids of unit vectors."""
    centroids = sample[np.random.default_rng(seed).choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        cell = np.concatenate([(sample[a : a + 1024] @ centroids.T).argmax(axis=1) for a in range(0, len(sample), 1024)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def assign(vecs: DataFrame, threshold: float) -> DataFrame:
    """Rows (cell, id, w, home, cells, e) for each cell that a vector (id, w, e) is in. Cells are
    named by the vectors' length and the number of their centroid."""
    spark = vecs.sparkSession
    sizes = vecs.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).where(F.col("n") >= 2 * CELL)
    models = {}
    for d, n in sorted((r["d"], r["n"]) for r in sizes.collect()):  # a row for each length of vectors
        share = min(1.0, SAMPLE / n)
        rows = vecs.where((F.size("e") == d) & (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
        sample = rows.orderBy("id").select("e").limit(2 * SAMPLE).toPandas()["e"].tolist()
        if sample:
            centroids = fit(_unit(np.array(sample)), max(1, min(CELLS, n // CELL, len(sample))))
            apart = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T)) * np.sqrt(max(0.0, 2 - 2 * threshold)) / 2
            models[d] = centroids, apart + ROUNDING
    shipped = spark.sparkContext.broadcast(models)
    element = dict(vecs.dtypes)["e"]
    kind = pa.list_(pa.float32() if element == "array<float>" else pa.float64())
    out = pa.schema([("cell", pa.string()), ("id", pa.int64()), ("w", pa.int64()), ("home", pa.int32()), ("cells", pa.list_(pa.int32())), ("e", kind)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shipped.value
        for batch in batches:
            lengths = pc.list_value_length(batch["e"]).to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.flatnonzero(lengths == d)))
                x = _unit(_matrix(part["e"], d))
                near, apart = (x @ models[d][0].T, models[d][1]) if d in models else (np.ones((len(x), 1)), np.zeros((1, 1)))
                homes = near.argmax(axis=1).astype(np.int32)
                row, cell = np.nonzero(near >= near.max(axis=1, keepdims=True) - apart[homes])
                ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(x)))]
                visited = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cell, pa.int32()))
                for a in range(0, len(row), 8192):
                    k = pa.array(row[a : a + 8192])
                    names = pa.array([f"{d}/{c}" for c in cell[a : a + 8192].tolist()])
                    yield pa.RecordBatch.from_arrays([names, part["id"].take(k), part["w"].take(k), pa.array(homes).take(k), visited.take(k), part["e"].take(k).cast(kind)], schema=out)

    return vecs.select("id", "w", "e").mapInArrow(place, f"cell string, id long, w long, home int, cells array<int>, e {element}")


def _spanning(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a matrix of links between ids: links from each id to the first one of its class."""
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    near, left, right = near[np.ix_(rows, columns)], left[rows], right[columns]
    rows, columns, nodes, roots = np.ones(len(left), bool), np.ones(len(right), bool), [], []
    for first in range(len(left)):
        if not rows[first]:
            continue
        front = np.array([first])
        rows[first] = False
        while len(front):
            met = np.flatnonzero(columns & near[front].any(axis=0))
            columns[met] = False
            front = np.flatnonzero(rows & near[:, met].any(axis=1))
            rows[front] = False
            nodes += [right[met], left[front]]
            roots.append(np.full(len(met) + len(front), left[first]))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (nodes, roots))


def found(cells: DataFrame, threshold: float) -> DataFrame:
    """Rows (u, v, n): a link between two ids, or with v null a number n of links of u."""
    here = F.split("cell", "/")[1].cast("int")
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("all"), F.ceil(F.sum((F.col("home") == here).cast("int")) / BLOCK).cast("int").alias("homes"))
    rows = cells.join(sizes, "cell").where("homes > 0")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # A block of home vectors meets every block of the cell.
    columns = ["cell", "id", "w", "home", "cells", "e"]
    left = rows.where(F.col("home") == here).select(*columns, block("homes").alias("i"), F.explode(every("all")).alias("j"), F.lit(True).alias("left"))
    right = rows.select(*columns, F.explode(every("homes")).alias("i"), block("all").alias("j"), F.lit(False).alias("left"))

    def compare(block: pa.Table) -> pa.Table:
        d, here = (int(x) for x in block["cell"][0].as_py().split("/"))
        side = block["left"].to_numpy()
        ids, w, home = (block[c].to_numpy() for c in ("id", "w", "home"))
        e = _unit(_matrix(block["e"], d))
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        near = np.empty((len(a), len(b)), bool)
        for k in range(0, len(a), TILE):
            near[k : k + TILE] = e[a[k : k + TILE]] @ e[b].T >= threshold
        near &= ids[a][:, None] != ids[b][None, :]
        # A pair of different homes that meets in both counts where the home is the lesser.
        lesser = np.flatnonzero(home[b] < here)
        for k in np.flatnonzero(near[:, lesser].any(axis=1)).tolist():
            near[k, lesser[near[k, lesser] & np.isin(home[b[lesser]], block["cells"][int(a[k])].as_py())]] = False
        guests = home[b] != here
        tiles = range(0, len(a), TILE)
        ours = [near[k : k + TILE] @ w[b] for k in tiles]
        theirs = sum((w[a[k : k + TILE]] @ near[k : k + TILE] for k in tiles), np.zeros(len(b), np.int64))
        n = np.r_[np.concatenate(ours) if ours else theirs[:0], theirs[guests]]
        u = np.r_[ids[a], ids[b[guests]]]
        nodes, roots = _spanning(near, ids[a], ids[b])
        some = np.flatnonzero(n)
        mask = np.r_[np.ones(len(some), bool), np.zeros(len(nodes), bool)]
        return pa.table({"u": pa.array(np.r_[u[some], nodes], pa.int64()), "v": pa.array(np.r_[u[some], roots], pa.int64(), mask=mask), "n": pa.array(np.r_[n[some], np.zeros(len(nodes), np.int64)], pa.int64())})

    return left.unionByName(right).groupBy("cell", "i", "j").applyInArrow(compare, "u long, v long, n long")


def _named(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (id, e) with a number of their vector, equal for equal ones only, and the
    different vectors: node, least id, w, e."""
    for seed in count():
        rows = rows.withColumn("node", F.when(F.col("e").isNotNull(), F.xxhash64(F.lit(seed), "e")))
        alike = materialize(rows.where("e IS NOT NULL").groupBy("node", "e").agg(F.min("id").alias("least"), F.count("*").alias("w")))
        if alike.groupBy("node").count().where("count > 1").isEmpty():
            return rows.select("id", "node"), alike


def classes(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per vector: id, n_links, component_id (the least id of its class) and kept."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("e"))
    if dict(rows.dtypes)["e"] != "array<float>":
        rows = rows.withColumn("e", F.col("e").cast("array<double>"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce((F.size("e") > 0) & finite & F.exists("e", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("e", F.when(good, F.transform("e", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))))  # no negative zero
    rows, alike = _named(rows)
    pairs = materialize(found(assign(alike.select(F.col("node").alias("id"), "w", "e"), threshold), threshold))
    numbers = pairs.where("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(pairs.where("v IS NOT NULL").select("u", "v"))
    alike = alike.drop("e").join(numbers, "node", "left").join(roots, "node", "left")
    alike = materialize(alike.select("node", "least", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    lowest = alike.groupBy("root").agg(F.min("least").alias("component_id"))
    rows = rows.join(alike.join(lowest, "root").select("node", "n_links", "component_id"), "node", "left")
    component = F.when(F.col("node").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    named = rows.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return named.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
