"""Classes of near copies by the exact Jaccard similarity of word shingles.

Candidates come from two sets of keys. The first are those of SimHash, `simhash.variants`: halves
of the fingerprint of a text's shingle set without one of their bits, so that all fingerprints
at most two bits apart share a key. Texts of similarity 0.8 differ in ten bits on average,
too many for keys made of bits, so min-hash bands find those: texts of similarity s share one of
BANDS keys with probability 1 - (1 - s ** ROWS) ** BANDS, 0.99998 at 0.8. Every candidate
pair is then checked on the texts' whole shingle sets, and the classes are the connected
components of the pairs that pass.

Members of a key are paired all with all up to PAIR_LIMIT; of larger keys all are paired with
one member first. Only where that leaves a key in several classes, its members are compared
block by block. Neither step loses a pair that could join two classes.

Defined results: texts of fewer words than a shingle count as one shingle; null and empty
texts form one class; texts with equal shingle sets are one node; null ids and repeated rows
are treated as in `simhash`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, small_batches, trim
from .simhash import BLOCK, PAIR_LIMIT, keep_least, majority, variants

#: Words of a shingle and the least similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: Keys of a text and the min-hashes in each.
BANDS, ROWS = 36, 6
#: Shingles hashed at once.
CHUNK = 2048
#: Candidates that may be sent to all tasks to find their texts; more are joined by a shuffle.
SENT = 2_000_000

_RNG = np.random.default_rng(42)
_A, _B = _RNG.integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_A = _A * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, words: int = WORDS, seed: int = 42) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a UTF-8 text's word shingles."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    line, at, starts = b" ".join(tokens), 0, []
    for t in tokens:
        starts.append(at)
        at += len(t) + 1
    n, digest = max(1, len(tokens) - words + 1), xxhash.xxh64_intdigest
    ends = [s - 1 for s in starts[words:]] + [len(line)]
    return np.unique(np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[:n], ends[:n], strict=True)), np.uint64, n))


def keys_of(found: np.ndarray) -> np.ndarray:
    """The band keys of a set of shingles; none for an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), CHUNK):
        np.minimum(least, (found[k : k + CHUNK, None] * _A + _B).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _signed(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """id, hash of the text, node (a hash of the shingle set), the node's fingerprint and band keys."""

    @F.pandas_udf("node long, fp long, keys array<long>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trim()
        for texts in batches:
            sets = [shingles(t, words, seed) for t in texts]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], np.uint64).view(np.int64)
            prints = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"node": nodes, "fp": prints, "keys": [keys_of(s) for s in sets]})

    small_batches(docs.sparkSession)
    return docs.select("id", F.xxhash64("text").alias("hash"), sign(F.col("text").cast("binary")).alias("s")).select("id", "hash", "s.node", "s.fp", "s.keys")


def _keys(nodes: DataFrame) -> DataFrame:
    """The keys at which nodes meet: node, key. A node without shingles has none."""
    prints = variants(nodes.where(F.size("keys") > 0).select("node", "fp")).select("node", "key")
    return prints.unionByName(nodes.select("node", F.explode("keys").alias("key")))


def _sets(docs: DataFrame, signed: DataFrame, nodes: DataFrame, words: int, seed: int) -> DataFrame:
    """The shingle sets of nodes, each from one of its texts: node, set."""

    @F.pandas_udf("array<long>")
    def take(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trim()
        for texts in batches:
            yield pd.Series([shingles(t, words, seed).view(np.int64) for t in texts])

    one = signed.select("node", "id", "hash").join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("hash", "id")).alias("one"))
    one = materialize(one.select("node", F.col("one.hash").alias("_hash"), F.col("one.id").alias("_id")))
    sent = F.broadcast(one) if one.count() <= SENT else one
    texts = docs.join(sent, (F.xxhash64("text") == F.col("_hash")) & F.col("id").eqNullSafe(F.col("_id")))
    return materialize(texts.select("node", take(F.col("text").cast("binary")).alias("set")).dropDuplicates(["node"]))


def _spanning(nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links that join the members of a block as all its pairs of at least `similarity` do;
    members of equal root are joined already."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    terms, flat = np.unique(np.concatenate(sets), return_inverse=True)
    stops, mark = np.cumsum(sizes), np.zeros(len(terms), bool)
    left, u, v = np.ones(len(sets), bool), [], []
    while left.any():
        front = np.flatnonzero(left & (roots == roots[np.argmax(left)])).tolist()
        left[front] = False
        while front and left.any():
            k = front.pop()
            own = flat[stops[k] - sizes[k] : stops[k]]
            mark[own] = True
            common = np.bincount(owner[mark[flat]], minlength=len(sets))
            mark[own] = False
            near = left & (common >= similarity * (sizes + sizes[k] - common) - 1e-9)
            u += [int(nodes[k])] * int(near.sum())
            v += nodes[near].tolist()
            joined = np.flatnonzero(left & np.isin(roots, roots[near]))
            left[joined] = False
            front += joined.tolist()
    return u, v


def _links(met: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) with the same classes as all pairs that share a key (key, node, n) and are similar."""
    few, many = met.where(F.col("n") <= PAIR_LIMIT), met.where(F.col("n") > PAIR_LIMIT)
    a, b = few.select("key", F.col("node").alias("u")), few.select("key", F.col("node").alias("v"))
    # A row for each large key, written so that its size is known: Spark sends it to the members
    # where it is small, instead of gathering a key's members.
    hubs = materialize(many.groupBy("key").agg(F.min("node").alias("u")))
    hubs = many.select("key", F.col("node").alias("v")).join(hubs, "key").select("key", "u", "v")
    pairs = materialize(a.join(b, "key").select("key", "u", "v").unionByName(hubs).where("u < v").select("u", "v").distinct())
    left, right = sets.select(F.col("node").alias("u"), F.col("set").alias("su")), sets.select(F.col("node").alias("v"), F.col("set").alias("sv"))
    common, total = F.size(F.array_intersect("su", "sv")), F.size("su") + F.size("sv")
    found = materialize(pairs.join(left, "u").join(right, "v").where(common >= similarity * (total - common) - 1e-9).select("u", "v"))

    roots = components(found)
    many = many.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    split = many.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    many = materialize(many.join(split, "key", "left_semi"))
    if many.isEmpty():
        return found
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    many = many.withColumn("b", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("b")).cast("int"))
    many = many.select("key", "node", "root", "own", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("other"))
    many = many.select("key", "node", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(sets, "node")

    def block(group: pa.Table) -> pa.Table:
        members = [np.asarray(s, np.int64) for s in group["set"].to_pylist()]
        u, v = _spanning(group["node"].to_numpy(), group["root"].to_numpy(), members, similarity)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return found.unionByName(many.groupBy("key", "i", "j").applyInArrow(block, "u long, v long").distinct())


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, seed: int = 42) -> DataFrame:
    """One row per document: id, hash of its text, and component_id, the smallest id of its class."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    signed = materialize(_signed(docs, words, seed))
    keys = _keys(signed.select("node", "fp", "keys").dropDuplicates(["node"]))
    shared = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = materialize(keys.join(shared, "key"))
    sets = _sets(docs, signed, met.select("node").distinct(), words, seed)
    roots = components(_links(met, sets, similarity))
    named = signed.groupBy("node").agg(F.min("id").alias("least")).join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return signed.select("id", "hash", "node").join(named.join(lowest, "root").select("node", "component_id"), "node").select("id", "hash", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents whose id is the smallest of their class, all columns kept, as in `simhash`."""
    return keep_least(docs, classes(docs, id_col, text, **options), id_col, text)
