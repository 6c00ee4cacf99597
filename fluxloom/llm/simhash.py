"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint is cut into two halves of 32 bits. Two fingerprints that differ in at most
two bits have a half in which they differ in at most one. Each half is indexed once per
bit with that bit left out, so such a pair meets in at least one equal key; equality
joins bring them together and the whole distance is verified. Keys are shuffled once, to be
counted; the members of those that are shared are found by the two halves that such a key
can come from, which is a row for each half instead of one for each key.

Defined results: null and empty texts have fingerprint zero and link like any other;
texts of fewer words than a shingle hash their whole word sequence; repeated rows each
get a row; rows with a null id get a class by their fingerprint, and a null class id only
where no member has an id; an empty table gives an empty result; columns beyond the id
and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, guarded, materialize, restored, small_batches

#: Members of one key that a plain equality join may pair; larger keys go to blocks.
PAIR_LIMIT = 32
#: Fingerprints of a block of a large key.
BLOCK = 2048
#: Shingles hashed at once.
CHUNK = 1 << 15


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) < words:
        starts, ends = [0], [len(line)]
    else:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        stops = np.cumsum(sizes + 1) - 1
        starts, ends = (stops - sizes)[: len(tokens) - words + 1].tolist(), stops[words - 1 :].tolist()
    del tokens
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for k in range(0, len(starts), CHUNK):
        raw = b"".join([digest(line[a:b], seed) for a, b in zip(starts[k : k + CHUNK], ends[k : k + CHUNK], strict=True)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", words: int = 3, seed: int = 42, out: str = "fp") -> DataFrame:
    """Add the fingerprint as a signed long."""

    @F.pandas_udf(T.LongType())
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = np.array([fingerprint(t, words, seed) for t in texts], dtype=np.uint64)
            yield pd.Series(values.view(np.int64))

    small_batches(docs.sparkSession)
    return docs.withColumn(out, prints(F.col(text).cast("binary")))


def _spanning(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each fingerprint of a block to the first of its class inside the block."""
    left, nodes, roots = np.unique(prints), [], []
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for k in range(0, len(front), 256):
                near |= (np.bitwise_count(front[k : k + 256, None] ^ left[None, :]) <= bits).any(axis=0)
            front, left = left[near], left[~near]
            nodes.append(front)
            roots.append(np.full(len(front), root))
    return (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (nodes, roots))


def majority(hashes: np.ndarray) -> int:
    """The unsigned fingerprint of 64-bit hashes of shingles; zero of none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[k : k + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def variants(prints: DataFrame) -> DataFrame:
    """Each row of prints (column fp) with its 64 keys (column key): a half without one of its bits."""
    half = F.col("j").bitwiseAND(F.lit(32))
    part = F.when(half == 0, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.expr("shiftrightunsigned(fp, 32)"))
    bit = F.expr("shiftleft(1L, cast(j & 31 as int))")
    keys = prints.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
    return keys.withColumn("key", part.bitwiseAND(F.bitwise_not(bit)) + F.expr("shiftleft(j, 32)")).drop("j")


def members(prints: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows of prints (column fp) at each key of shared (columns key and others): shared's columns, fp.
    A key's members have one of two halves, that without the left-out bit and that with it."""
    side = F.col("key").bitwiseAND(F.lit(32 << 32))
    part, bit = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)), F.expr("shiftleft(1L, cast(shiftright(key, 32) & 31 as int))")
    homes = shared.withColumn("home", F.explode(F.array(side + part, side + part + bit)))
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.expr("shiftrightunsigned(fp, 32)")
    own = prints.select("fp", F.explode(F.array(low, high + F.lit(32 << 32))).alias("home"))
    return own.join(homes, "home").select(*shared.columns, "fp")


def links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) with the same classes as all
    pairs that differ in at most `bits` (2) bits. Large keys are compared block by block and
    give a spanning set of links instead of all pairs."""
    if bits > 2:
        raise ValueError("two halves with one left-out bit find two differing bits at most")
    prints = prints.select("fp")
    shared = materialize(variants(prints).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = materialize(members(prints, shared))

    few = met.where(F.col("n") <= PAIR_LIMIT)
    a, b = few.select("key", F.col("fp").alias("u")), few.select("key", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits
    pairs = a.join(b, "key").where((F.col("u") < F.col("v")) & near).select("u", "v")

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    many = met.where(F.col("n") > PAIR_LIMIT).withColumn("b", blocks)
    many = many.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("b")).cast("int"))
    many = many.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("other"))
    many = many.select("key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def block(group: pa.Table) -> pa.Table:
        u, v = _spanning(group["fp"].to_numpy().view(np.uint64), bits)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return pairs.unionByName(many.groupBy("key", "i", "j").applyInArrow(block, "u long, v long")).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42, bits: int = 2) -> DataFrame:
    """One row per document: id, fp (signed long) and component_id, the smallest id of its class."""
    return _classes(docs, id_col, text, words, seed, bits).select(F.col("id").alias(id_col), "fp", "component_id")


def _classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42, bits: int = 2) -> DataFrame:
    """The same with the text's hash: id, hash, fp, component_id."""
    docs = with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", words, seed)
    docs = materialize(docs.select("id", F.xxhash64("text").alias("hash"), "fp"))
    prints = materialize(docs.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(prints, bits))
    named = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(lowest, "root").select("fp", "component_id")
    return docs.join(named, "fp").select("id", "hash", "fp", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents whose id is the smallest of their class, all columns kept.

    Rows that repeat both id and text count once. A row with a null id stays only where no
    member of its class has an id, once for each text.
    """
    return keep_least(docs, _classes(docs, id_col, text, **options), id_col, text)


def keep_least(docs: DataFrame, found: DataFrame, id_col: str, text: str) -> DataFrame:
    """The documents that stay of classes (id, hash, component_id)."""
    docs, names = guarded(docs)
    docs = docs.withColumns({"id": F.col(names[id_col]), "hash": F.xxhash64(names[text])})
    kept = found.where(F.col("id").eqNullSafe(F.col("component_id")))
    kept = kept.select(F.col("id").alias("kept"), F.col("hash").alias("kept_hash")).distinct()
    stay = docs.join(kept, F.col("id").eqNullSafe(F.col("kept")) & (F.col("hash") == F.col("kept_hash")), "left_semi")
    order = Window.partitionBy("id", "hash").orderBy(F.lit(1))
    return restored(stay.withColumn("nth", F.row_number().over(order)).where("nth = 1"), names)
