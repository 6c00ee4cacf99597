"""Spelling variants of words by pairs of trie nodes.

Words are the runs of letters of all texts that occur often enough. They are sorted, and the nodes
of the trie of their prefixes are numbered in that order: a word's path shares as many nodes with
the word before it as it shares characters, the others are new. A partition numbers its own nodes;
how many nodes each partition adds, and which nodes its first word shares with the words before,
is settled on the driver from the partitions' first and last words. The reversed words give the
nodes of suffixes in the same way. A word's last prefix node numbers the word itself, in code-point order.

Two words differ by one replaced character if some (prefix node, suffix node) pair that skips
one position is the same for both; one is the other with a character less if the pair that skips
it equals the other's pair at an insertion position. Skipping only the first of equal neighbours
gives each pair of words once. Words that share a pair differ in one character alone, so a group has
no more rows than the alphabet has letters, plus one, and each row takes the number and the most
frequent of its neighbours from its group: no pairs of words are written.

Forms are followed to their roots by doubling: frequencies at least double at each step, so a few
rounds suffice.

Defined results: null and empty texts hold no words, a null id counts as an empty string in the
hash that plants misspellings; repeated rows count each; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: What a run of letters holds, once A-Z are lower-cased, and the number of letters that makes.
LETTERS = "a-zÀ-ÿ"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shortest: int = 5) -> DataFrame:
    """Rows (id, word): the lower-cased runs of letters of at least `shortest` code points."""
    lowered = F.translate(F.col(f"`{text}`"), CAPITALS, SMALL)
    found = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.explode(F.split(lowered, f"[^{LETTERS}]+")).alias("word"))
    return found.where(F.length("word") >= shortest)


def misspelled(found: DataFrame, every: int) -> DataFrame:
    """Rows (word) of rows (id, word): where `every` divides the crc32 of "<id>:<word>", the code point
    at the remainder by the word's length is left out."""
    h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("word")))
    at = (h % F.length("word")).cast("int")
    less = F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + 2, F.length("word")))
    return found.select(F.when(h % every == 0, less).otherwise(F.col("word")).alias("word"))


def vocabulary(found: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """Words (word, n) of at least `shortest` code points and `least` occurrences."""
    return found.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def numbered(words: DataFrame, spelled: Column, out: str) -> DataFrame:
    """words with an array column `out`: the numbers of the trie nodes of all prefixes of `spelled`, the
    shortest first. Node 0 is the root and not in it."""
    spark = words.sparkSession
    ranged = words.withColumn("spelled", spelled).repartitionByRange(spark.sparkContext.defaultParallelism * 2, "spelled").sortWithinPartitions("spelled")
    ranged = ranged.withColumn("part", F.spark_partition_id())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, path, count = "", [], 0
        for batch in batches:
            paths = []
            for word in batch.column(batch.schema.get_field_index("spelled")).to_pylist():
                same = len(commonprefix((before, word)))
                path = path[:same] + list(range(count + 1, count + len(word) - same + 1))
                before, count = word, count + len(word) - same
                paths.append(path)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.list_(pa.int64()))], [*batch.schema.names, out])

    local = materialize(ranged.mapInArrow(walk, T.StructType([*ranged.schema, T.StructField(out, T.ArrayType(T.LongType()))])))
    # One row for each partition: its first and last words, and the last word's nodes, the last of which is the newest.
    edges = local.groupBy("part").agg(F.min("spelled").alias("first"), F.max("spelled").alias("last"), F.max_by(out, "spelled").alias("path")).orderBy("part").collect()
    offsets, total, before, path = [], 0, "", []
    for e in edges:
        shared = path[: len(commonprefix((before, e.first)))]
        offsets.append((e.part, shared, total - len(shared)))
        path = [shared[k - 1] if k <= len(shared) else k + total - len(shared) for k in e.path]
        before, total = e.last, total + e.path[-1] - len(shared)
    moved = spark.createDataFrame(offsets, "part int, shared array<long>, moved long")
    node = lambda k: F.when(k <= F.size("shared"), F.get("shared", (k - 1).cast("int"))).otherwise(k + F.col("moved"))
    # `moved` has one row for each partition.
    return local.join(F.broadcast(moved), "part").withColumn(out, F.transform(out, node)).drop("part", "spelled", "shared", "moved")


def pairs(tries: DataFrame) -> DataFrame:
    """Rows (p, s, kind, id, n): the pairs of nodes around each position of each word. kind 0 is a place
    where a character may be inserted, 1 skips a character, 2 skips one that equals the one before it."""
    at = lambda nodes, k: F.when(k > 0, F.get(nodes, k - 1)).otherwise(F.lit(0).cast("long"))
    size, letters = F.size("prefixes"), F.split("word", "")
    same = lambda i: F.coalesce(F.get(letters, i) == F.get(letters, i - 1), F.lit(False))
    entry = lambda p, s, kind: F.struct(p.alias("p"), s.alias("s"), kind.cast("int").alias("kind"))
    skips = F.transform(F.sequence(F.lit(0), size - 1), lambda i: entry(at("prefixes", i), at("suffixes", size - i - 1), F.when((i > 0) & same(i), 2).otherwise(1)))
    places = F.transform(F.sequence(F.lit(0), size), lambda i: entry(at("prefixes", i), at("suffixes", size - i), F.lit(0)))
    return tries.select("id", "n", F.inline(F.concat(skips, places)))


def neighbours(tries: DataFrame) -> DataFrame:
    """Rows (id, n_near, form_n, form): how many words differ from a word in one character, and the most
    frequent of them (the first in order at ties); words with no such word have no row."""
    group = Window.partitionBy("p", "s")
    ranked = group.orderBy((F.col("kind") == 0).cast("int"), F.desc("n"), "id")
    key = F.struct("n", (-F.col("id")).alias("order"))
    skipping, first_of_equal = F.col("kind") >= 1, F.col("kind") == 1
    rows = pairs(tries).select(
        "id",
        "kind",
        F.count("*").over(group).alias("rows"),
        F.count(F.when(skipping, 1)).over(group).alias("n_skipping"),
        F.count(F.when(first_of_equal, 1)).over(group).alias("n_longer"),
        F.max(F.when(skipping, key)).over(group).alias("best_skipping"),
        F.max(F.when(first_of_equal, key)).over(group).alias("best_longer"),
        F.max(F.when(~skipping, key)).over(group).alias("shorter"),
        F.row_number().over(ranked).alias("place"),
        F.when(F.lead("kind").over(ranked) >= 1, F.lead(key).over(ranked)).alias("next"),
    ).where("rows > 1")
    replaced = F.when(skipping, F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("best_skipping")))
    deleted = F.when(first_of_equal, F.col("shorter")).when(~skipping, F.col("best_longer"))
    n_near = F.when(skipping, F.col("n_skipping") - 1 + F.when(first_of_equal & F.col("shorter").isNotNull(), 1).otherwise(0)).otherwise(F.col("n_longer"))
    found = rows.select("id", n_near.alias("n_near"), F.greatest(replaced, deleted).alias("best")).where("n_near > 0")
    return found.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best")).select("id", "n_near", F.col("best.n").alias("form_n"), (-F.col("best.order")).alias("form"))


def roots(steps: DataFrame) -> DataFrame:
    """Rows (id, root) of rows (id, form) without cycles: forms followed to the last one."""
    now = materialize(steps.select("id", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while now.where("moved").limit(1).count():
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("further"))
        now = materialize(now.join(ahead, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
    return now.select("id", "root")


def variants(words: DataFrame, times: float = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n): a word's form is its most frequent
    neighbour, if that is at least `times` as frequent as the word."""
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")))
    tries = numbered(words, F.col("word"), "prefixes")
    tries = materialize(numbered(tries, F.reverse("word"), "suffixes").withColumn("id", F.element_at("prefixes", -1)))
    near = materialize(tries.select("id", "word", "n").join(neighbours(tries), "id", "left").withColumn("has_form", F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False))))
    names = near.select("id", "word")
    followed = roots(near.where("has_form").select("id", "form"))
    named = lambda df, by: df.join(names.select(F.col("id").alias(by), F.col("word").alias(f"{by}_word")), by)
    found = named(named(near.where("has_form").join(followed, "id"), "form"), "root").select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n")
    none = F.lit(None).cast("string").alias("form")
    others = near.where("NOT has_form").select("word", none, F.col("word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"))
    return found.unionByName(others)
