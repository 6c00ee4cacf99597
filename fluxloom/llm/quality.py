"""Quality by the perplexity of an interpolated modified Kneser-Ney n-gram model.

The model is one of characters, trained on the whole of the trusted texts (quality label 1).
Its alphabet is every character of those texts. n-grams are exact keys, three code points in
a long, and everything counted stays in tables: joins of the counts of each order with the
totals and discounts of their contexts, sharded by n-gram, give the probability of every
n-gram seen, and the same joins back off for the n-grams of the corpus that were not. The
n-grams of each document are counted first. The HOT most frequent of the corpus are scored
where the document is; all others are joined with the table and summed per text, so that no
join has a hot key. The score of a document is the mean negative log probability of its
characters, the logarithm of its perplexity.

One trusted document in FOLDS, chosen by a hash of its id, is not trained on and sets the
thresholds instead. A document is rejected if its score lies above a quantile of those of its
language and length class, raised by a margin. Groups of too few such documents use those of
their length class, then of all.

Defined results: null and empty texts have a null score and are rejected; a null or unknown
language uses the thresholds of all languages; an id is trusted if it has the label 1 and not 0,
too; where no trusted document is left to set thresholds, those trained on do; without any
trusted text every score is the same and everything else is kept; repeated rows each get a row;
an empty table gives an empty result; other columns pass through, and those named like an output
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import guarded, materialize, restored, small_batches, trim

#: The least number of characters that unseen ones are taken from, and the order of the model.
LEAST, ORDER = 128, 3
#: Bits of a character in an n-gram, and the n-grams scored without a join.
BITS, HOT = 21, 1_000_000
#: n-grams that a task holds before it sends what it counted.
HELD = 1_000_000
#: The quantile of held-out trusted scores, the margin above it, the held-out documents a group
#: needs, and the part of the trusted documents that is held out.
QUANTILE, MARGIN, GROUP, FOLDS = 0.99, 0.06, 50, 5
#: Trusted ids that may be sent to all tasks; more are joined by a shuffle.
SENT_IDS = 2_000_000
#: Upper ends of the length classes in characters; short texts vary more.
LENGTHS = (40, 200)


def _order(level: DataFrame, lower: DataFrame | None, n: int, bits: int, base: float) -> DataFrame:
    """Interpolated probabilities of order n: gram, p, and its context's weight for the lower
    order, from counts (gram, n) and the lower order's (gram, p)."""
    of = [F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.coalesce(F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
    cuts = [F.greatest(F.lit(0.05), F.coalesce(k - (k + 1) * y * F.try_divide(f"n{k + 1}", f"n{k}"), F.lit(0.5 * k))).alias(f"d{k}") for k in (1, 2, 3)]
    level = level.crossJoin(F.broadcast(level.agg(*of).select(*cuts)))  # the one row of discounts
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.least("d3", "n"))
    level = level.select("gram", "n", cut.alias("cut"), F.shiftright("gram", bits).alias("context"))
    totals = level.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("left"))
    level = level.join(totals, "context").withColumn("weight", F.col("left") / F.col("total"))
    below = F.lit(base)
    if lower is not None:
        level = level.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << bits * (n - 1)) - 1))).join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix", "left")
        below = F.coalesce("below", below)
    return level.select("gram", "context", "weight", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("weight") * below).alias("p"))


def _keys(text: str) -> np.ndarray:
    """The n-grams of a text, of code points plus one; 0 begins a text."""
    points = np.concatenate([np.zeros(ORDER - 1, np.int64), np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) + 1])
    grams = points[: len(points) - ORDER + 1]
    for j in range(1, ORDER):
        grams = grams << BITS | points[j : len(points) - ORDER + 1 + j]
    return grams


def gram_counts(texts: DataFrame) -> DataFrame:
    """Counts of all n-grams of the highest order over any alphabet: gram, n."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        total = np.zeros(len(grams), np.int64)
        np.add.at(total, at, np.concatenate([n for _, n in parts]))
        return grams, total

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        parts, held = [], 0
        for batch in batches:
            found = [_keys(t) for t in batch["text"].to_pylist() if t]
            if found:
                parts.append(np.unique(np.concatenate(found), return_counts=True))
                held += len(parts[-1][0])
            if held > HELD:
                parts = [merged(parts)]
                held = len(parts[0][0])
                if held > HELD // 2:
                    yield pa.RecordBatch.from_pydict({"gram": parts[0][0], "n": parts[0][1]})
                    parts, held = [], 0
        if parts:
            grams, n = merged(parts)
            yield pa.RecordBatch.from_pydict({"gram": grams, "n": n})

    small_batches(texts.sparkSession)
    return texts.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _smoothed(grams: DataFrame, orders: list[DataFrame], n: int, base: float) -> DataFrame:
    """The probability of distinct n-grams, seen or not: gram, p."""
    grams = grams.select("gram", F.shiftright("gram", BITS).alias("context"), F.col("gram").bitwiseAND(F.lit((1 << BITS * (n - 1)) - 1)).alias("suffix"))
    seen = orders[n - 1]
    weights = seen.groupBy("context").agg(F.max("weight").alias("weight"))
    grams = grams.join(seen.select("gram", "p"), "gram", "left").join(weights, "context", "left")
    below = F.lit(base)
    if n > 1:
        lower = _smoothed(grams.select(F.col("suffix").alias("gram")).distinct(), orders, n - 1, base)
        grams, below = grams.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix"), F.col("below")
    return materialize(grams.select("gram", F.coalesce("p", F.coalesce("weight", F.lit(1.0)) * below).alias("p")))


def log_probabilities(texts: DataFrame, trusted: DataFrame) -> DataFrame:
    """For every n-gram of `texts` its count there and its log probability after training on
    `trusted`: gram, n, lp."""
    levels = [materialize(gram_counts(trusted))]
    for n in range(ORDER - 1, 0, -1):  # lower orders count the different characters before
        levels.append(levels[-1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << BITS * n) - 1)).alias("gram")).agg(F.count("*").alias("n")))
    levels[-1] = materialize(levels[-1])
    base, orders = 1.0 / max(LEAST, levels[-1].count() + 2), []
    for n, level in enumerate(reversed(levels), 1):
        orders.append(materialize(_order(level, orders[-1] if orders else None, n, BITS, base)))
    grams = materialize(gram_counts(texts))
    return materialize(grams.join(_smoothed(grams, orders, ORDER, base), "gram").select("gram", "n", F.ln("p").alias("lp")))


def with_score(docs: DataFrame, model: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
    """Add the mean negative log probability per character; null for null and empty texts."""
    docs, names = guarded(docs)
    text = names[text]
    spark = docs.sparkSession
    hot = model.orderBy(F.desc("n"), "gram").limit(HOT).select("gram", "lp").toPandas().sort_values("gram")
    shipped = spark.sparkContext.broadcast((hot["gram"].to_numpy(np.int64), hot["lp"].to_numpy(np.float64)))

    def split(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        grams, n = np.unique(_keys(text), return_counts=True)
        known, logs = shipped.value
        at = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
        inside = known[at] == grams if len(known) else np.zeros(len(grams), bool)
        return grams, n, inside, float((logs[at[inside]] * n[inside]).sum())

    @F.pandas_udf("double")
    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trim()
        for texts in batches:
            yield pd.Series([split(t)[3] if t else None for t in texts], dtype="float64")

    @F.pandas_udf("array<struct<gram:long,n:long>>")
    def rest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = [split(t) if t else None for t in texts]
            yield pd.Series([[{"gram": int(g), "n": int(k)} for g, k in zip(f[0][~f[2]], f[1][~f[2]], strict=True)] if f else [] for f in found])

    small_batches(spark)
    if model.count() <= len(hot):
        return restored(docs.withColumn("mean", -near(F.col(text)) / F.length(text)), names, **{out: "mean"})
    rows = docs.select(F.md5(text).alias("hash"), F.explode(rest(F.col(text))).alias("r")).select("hash", "r.gram", "r.n")
    rows = rows.groupBy("hash", "gram").agg(F.max("n").alias("n"))  # equal texts have equal n-grams
    far = rows.join(model.select("gram", "lp"), "gram").groupBy("hash").agg(F.sum(F.col("n") * F.col("lp")).alias("far"))
    docs = docs.join(materialize(far), F.md5(text) == F.col("hash"), "left")
    docs = docs.withColumn("mean", -(near(F.col(text)) + F.coalesce("far", F.lit(0.0))) / F.length(text))
    return restored(docs, names, **{out: "mean"})


def length_class(text: str | Column) -> Column:
    n = F.length(text)
    return F.when(n <= LENGTHS[0], 0).when(n <= LENGTHS[1], 1).otherwise(2)


def thresholds(scored: DataFrame) -> DataFrame:
    """Thresholds of trusted scores (lang, length, score): lang, length, threshold; null keys
    stand for all. Every level comes from all trusted documents."""
    limit = F.percentile_approx("score", F.lit(QUANTILE), F.lit(10_000)) + MARGIN
    return scored.where("score IS NOT NULL").rollup("length", "lang").agg(F.count("*").alias("n"), limit.alias("threshold"), F.grouping_id().alias("level")).where((F.col("n") >= GROUP) | (F.col("level") == 3))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """All columns of docs with _score, _threshold and _keep."""
    docs, names = guarded(docs)
    i, lang, text = names[id_col], names[lang], names[text]
    ids = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("q")).where("q = 1").select("id")
    few = ids.count() <= SENT_IDS
    trusted = docs.join(F.broadcast(ids) if few else ids, F.col(i) == F.col("id"), "left_semi")
    held = F.pmod(F.xxhash64(i), F.lit(FOLDS)) == 0
    trusted = trusted.select(F.col(lang).alias("lang"), length_class(text).alias("length"), F.col(text).alias("text"), held.alias("held"))
    trusted = trusted if few else materialize(trusted)  # read three times; shuffled once
    model = log_probabilities(docs.select(F.col(text).alias("text")), trusted.where("NOT held"))
    judges = trusted.where("held") if not trusted.where("held AND text <> ''").isEmpty() else trusted
    limits = materialize(thresholds(with_score(judges, model).select("lang", "length", "score")))
    exact = limits.where("level = 0 AND lang IS NOT NULL").select(F.col("lang").alias("l"), F.col("length").alias("n"), F.col("threshold").alias("t0"))
    by_length = limits.where("level = 1").select(F.col("length").alias("n1"), F.col("threshold").alias("t1"))
    overall = limits.where("level = 3").select(F.col("threshold").alias("t2"))  # one row
    docs = with_score(docs, model, text, "score").withColumn("length", length_class(text))
    docs = docs.join(exact, (F.col(lang) == F.col("l")) & (F.col("length") == F.col("n")), "left")
    docs = docs.join(F.broadcast(by_length), F.col("length") == F.col("n1"), "left").join(F.broadcast(overall), how="left")
    docs = docs.withColumn("threshold", F.coalesce("t0", "t1", "t2"))
    docs = docs.withColumn("keep", F.col("score").isNotNull() & F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True)))
    return restored(docs, names, _score="score", _threshold="threshold", _keep="keep")
