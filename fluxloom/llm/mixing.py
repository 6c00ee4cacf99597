"""Mixing sources to target weights by hash order and distributed prefix sums.

Every document gets a hash-random key of its id and text. Within a source documents are
ordered by it in range buckets whose number follows the source's rows; sizes are summed per
bucket, bucket sums are accumulated, and sums inside the bucket where the budget ends complete
the prefix sum. The source's whole budget repeats each document floor(target / source size)
times and cuts the rest of the budget at the nearest document boundary of the prefix sum. So
one place for each source says which documents go in once more, and texts are never shuffled.

Defined results: null and empty texts have size 0; a null source is a source of its own,
last in order; a source of size 0 has target 0; rows that repeat id and text are documents of
their own, of which as many are taken as fit; an empty table gives an empty result; other
columns pass through, and those named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import guarded, materialize, restored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Documents that one bucket of a source should hold.
BUCKET_ROWS = 1_000


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources (source, source_size, n): weighted shares of `share` times the total
    size, none above `most` times its source's size, the excess reshared by weight."""
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    sized = sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    still = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    sized = sized.withColumn("level", left / still)
    # From the first source that its share does not fill, one level holds for all the rest; the
    # levels of the sources after it, which count it as full, are lower.
    level = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything)
    sized = sized.withColumn("free", level)
    filled = (F.col("ratio") <= F.col("level")) | F.col("free").isNull()
    return sized.select("source", "source_size", "n", F.when(filled, F.col("cap")).otherwise(F.least("cap", F.col("free") * F.col("weight"))).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """All columns of docs with _size, _source_size, _target and _copies, the number of times
    the mix takes the document."""
    docs, names = guarded(docs)
    words = F.concat_ws("|", F.col(names[id_col]).cast("string"), F.col(names[text]))
    key = F.conv(F.substring(F.md5(words), 1, 12), 16, 10).cast("long")
    place = F.struct(key.alias("key"), F.col(names[id_col]).alias("id"))
    docs = docs.withColumns({"size": word_count(names[text]), "source": F.col(names[source]), "place": place})

    # Rows that repeat id and text are one group of n; nothing below holds a text.
    groups = materialize(docs.groupBy("source", "place", "size").agg(F.count("*").alias("n")))
    totals = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("n"))
    plan = materialize(targets(totals, weights, share, most).withColumnRenamed("source", "plan").withColumn("buckets", F.ceil(F.col("n") / bucket_rows)).drop("n"))
    epochs = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))

    groups = groups.join(plan, F.col("source").eqNullSafe(F.col("plan")))
    # In doubles, which hold a key exactly: keys times buckets are beyond the longs for large sources.
    bucket = F.floor(F.col("place.key") / F.lit(float(1 << 48)) * F.col("buckets")).cast("long")
    groups = groups.withColumn("bucket", bucket)
    sums = groups.groupBy(F.col("source").alias("s"), F.col("bucket").alias("b")).agg(F.sum(F.col("size") * F.col("n")).alias("sum"))
    earlier = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("s", "b", "sum", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    # The budget ends in one bucket of each source; only its groups are put in order.
    last = groups.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")) & (F.col("before") <= F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("sum")))
    inside = Window.partitionBy("source", "bucket").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("before") + F.sum(F.col("size") * F.col("n")).over(inside) - F.col("size") * F.col("n")
    fits = F.floor((F.col("rest") - start - F.col("size") / 2) / F.col("size")) + 1
    last = last.where("size > 0").withColumn("fits", F.greatest(F.lit(0), F.least("n", fits)))
    # The last group that is taken there, if any, and how many of it.
    taken = F.max(F.when(F.col("fits") > 0, F.struct("place", "size", "fits", "n")))
    cuts = last.groupBy(F.col("source").alias("cut")).agg(F.min("bucket").alias("least"), taken.alias("at"))
    cuts = materialize(plan.join(cuts, F.col("plan").eqNullSafe(F.col("cut")), "left").select("plan", "source_size", "target", "buckets", "epochs", "least", "at"))

    docs = docs.join(cuts, F.col("source").eqNullSafe(F.col("plan"))).withColumn("bucket", bucket)
    here, at = F.struct("place", "size"), F.struct("at.place", "at.size")
    docs = docs.withColumn("split", F.coalesce((F.col("at.fits") < F.col("at.n")) & (here == at), F.lit(False)))
    once = (F.col("bucket") < F.col("least")) | ((F.col("bucket") == F.col("least")) & F.col("at").isNotNull() & (here <= at))
    whole = docs.where("NOT split").withColumn("once", (F.col("size") > 0) & F.coalesce(once, F.lit(False)))
    if not cuts.where("at.fits < at.n").isEmpty():
        whole = whole.unionByName(_first(materialize(docs.where("split"))))
    docs = whole.withColumn("copies", F.col("epochs") + F.col("once").cast("long"))
    return restored(docs, names, _size="size", _source_size="source_size", _target="target", _copies="copies")


def _first(rows: DataFrame) -> DataFrame:
    """Add once: whether a row is among the first at.fits of its source, by its number in its
    partition and the rows of the partitions before."""
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33))
    tally = rows.groupBy(F.col("plan").alias("p"), F.col("part").alias("q")).agg(F.count("*").alias("k"), F.min("row").alias("least"))
    earlier = Window.partitionBy("p").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    tally = tally.select("p", "q", "least", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("k"))
    rows = rows.join(tally, F.col("plan").eqNullSafe(F.col("p")) & (F.col("part") == F.col("q")))
    return rows.withColumn("once", F.col("k") + F.col("row") - F.col("least") < F.col("at.fits")).drop("row", "part", "p", "q", "least", "k")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs."""
    docs, names = guarded(docs)
    given = {k: names[options.pop(k, default)] for k, default in (("id_col", "doc_id"), ("source", "source"), ("text", "text"))}
    taken = mix(docs, **given, **options).where("_copies > 0")
    return restored(taken.withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))), names)
