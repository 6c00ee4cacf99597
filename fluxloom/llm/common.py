"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of long text that one Arrow batch may hold; bounds a Python worker's memory.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def guarded(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named c0, c1, ..., so that none of its names meets one that an operator
    uses inside, and which of them each name became."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]), {name: f"c{k}" for k, name in enumerate(df.columns)}


def restored(df: DataFrame, names: dict[str, str], **added: str) -> DataFrame:
    """The columns of a guarded table under their own names, then those added (name=column); an
    added column replaces one of the same name."""
    taken = {a.lower() for a in added}
    own = [F.col(c).alias(name) for name, c in names.items() if name.lower() not in taken]
    return df.select(*own, *[F.col(c).alias(name) for name, c in added.items()])


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of ARROW_ROWS rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def trim() -> None:
    """Give the system back what earlier tasks of this worker process have freed, but the C library
    and Arrow still hold; a worker's next task starts small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Only where no folder is configured a temporary one is set, and only if driver and executors
    are one process (tests); on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        java_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if java_dir.isDefined():
            root = java_dir.get()
        elif not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/fluxloom-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (u, v) of longs: rows (node, root), root the smallest node.

    Alternating large-star and small-star rounds; each round is written to the shared
    folder. Hubs stay in joins that adaptive execution can split. Nodes without a link,
    self-links and links with a null end give no row.
    """
    links = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    links = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _digest(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = _digest(links)
        if now == state:
            break
        state = now
    roots = links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _digest(links: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(links.agg(F.count("*"), F.sum(F.pmod(h, F.lit(1 << 31))), F.bit_xor(h)).first())
