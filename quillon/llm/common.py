"""Shared plumbing: table reads, scratch tables in the shared folder, and tokenizer files."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pieces import KEPT

#: The white space of the contracts, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
#: Bytes of a row of text that Arrow batches reckon with: about 1,000 rows a batch.
ROW = 32 << 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names; a temporary one only in a local session where that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/quillon-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, and later stages survive lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, row_bytes: int, most_bytes: int = 32 << 20):
    """Inside, Arrow batches of plans that run hold at most about most_bytes, given the bytes of the longest row."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, max(1, min(int(before) if int(before) > 0 else 10_000, most_bytes // max(1, row_bytes))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Memory that a Python worker has freed, but that Arrow and the C library (glibc) would keep, goes back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(task: Callable) -> Callable:
    """An Arrow task for workers that live on from stage to stage: caches that other operators left in its worker go before it,
    and memory is given back after each batch."""

    def run(batches):
        KEPT.clear()
        for made in task(batches):
            yield made
            del made
            give_back()
        give_back()

    return run


def fresh(columns: list[str], name: str) -> str:
    """name, longer where columns have it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def sampled(rows: DataFrame, group: str, most: int, buckets: int = 1 << 16) -> DataFrame:
    """The rows of each group whose ids (doc_id) hash lowest: whole buckets of hashes as long as they hold at most `most` ids
    (at least one bucket).  Counts of buckets combine before they are shuffled; no group is brought together."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(buckets))
    n = rows.groupBy(F.col(group).alias("_group"), at.alias("_at")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_group").orderBy("_at"))
    first = F.row_number().over(Window.partitionBy("_group").orderBy("_at")) == 1
    ends = n.select("_group", "_at", upto.alias("_upto"), first.alias("_first")).where((F.col("_upto") <= most) | F.col("_first"))
    ends = ends.groupBy("_group").agg(F.max("_at").alias("_end"))
    return rows.join(F.broadcast(ends), (F.col(group) == F.col("_group")) & (at <= F.col("_end"))).drop("_group", "_end")  # one row a group


def ascii_lower(text):
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def text_of(docs: DataFrame, column: str = "text"):
    return F.coalesce(docs[column], F.lit(""))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
