"""Exact deduplication by content-defined chunk recipes.

A normalised text (white space deleted) is cut where a rolling hash of its last 16 bytes says so, so equal passages give
equal chunks wherever they stand.  A chunk's identifier is a keyed 128-bit digest.  Chunks travel once, each at most once
a task, to show that no identifier stands for two contents; should one ever do, everything runs again under another key.
After that only recipes, the ordered identifier lists (16 bytes for about 2 KB of text), are compared: equal recipes are
equal texts, and long documents do not move again.

Groups of copies are added up before the shuffle.  Decisions go back to the rows in a join of two written tables, whose
partitions adaptive execution can split, so a group that holds a third of all rows is not one task's work.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, arrow_rows, fresh, lean, read, written

DELETE = b" \t\n\x0b\x0c\r"
LEAST, MOST, MASK = 512, 16_384, np.uint32(0x7FF << 21)
GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks: content-defined, between LEAST and MOST bytes apart (the last chunk may be shorter)."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8):  # h[i] covers 2 * width bytes after each step
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    ends, last = [], 0
    for at in (np.flatnonzero((h & MASK) == 0) + 1).tolist():
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            ends.append(at)
            last = at
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return ends if last == n else [*ends, n]


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def identifier(chunk: bytes, key: int, size: int = 16) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size, key=key.to_bytes(4, "little")).digest()


def normalised(batch, column: str = "text") -> list[bytes]:
    return [(t or b"").translate(None, DELETE) for t in batch.column(column).cast(pa.binary()).to_pylist()]


def collides(docs: DataFrame, key: int, size: int) -> bool:
    """Does an identifier stand for two contents?  Chunks are shuffled by content, identifiers of distinct ones are counted."""

    def task(batches, remember: int = 20_000):
        seen: dict[bytes, bytes] = {}
        for b in batches:
            ids, contents = [], []
            for data in normalised(b):
                for c in chunks(data):
                    i = identifier(c, key, size)
                    if seen.get(i) != c:
                        if len(seen) >= remember:
                            seen.clear()
                        seen[i] = c
                        ids.append(i)
                        contents.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(contents, pa.binary())], names=["id", "content"])

    found = docs.select("text").mapInArrow(lean(task), "id binary, content binary")
    return not found.groupBy("id", "content").count().groupBy("id").count().where("count > 1").isEmpty()


def recipes(docs: DataFrame, key: int, size: int) -> DataFrame:
    """doc_id, n_points, row_hash, text_sha256, recipe of every row."""

    def task(batches):
        for b in batches:
            sha, recipe = [], []
            for data in normalised(b):
                sha.append(hashlib.sha256(data).hexdigest())
                recipe.append(b"".join(identifier(c, key, size) for c in chunks(data)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "n_points", "row_hash")), pa.array(sha, pa.string()), pa.array(recipe, pa.binary())], names=["doc_id", "n_points", "row_hash", "text_sha256", "recipe"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_points"), row_hash().alias("row_hash"), "text")
    return rows.mapInArrow(lean(task), "doc_id long, n_points long, row_hash long, text_sha256 string, recipe binary")


def row_hash():
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def decisions(docs: DataFrame, size: int = 16) -> DataFrame:
    """doc_id, row_hash, times, keep_id, group_size, best, text_sha256: one row for each set of rows alike in id and text.

    Of equal texts the one with the most code points, then the smallest doc_id (null last) is best.  Null texts are empty,
    and empty texts are equal.  An empty table gives no row.  Columns but doc_id and text are not looked at.
    size: bytes an identifier has (small ones only serve to test collisions).
    """
    key = 0
    with arrow_rows(docs.sparkSession, ROW):
        while collides(docs, key, size):
            key, size = key + 1, min(size + 1, 64)
        rows = recipes(docs, key, size)
        alike = written(rows.groupBy("recipe", "doc_id", "n_points", "row_hash", "text_sha256").agg(F.count("*").alias("times")), "recipes")
    rank = F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("row_hash").alias("d"))
    groups = alike.groupBy(F.col("recipe").alias("of")).agg(F.sum("times").alias("size"), F.min(rank).alias("first"))
    groups = written(groups.where("size > 1"), "recipe-groups")
    both = alike.join(groups, F.col("recipe") == F.col("of"), "left")
    alone = F.col("size").isNull()
    return both.select("doc_id", "row_hash", "times", F.when(alone, F.col("doc_id")).otherwise(F.col("first.c")).alias("keep_id"), F.coalesce("size", F.lit(1)).alias("group_size"), (alone | (F.col("first") == rank)).alias("best"), "text_sha256")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs without the rows that an equal text replaces; of rows alike in id and text one stays.  All columns stay."""
    made = written(decisions(docs).select("doc_id", "row_hash", "best", "times"), "exact")
    mine, its, own = (fresh(docs.columns, c) for c in ("_mine", "_its", "_own"))
    gone = made.where(~F.col("best")).select(F.col("doc_id").alias(its), F.col("row_hash").alias(own))
    kept = docs.withColumn(mine, row_hash())
    kept = kept.join(gone, F.col("doc_id").eqNullSafe(F.col(its)) & (F.col(mine) == F.col(own)), "left_anti")
    if not made.where(F.col("best") & (F.col("times") > 1)).isEmpty():
        kept = kept.dropDuplicates(["doc_id", mine])
    return kept.drop(mine)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decisions(read(spark, sf_dir, "documents")).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return made.select("doc_id", "keep_id", "group_size", (F.col("best") & (F.col("nth") == 1)).alias("kept"), "text_sha256")


#: Rows that are alike in id and text share one rank here; the tables that this runs on have none.
SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w AS k FROM t
  WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, k = 1 AS kept, text_sha256 FROM g
"""
