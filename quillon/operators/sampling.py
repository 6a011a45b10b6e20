"""Samples and splits by arithmetic on ids: the same rows on every run and in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import numbered


def draw(seed: int, *numbers: Column) -> Column:
    """A pseudo-random number from 0 to 999,982 made of integers by a linear rule modulo a prime."""
    h = F.lit(seed % 999_983).cast("long")
    for x in numbers:
        h = (h * 48_271 + x.cast("long") * 69_621 + 12_345) % 999_983
    return h


def number_of(entity_id) -> Column:
    return F.split_part(entity_id, F.lit("-"), F.lit(2)).cast("long")


def split_band(entity_id: str = "s1_id", seed: int = 42) -> Column:
    """0 to 99: the band of an entity; all its pairs go with it."""
    return draw(seed, number_of(entity_id)) % 100


def split(entities: DataFrame, shares: dict[str, int], seed: int = 42) -> DataFrame:
    """entities (s1_id) with `split`, named by shares of 100 in order."""
    out, upto = F.lit(list(shares)[-1]), 100
    for name, share in reversed(shares.items()):
        out = F.when(split_band(seed=seed) < upto, name).otherwise(out)
        upto -= share
    return entities.withColumn("split", out)


def hard_negatives(pairs: DataFrame, truth_pairs: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """k candidates of each record that are no matches, drawn evenly."""
    own = pairs.select("s1_id", "cid").join(truth_pairs, ["s1_id", "cid"], "left_anti")
    order = Window.partitionBy("s1_id").orderBy(draw(seed, number_of("s1_id"), number_of("cid"), F.split_part("cid", F.lit("-"), F.lit(1)).substr(2, 1).cast("long")), "cid")
    return own.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("s1_id", "cid")


def random_negatives(s1: DataFrame, pool: DataFrame, truth_pairs: DataFrame, draws: int = 2, seed: int = 42) -> DataFrame:
    """Records of the same country picked by place; true matches among them are given up, not drawn again."""
    placed = numbered(pool.select("country", F.col("entity_id").alias("cid")), "place", "country", "cid")
    size = placed.groupBy("country").agg(F.count("*").alias("size"), F.min("place").alias("first"))
    picks = s1.select(F.col("entity_id").alias("s1_id"), "country").join(size, "country").withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    picks = picks.withColumn("place", F.col("first") + draw(seed, number_of("s1_id"), F.col("d")) % F.col("size"))
    return picks.join(placed, ["country", "place"]).select("s1_id", "cid").distinct().join(truth_pairs, ["s1_id", "cid"], "left_anti")


def training_pairs(pairs: DataFrame, s1: DataFrame, pool: DataFrame, truth_pairs: DataFrame, k: int = 10, draws: int = 2, seed: int = 42) -> DataFrame:
    """s1_id, cid, label: true pairs whose candidate is in the pool, hard and random negatives."""
    ids = pool.select(F.col("entity_id").alias("cid"))
    yes = truth_pairs.join(ids, "cid", "left_semi").select("s1_id", "cid", F.lit(1).alias("label"))
    no = hard_negatives(pairs, truth_pairs, k, seed).union(random_negatives(s1, pool, truth_pairs, draws, seed)).distinct()
    return yes.union(no.select("s1_id", "cid", F.lit(0)))
