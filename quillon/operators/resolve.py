"""From scored pairs to matches: each candidate goes to one reference record, each record ranks what it won."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import DEFAULT_THRESHOLDS
from ..sources.staging import numbered


def threshold(country: Column, thresholds: dict[str, float] | float) -> Column:
    if not isinstance(thresholds, dict):
        return F.lit(float(thresholds))
    out = F.lit(float(thresholds["default"]))
    for c, t in thresholds.items():
        if c != "default":
            out = F.when(country == c, float(t)).otherwise(out)
    return out


def primary(scored: DataFrame, thresholds: dict[str, float] | float) -> DataFrame:
    """Pairs (s1_id, cid, p, country) at or above their country's threshold."""
    return scored.where(F.col("p") >= threshold(F.col("country"), thresholds))


def winners(pairs: DataFrame, *within: str) -> DataFrame:
    """Of the pairs of a candidate the one of highest p, ties to the smaller s1_id.  within: columns that part the claims
    (a chunk, a threshold); none: over everything."""
    w = Window.partitionBy(*within, "cid").orderBy(F.desc("p"), "s1_id")
    return pairs.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") == 1).drop("_nth")


def ranked(pairs: DataFrame, most: int | None, *within: str) -> DataFrame:
    """Each record's pairs by p, ties by cid, as rank; the first `most`."""
    out = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*within, "s1_id").orderBy(F.desc("p"), "cid")))
    return out if most is None else out.where(F.col("rank") <= most)


def resolve(scored: DataFrame, thresholds: dict[str, float] | float = DEFAULT_THRESHOLDS, most: int = 12, within: tuple[str, ...] = ()) -> DataFrame:
    """s1_id, cid, p, rank: threshold, winner of each candidate, at most `most` a record."""
    return ranked(winners(primary(scored, thresholds), *within), most, *within)


def resolve_margin(scored: DataFrame, primary_t: float = 0.40, secondary_t: float = 0.55, margin: float = 0.25) -> DataFrame:
    """A record keeps its best candidate if it won it; others it won need secondary_t and to lie within the margin of its
    best score, which counts even where that candidate was lost."""
    own = scored.where(F.col("p") >= primary_t)
    w = Window.partitionBy("s1_id")
    own = own.withColumn("_top", F.max("p").over(w)).withColumn("_place", F.row_number().over(w.orderBy(F.desc("p"), "cid")))
    won = winners(own).where((F.col("_place") == 1) | ((F.col("p") >= min(secondary_t, 1.0)) & (F.round(F.col("_top") - F.col("p"), 9) <= margin)))
    return ranked(won.drop("_top", "_place"), None)


def pairwise(scored: DataFrame, t: float) -> DataFrame:
    """Baseline: every pair at or above t."""
    return ranked(scored.where(F.col("p") >= t), None)


def chunked(scored: DataFrame, s1: DataFrame, size: int = 5000) -> DataFrame:
    """scored with chunk_id: records by id, `size` to a chunk, for results of a run that resolves chunk by chunk."""
    chunk = numbered(s1.select("s1_id"), "_place", "s1_id")
    return scored.join(chunk.select("s1_id", F.floor(F.col("_place") / size).alias("chunk_id")), "s1_id")
