"""The linkage pipeline end to end."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import POSTING_CAPS
from ..operators import blocking, features, model, records, resolve, sampling, simple
from ..sources import fixture, readers, staging
from ..sources.sinks import match_rows

THRESHOLDS = {"US": 0.5, "India": 0.45, "default": 0.4}


class Linkage:
    """Records, pairs, scores and matches of one data folder; every part is a plan, nothing runs before it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, caps: dict[str, int] = POSTING_CAPS):
        self.spark, self.sf_dir, self.caps = spark, sf_dir, caps

    def staged(self, name: str, make) -> DataFrame:
        return staging.staged(self.spark, (name, *sorted(self.caps.items())), make, f"{self.sf_dir}/part.parquet")

    @functools.cached_property
    def ent(self) -> DataFrame:
        return fixture.records(self.spark, self.sf_dir)

    @functools.cached_property
    def truth(self) -> DataFrame:
        return fixture.truth(self.spark, self.sf_dir)

    @functools.cached_property
    def truth_pairs(self) -> DataFrame:
        return readers.truth_pairs(self.truth)

    @functools.cached_property
    def rec(self) -> DataFrame:
        return self.staged("records", lambda: records.derive(self.ent, ascii_only=True))

    @functools.cached_property
    def simple(self) -> DataFrame:
        """All records with the fields of the small feature set."""
        return self.staged("simple", lambda: simple.derive(self.ent))

    @property
    def s1(self) -> DataFrame:
        return self.rec.where("source = 'S1'")

    @property
    def pool(self) -> DataFrame:
        return self.rec.where("source <> 'S1'")

    @property
    def s1_ids(self) -> DataFrame:
        return self.ent.where("entity_id like 'S1-%'").select(F.col("entity_id").alias("s1_id"), "country")

    @functools.cached_property
    def pairs(self) -> DataFrame:
        return self.staged("pairs", lambda: blocking.block(self.s1, self.pool, self.caps))

    @functools.cached_property
    def paired(self) -> DataFrame:
        return features.pair_up(self.pairs, self.s1, self.pool)

    @functools.cached_property
    def scored(self) -> DataFrame:
        return self.staged("scored", lambda: features.linear_score(self.paired).join(self.s1_ids, "s1_id"))

    @functools.cached_property
    def idf(self) -> dict[str, DataFrame]:
        """Term weights of all names of the reference and the other sources, fitted once."""
        return {space: self.staged(f"idf-{space}", lambda space=space: features.fit_idf(self.rec, space)) for space in features.SPACES}

    @functools.cached_property
    def weighed(self) -> DataFrame:
        return self.staged("weighed", lambda: features.weigh(self.rec, self.idf))

    def weighed_pairs(self, pairs: DataFrame) -> DataFrame:
        w = self.weighed
        return features.pair_up(pairs, w.where("source = 'S1'"), w.where("source <> 'S1'"))

    @functools.cached_property
    def featured(self) -> DataFrame:
        """The 21 features of all candidate pairs."""
        return self.staged("features", lambda: features.features(self.weighed_pairs(self.pairs)))

    @functools.cached_property
    def split(self) -> DataFrame:
        return sampling.split(self.s1_ids, {"train": 60, "validation": 20, "test": 20})

    @functools.cached_property
    def labelled(self) -> DataFrame:
        """Training pairs with features and labels: true pairs, hard and random negatives of the training split."""
        one, two = (self.ent.where(f"entity_id {x} 'S1-%'") for x in ("like", "not like"))

        def make():
            mine = sampling.training_pairs(self.pairs, one, two, self.truth_pairs)
            mine = staging.written(mine.join(self.split.where("split = 'train'").select("s1_id"), "s1_id", "left_semi"), "labelled")
            return features.features(self.weighed_pairs(mine.select("s1_id", "cid"))).join(mine, ["s1_id", "cid"])

        return self.staged("training", make)

    @functools.cached_property
    def matches(self) -> DataFrame:
        return resolve.resolve(self.scored, THRESHOLDS)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which noisy records match each reference record: one row for each of these, with its matches."""
    x = Linkage(spark, sf_dir)
    return match_rows(x.s1_ids, x.matches)


_MODELS: dict[tuple, object] = {}


def train(x: Linkage, **kw):
    """Classifier over the 21 features, fitted once a session on the training split's pairs."""
    key = (x.spark.sparkContext.applicationId, x.sf_dir, staging.listing(x.spark, f"{x.sf_dir}/part.parquet"), *sorted(kw.items()))
    if key not in _MODELS:
        _MODELS[key] = model.fit(x.labelled, **kw)
    return _MODELS[key]


def train_on_hard(x: Linkage, **kw):
    """The same, fitted again with the negatives that the first model likes, twice over."""
    key = ("hard", x.spark.sparkContext.applicationId, x.sf_dir, staging.listing(x.spark, f"{x.sf_dir}/part.parquet"), *sorted(kw.items()))
    if key not in _MODELS:
        _MODELS[key] = model.refit_on_hard(x.labelled, first=train(x, **kw), **kw)
    return _MODELS[key]


def scores(x: Linkage, fitted, split: str | None = None) -> DataFrame:
    """s1_id, cid, p, country of all candidate pairs, or those of a split's records."""
    rows = x.featured if split is None else x.featured.join(x.split.where(F.col("split") == split).select("s1_id"), "s1_id", "left_semi")
    return model.score(fitted, rows).select("s1_id", "cid", "p").join(x.s1_ids, "s1_id")


#: Thresholds that are tried for each country.
TRIED = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]


def tuned(x: Linkage, fitted) -> dict[str, float]:
    """Best threshold of each country on the validation split."""
    key = ("t", x.spark.sparkContext.applicationId, x.sf_dir, id(fitted))
    if key not in _MODELS:
        mine = x.split.where("split = 'validation'").select("s1_id", "country")
        _MODELS[key] = model.tune(staging.written(scores(x, fitted, "validation"), "validation"), mine, x.truth_pairs, TRIED)
    return _MODELS[key]


def predict(x: Linkage, fitted, thresholds, gate_at: float | None = 0.30) -> DataFrame:
    """Matches of every reference record by the classifier; pairs that fail the gate are no matches."""
    scored = scores(x, fitted)
    if gate_at is not None:
        scored = scored.join(x.paired.where(features.gate() >= gate_at).select("s1_id", "cid"), ["s1_id", "cid"], "left_semi")
    return resolve.resolve(scored, thresholds)
