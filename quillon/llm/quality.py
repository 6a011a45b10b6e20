"""Document quality by Bradley-Terry pairwise ranking.

Each preference pair, a document marked good against one marked bad, is an observation that the first beats the second;
scores are linear in features of the whole text, and logistic loss on feature differences is minimised by Newton steps.
The decision threshold is the quantile of the scores that leaves out the share of bad documents among the labels, class
counts weighing the sample.  The published score is moved so that the threshold is 0.3.

Up to SAMPLE labelled rows of each class are fitted on the driver, on pairs drawn from all of them.  More are fitted where
they lie: all labelled rows, dealt by hash into groups of about GROUP rows of the larger class, in which every good row meets
every bad one; rows of the smaller class go to several groups where a group would have less than LEAST of them.  Only sums come
to the driver, and the threshold is narrowed down by counts of all scores.  Features are shuffled, never texts; scoring is
narrow: no shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, lean, read, text_of, written

#: Labelled rows of each class that the driver fits, preference pairs drawn from them, weight decay, and the score at the threshold.
SAMPLE, PAIRS, DECAY, AT = 5000, 100_000, 1e-3, 0.3
#: Rows of a group, least rows of its smaller class, and bins of a round of narrowing.
GROUP, LEAST, BINS = 128, 32, 4096
BYTES = np.zeros(256, np.int64)  # 1 lower, 2 upper, 3 digit, 4 space, 5 other ASCII
BYTES[97:123], BYTES[65:91], BYTES[48:58] = 1, 2, 3
BYTES[[9, 10, 11, 12, 13, 32]] = 4
BYTES[[b for b in range(128) if not BYTES[b]]] = 5
NAMES = ["symbols", "symbol_runs", "upper", "digits", "neighbours_alike", "most_common", "few_words", "pipes", "lines_alike", "word_length"]


def features(text: str) -> list[float]:
    """Rates in the whole text, smoothed so that short texts are near 0."""
    data = np.frombuffer(text.encode(), np.uint8)
    kinds = BYTES[data]
    n = np.bincount(kinds, minlength=6)
    other = kinds == 5
    runs = int((other[1:] & other[:-1]).sum())
    words = text.split()
    w = len(words)
    counts = {}
    distinct = len(set(words))
    alike = sum(map(eq, words, words[1:]))
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    lines = text.split("\n")
    letters = n[1] + n[2]
    return [
        n[5] / (len(data) + 100),
        runs / (w + 20),
        n[2] / (letters + 100),
        n[3] / (len(data) + 100),
        alike / (w + 20),
        max(counts.values(), default=0) / (w + 20),
        max(0.0, 0.5 - distinct / (w + 1) * math.log2(w + 2) / 10),
        text.count("|") / (w + 20),
        (len(lines) - len(set(lines))) / (len(lines) + 10),
        min(20.0, len(text) / (w + 1)) / 20,
    ]


@dataclass(frozen=True)
class Model:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Bradley-Terry strengths."""
        return np.clip((x - np.array(self.mean)) / np.array(self.scale), -6, 6) @ np.array(self.weights)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scores(x) - self.threshold + math.log(AT / (1 - AT)), -500, 500)))


NEUTRAL = Model((0.0,) * len(NAMES), (1.0,) * len(NAMES), (0.0,) * len(NAMES), 0.0)


def fit(x: np.ndarray, good: np.ndarray, share_bad: float, pairs: int = PAIRS) -> Model:
    """share_bad: of all labelled rows.  One class alone has no pairs: then every score is AT."""
    if good.all() or not good.any():
        return NEUTRAL
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(11)
    a, b = rng.choice(np.flatnonzero(good), pairs), rng.choice(np.flatnonzero(~good), pairs)
    d = z[a] - z[b]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # chance that the pair is lost
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + DECAY * np.eye(len(w)), d.T @ p / pairs - DECAY * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    mass = np.where(good, (1 - share_bad) / good.sum(), share_bad / (~good).sum())[order].cumsum()
    at = min(int(np.searchsorted(mass, share_bad * (1 - 1e-9))), len(s) - 2)
    return Model(tuple(mean), tuple(scale), tuple(w), float((s[order[at]] + s[order[at + 1]]) / 2))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs (doc_id, text), labels (doc_id, quality) -> model.  Rows without a label teach nothing.  sample: labelled rows of
    a class up to which the driver fits; every labelled row counts in any case."""
    labels = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r.quality: r["count"] for r in labels.groupBy("quality").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return NEUTRAL
    share_bad, few = counts[0] / sum(counts.values()), max(counts.values()) <= sample
    chosen = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = docs.select("doc_id", text_of(docs).alias("text")).where(F.col("doc_id").isNotNull())
    if few:
        rows = rows.join(F.broadcast(chosen), "doc_id")  # 2 * sample rows at most

    def task(batches):
        for b in batches:
            x = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "text"), pa.array(x, pa.list_(pa.float64()))], names=[*(c for c in b.schema.names if c != "text"), "x"])

    out = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"] + ["x array<double>"])
    rows = rows.mapInArrow(lean(task), out)
    if not few:
        return fit_all(written(rows.join(chosen, "doc_id"), "quality-rows"), share_bad)
    got = sorted((r.quality, r.x) for r in rows.select("quality", "x").collect())
    return fit(np.array([x for _, x in got]), np.array([q == 1 for q, _ in got]), share_bad) if got else NEUTRAL


def pair_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pairs, gradient and curvature of the loss over every good row against every bad one."""
    p = 1 / (1 + np.exp(np.clip((good @ w)[:, None] - (bad @ w)[None, :], -500, 500)))  # chance that the pair is lost
    q = p * (1 - p)
    across = good.T @ q @ bad
    curve = (good.T * q.sum(1)) @ good + (bad.T * q.sum(0)) @ bad - across - across.T
    return np.concatenate([[p.size], good.T @ p.sum(1) - bad.T @ p.sum(0), curve.ravel()])


def fit_all(rows: DataFrame, share_bad: float) -> Model:
    """The model of all rows (doc_id, quality, x), which stay where they are."""
    k = len(NAMES)
    x = [F.col("x")[i] for i in range(k)]
    n = rows.agg(F.count_if(F.col("quality") == 0).alias("n0"), F.count_if(F.col("quality") == 1).alias("n1"), F.array(*map(F.avg, x)).alias("mean"), F.array(*map(F.stddev_pop, x)).alias("scale")).first()
    if not n.n0 or not n.n1:
        return NEUTRAL
    mean, scale = np.array(n.mean), np.array(n.scale) + 1e-6
    groups, rarer = math.ceil(max(n.n0, n.n1) / GROUP), int(n.n1 < n.n0)
    copies = min(groups, math.ceil(groups * LEAST / min(n.n0, n.n1)))
    times = F.when(F.col("quality") == rarer, copies).otherwise(1)
    dealt = rows.select("quality", "x", F.pmod(F.xxhash64("doc_id", "x"), F.lit(groups)).alias("_at"), F.explode(F.sequence(F.lit(0), times - 1)).alias("_copy"))
    dealt = dealt.groupBy(((F.col("_at") + F.col("_copy")) % groups).alias("_group")).agg(*(F.sort_array(F.collect_list(F.when(F.col("quality") == q, F.col("x")))).alias(a) for a, q in (("good", 1), ("bad", 0))))
    dealt = written(dealt.select("good", "bad"), "quality-groups")
    z = lambda v: np.clip((v - mean) / scale, -6, 6)

    def sums(w):
        def task(batches):
            total = np.zeros(1 + k + k * k)
            for b in batches:
                for good, bad in zip(b.column("good"), b.column("bad")):
                    if len(good) and len(bad):
                        total += pair_sums(*(z(side.values.flatten().to_numpy().reshape(-1, k)) for side in (good, bad)), w)
            yield pa.RecordBatch.from_pydict({"s": pa.array([total.tolist()], pa.list_(pa.float64()))})

        got = np.array(sorted(r.s for r in dealt.mapInArrow(task, "s array<double>").collect())).sum(0)
        return got[1 : k + 1] / got[0], got[k + 1 :].reshape(k, k) / got[0]

    w = np.zeros(k)
    with arrow_rows(rows.sparkSession, 4 * GROUP * 8 * k):
        for _ in range(30):
            slope, curve = sums(w)
            step = np.linalg.solve(curve + DECAY * np.eye(k), slope - DECAY * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break

    def strength(batches):
        for b in batches:
            v = b.column("x").flatten().to_numpy().reshape(-1, k)
            yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array(z(v) @ w)], names=["quality", "s"])

    scored = written(rows.select("quality", "x").mapInArrow(strength, "quality int, s double"), "quality-strengths")
    return Model(tuple(mean), tuple(scale), tuple(w), threshold(scored, share_bad, share_bad / n.n0, (1 - share_bad) / n.n1))


def threshold(scored: DataFrame, share: float, bad: float, good: float) -> float:
    """Halfway from the first strength s up to which the rows weigh `share` to the next one; weights of a row by quality."""
    ends = scored.agg(F.min("s").alias("lo"), F.max("s").alias("hi")).first()
    lo, hi, below = ends.lo, ends.hi, 0.0
    while lo < hi:
        bin_ = F.least(F.floor((F.col("s") - lo) / (hi - lo) * BINS), F.lit(BINS - 1))
        got = scored.where((F.col("s") >= lo) & (F.col("s") <= hi)).groupBy(bin_.alias("bin")).agg(F.count_if(F.col("quality") == 0).alias("n0"), F.count_if(F.col("quality") == 1).alias("n1"), F.min("s").alias("lo"), F.max("s").alias("hi")).collect()  # BINS rows at most
        for r in sorted(got):
            lo, hi, mass = r.lo, r.hi, r.n0 * bad + r.n1 * good
            if below + mass >= share * (1 - 1e-9):
                break
            below += mass
        else:
            lo = hi
    after = scored.where(F.col("s") > lo).agg(F.min("s")).first()[0]
    return lo if after is None else (lo + after) / 2


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from AT on).

    Null and empty texts are scored as texts without words.  Repeated rows score alike, nothing but the text is looked at,
    clashing columns are replaced, all others stay, and an empty table stays empty.
    """
    docs = docs.drop("score", "predicted")
    keep = docs.columns
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["score double, predicted int"])

    def task(batches):
        for b in batches:
            x = np.array([features(t or "") for t in b.column("text").to_pylist()]).reshape(-1, len(NAMES))
            p = model.probability(x)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(p, pa.float64()), pa.array((p >= AT).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.mapInArrow(lean(task), out)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model predicts to be good.  All columns stay as they are, whatever their names; null and
    empty texts are scored as texts without words."""

    def task(batches):
        for b in batches:
            x = np.array([features(t or "") for t in b.column("text").to_pylist()]).reshape(-1, len(NAMES))
            yield b.filter(pa.array(model.probability(x) >= AT))

    return docs.mapInArrow(lean(task), docs.schema)


def fold():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(1))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = learn(docs, labels.where(fold() != 0))
    return score(docs.select("doc_id", (fold() == 0).alias("held_out"), text_of(docs).alias("text")), model).drop("text")
