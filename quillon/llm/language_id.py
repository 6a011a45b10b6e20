"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent letter n-grams (1 to 3 letters, words padded with _).  A document's
own list is made in the same way from its whole text, and its distance to a language is the sum, over its n-grams, of how
far each is out of place in the language's list; n-grams that are not there count as the list's length.

Profiles are learnt from about SAMPLE documents of each language (the first by a hash of doc_id): a bounded sample, of which
each task counts n-grams before anything is shuffled.  Languages x TOP n-grams go to every executor.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, sampled, text_of

#: Documents of each language that profiles are learnt from, n-grams in a profile, characters looked at together.
SAMPLE, TOP, PORTION = 2000, 300, 1_000_000
EDGE = ord("_")
_letters = []


def is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def portions(text: str):
    """The text in parts that end at a space where there is one."""
    while len(text) > PORTION:
        at = text.rfind(" ", 1, PORTION) if " " in text[1:PORTION] else PORTION
        yield text[:at]
        text = text[at:]
    yield text


def added(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams and the sums of their counts."""
    g, where = np.unique(np.concatenate(grams), return_inverse=True)
    return g, np.bincount(where, weights=np.concatenate(counts), minlength=len(g)).astype(np.int64)


def count_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams of a text and their counts.  An n-gram is one number, 21 bits a code point, so numbers sort as the
    strings do; _ stands for either end of a word."""
    parts = []
    for part in portions(text.lower()):
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letter = is_letter()[c]
        c = np.where(letter, c, EDGE)
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one edge behind each word
        c = np.concatenate([[EDGE], c[keep], [EDGE]])
        inside = c != EDGE
        two = (c[:-1] << 42) | (c[1:] << 21)
        parts += [c[inside] << 42, two[inside[:-1] | inside[1:]], (two[:-1] | c[2:])[inside[1:-1]]]
    return np.unique(np.concatenate(parts), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams, ties by code point."""
    return grams[np.argsort(-counts, kind="stable")[:TOP]]


def predict(text: str, profiles: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[str, float]:
    """The nearest language (ties: the first by code point) and how near it is, from 0 to 1.  A profile is its n-grams
    in order of code points, and their places."""
    own = ranked(*count_grams(text))
    if not len(own) or not profiles:
        return "und", 0.0
    at, best = np.arange(len(own)), []
    for lang, (grams, places) in profiles.items():
        i = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        best.append((int(np.where(grams[i] == own, np.abs(places[i] - at), TOP).sum()), lang))
    far, lang = min(best)
    return lang, 1.0 - far / (TOP * len(own))


def learn(labelled: DataFrame, sample: int = SAMPLE) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """doc_id, text, lang -> profiles.  Rows without lang or text teach nothing."""
    some = labelled.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", F.col("lang").alias("_lang"))
    chosen = sampled(some, "_lang", sample)

    def task(batches):
        for b in batches:
            totals: dict[str, list] = defaultdict(list)
            for text, lang in zip(b.column("text").to_pylist(), b.column("_lang").to_pylist()):
                if text and lang is not None:
                    totals[lang].append(count_grams(text))
            for lang, found in totals.items():
                g, n = added(*zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], names=["lang", "gram", "n"])

    counts = chosen.mapInArrow(task, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= TOP)
    rows: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for r in top.select("lang", "gram", "place").collect():  # TOP rows a language
        rows[r.lang].append((r.gram, r.place - 1))
    return {lang: tuple(np.array(x, np.int64) for x in zip(*sorted(own))) for lang, own in rows.items()}


def identify(docs: DataFrame, profiles: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """docs with lang_pred and score (0 to 1).

    Null texts and texts without a letter are `und` with score 0; nothing but the text is looked at; repeated rows get the
    same answer; with no profile all are `und`.  Clashing columns are replaced, all others stay.  Narrow: no shuffle.
    """
    docs = docs.drop("lang_pred", "score")
    shared, keep = docs.sparkSession.sparkContext.broadcast(profiles), docs.columns
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["lang_pred string, score double"])

    def task(batches):
        for b in batches:
            found = [predict(t or "", shared.value) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.mapInArrow(task, out)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3, F.lit(0))
    profiles = learn(docs.where(fold != 1).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", (fold == 1).alias("held_out"), text_of(docs).alias("text")), profiles).drop("text")
