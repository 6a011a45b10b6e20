"""License scans by diagonal voting, in DataFrame functions alone.

Texts and templates are sequences of words.  Rolling hashes of k neighbouring words of every text are joined to the same
hashes of the templates; a hit at word p of the text and word t of the template votes for the diagonal p - t, where the
template would begin.  A template that stands in the text unchanged gives all its votes to one diagonal; dropped or
inserted words move the rest of the votes to neighbouring diagonals, which are merged.  Spans are verified by the share of
the template's words that their votes cover.

Plan: the words are exploded once, hashes are joined to the templates by broadcast (the templates are part of the program
and bounded by MOST_GRAMS), and rows without a hit are dropped before the only shuffle, which brings together the hits of
each text.  One row of each text goes along, so texts without hits keep their place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, read

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed by the contract: phrase -> label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Longer notices of well-known licenses, label -> texts; matched with K-word hashes and room for edits.
NOTICES = {
    "apache-2.0": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by": ["licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license"],
    "gpl-3.0": ["this work is licensed under the gnu general public license version 3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "mit-notice": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}
K, SLACK, SHARE, MOST_GRAMS = 3, 3, 0.75, 100_000


def words(text):
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), lambda w: w != "")


def gram(array, at, k: int):
    """Hash of the k words from place at (from 0)."""
    return F.xxhash64(*[F.get(array, at + i) for i in range(k)])


def templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, list[str]]) -> DataFrame:
    """One row for each k-word hash of each template: k, hash, template, label, base, place, size, grams."""
    rows = [(p, label, True, 2) for p, label in phrases.items()] + [(t, label, False, K) for label, texts in notices.items() for t in texts]
    short = [t for t, _, _, k in rows if len(t.split()) < k]
    if short or sum(len(t.split()) for t, *_ in rows) > MOST_GRAMS:
        raise ValueError(f"templates must have a hash's words, and all together at most {MOST_GRAMS}: {short}")
    t = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "template int, text string, label string, base boolean, k int")
    t = t.withColumn("w", F.split("text", " ")).withColumn("size", F.size("w")).withColumn("place", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("k"))))
    t = t.withColumn("hash", F.when(F.col("k") == 2, gram(F.col("w"), F.col("place"), 2)).otherwise(gram(F.col("w"), F.col("place"), K)))
    # The words themselves go along: a hit counts only if they are equal too.
    return t.select("k", "hash", F.array_join(F.slice("w", F.col("place") + 1, F.col("k")), " ").alias("words"), F.struct("template", "label", "base", "k", "place", "size").alias("t"))


def hits(docs: DataFrame, phrases, notices) -> DataFrame:
    """row, doc_id, n_words, p, t: the joined hashes; and for each row of docs one with t null."""
    spark = docs.sparkSession
    w = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
    n = F.size("w")
    shifted = [F.slice("w", F.lit(i + 1), F.greatest(n - i, F.lit(0))).alias(f"w{i}") for i in range(K)]
    rows = w.select("row", "doc_id", n.cast("long").alias("n_words"), F.posexplode_outer(F.arrays_zip(*shifted)).alias("p", "g"))
    rows = rows.select("row", "doc_id", "n_words", F.coalesce("p", F.lit(0)).alias("p"), *[F.col(f"g.w{i}").alias(f"w{i}") for i in range(K)])
    grams = templates(spark, phrases, notices).groupBy("k", "hash").agg(F.collect_list(F.struct("words", "t")).alias("ts"))
    out = rows
    for k in (2, K):
        names = [f"w{i}" for i in range(k)]
        mine = F.when(F.col(names[-1]).isNotNull(), F.xxhash64(*names)).alias(f"h{k}")
        side = grams.where(F.col("k") == k).select(F.col("hash").alias(f"h{k}"), F.col("ts").alias(f"ts{k}"))
        out = out.withColumn(f"h{k}", mine).join(F.broadcast(side), f"h{k}", "left")
    out = out.where((F.col("p") == 0) | F.col("ts2").isNotNull() | F.col(f"ts{K}").isNotNull())
    said = {k: F.concat_ws(" ", *[f"w{i}" for i in range(k)]) for k in (2, K)}
    none = F.array().cast(side.schema[f"ts{K}"].dataType)
    same = lambda k: F.coalesce(F.filter(f"ts{k}", lambda x: x["words"] == said[k]), none)
    return out.select("row", "doc_id", "n_words", "p", F.concat(same(2), same(K)).alias("ts"))


def find_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, spans: one row for each row of docs.

    spans: array of (first, last, base, label, share) ordered by first word; base ones are the places of the phrases.
    Null and empty texts have no words and no spans; repeated rows are looked at one by one; an empty table gives an empty
    result.  Columns but doc_id and text are not looked at.
    """
    votes = hits(docs, phrases, notices).withColumn("t", F.explode_outer("ts")).where((F.col("p") == 0) | F.col("t").isNotNull())
    votes = votes.select("row", "doc_id", "n_words", "p", "t.t.*").withColumn("diagonal", F.col("p") - F.col("place"))
    # Votes of one diagonal.
    lines = votes.groupBy("row", "doc_id", "n_words", "template", "label", "base", "k", "size", "diagonal").agg(F.collect_set("place").alias("places"), F.min("p").alias("first"), (F.max("p") + F.max("k")).alias("last"))
    # Neighbouring diagonals of a notice whose spans lie near each other are one place.
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    new = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(order) > SLACK)
    lines = lines.withColumn("part", F.sum(F.when(new, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spots = lines.groupBy("row", "doc_id", "n_words", "template", "label", "base", "k", "size", "part").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("first").alias("first"), F.max("last").alias("last"))
    # Template words that the votes cover: each vote covers k of them.
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda x: F.sequence(x, x + F.col("k") - 1)))))
    share = F.when(F.col("template").isNotNull(), covered / F.col("size"))
    close = F.col("last") - F.col("first") <= F.col("size") + 2 * SLACK
    good = F.when(F.col("base"), share == 1.0).otherwise((share >= SHARE) & close)
    spot = F.when(good, F.struct("first", "last", "base", "label", share.alias("share")))
    return spots.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.collect_list(spot)).alias("spans")).drop("row")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_licenses(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    starts = F.transform(base, lambda x: x["first"].cast("long"))
    best = F.coalesce(F.array_max(F.transform("spans", lambda x: x["share"])), F.lit(0.0))
    return rows.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), best.alias("score"))
