"""Whole results of op2, op5 and op6 against plain Python, document by document."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillon.llm import language_id, license_scan, quality

SF = "/root/testdata/sf0.001"


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """All documents of the smallest table, notices with edits, and odd texts: a folder, its rows, its labels."""
    r = random.Random(8)
    docs = [(d.doc_id, d.text, d.lang) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    extra = [None, "", "a", "12 34", "ßtraße Ünïcode", "|" * 400, "free of charge", "mit license mit license"]
    for texts in license_scan.NOTICES.values():
        for t in texts:
            w = t.split()
            extra += [t.upper(), f"before {t}, after; {t}"]
            for whole in ("", "", f" and more of it {t}"):
                v = list(w)
                for _ in range(r.randint(1, 3)):
                    at = r.randrange(len(v))
                    v[at : at + 1] = r.choice([[], ["other"], [v[at], "more"]])
                extra.append("some words " + " ".join(v) + whole)
    docs += [(20_000 + i, t, r.choice(["en", None])) for i, t in enumerate(extra)] + [docs[3]]
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path, docs, labels


def spans(words, k, slack, share):
    """(first, last, label, share) of every place that a notice or phrase has in the words."""
    out = [(i, i + len(p.split()), label, 1.0) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    for label, texts in license_scan.NOTICES.items():
        for t in map(str.split, texts):
            votes = defaultdict(list)
            for p in range(len(words) - k + 1):
                for q in range(len(t) - k + 1):
                    if words[p : p + k] == t[q : q + k]:
                        votes[p - q].append((p, q))
            parts, before = [], None
            for d in sorted(votes):
                if before is None or d - before > slack:
                    parts.append([])
                parts[-1] += votes[d]
                before = d
            for part in parts:
                covered = {q + i for _, q in part for i in range(k)}
                first, last = min(p for p, _ in part), max(p for p, _ in part) + k
                if len(covered) / len(t) >= share and last - first <= len(t) + 2 * slack:
                    out.append((first, last, label, len(covered) / len(t)))
    return out


def test_license_labels_and_scores(spark, corpus):
    path, docs, _ = corpus
    want = []
    for i, text, _ in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        found = spans(w, license_scan.K, license_scan.SLACK, license_scan.SHARE)
        want.append((i, len(w), ",".join(sorted({x[2] for x in found})), round(max((x[3] for x in found), default=0.0), 9)))
    got = [(r.doc_id, r.n_words, r.labels, round(r.score, 9)) for r in license_scan.op2_license_scan(spark, path).collect()]
    assert sorted(got) == sorted(want)
    assert {0.75 < s < 1 for *_, s in want} == {True, False}


def grams(text):
    """Letter n-grams of padded words, counted."""
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        w = f"_{word}_"
        out.update(word)
        out.update(w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1))
    return out


def top(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: language_id.TOP]]


def test_languages_against_plain_profiles(spark, corpus):
    path, docs, _ = corpus
    learnt = defaultdict(Counter)
    for i, text, lang in docs:
        if lang is not None and fold(i, 3) != 1:
            learnt[lang].update(grams(text))
    profiles = {lang: {g: at for at, g in enumerate(top(c))} for lang, c in learnt.items()}
    want = []
    for i, text, _ in docs:
        own = top(grams(text))
        far = min(((sum(abs(p[g] - at) if g in p else language_id.TOP for at, g in enumerate(own)), lang) for lang, p in profiles.items())) if own else None
        want.append((i, fold(i, 3) == 1, far[1] if own else "und", round(1 - far[0] / (language_id.TOP * len(own)), 9) if own else 0.0))
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in language_id.op5_language_id(spark, path).collect()]
    assert sorted(got) == sorted(want)


def plain_features(text):
    """The rates, by loops over characters and words."""
    n = len(text.encode())
    other = lambda c: ord(c) < 128 and not c.isalnum() and c not in "\t\n\x0b\x0c\r "
    upper, digits = sum("A" <= c <= "Z" for c in text), sum("0" <= c <= "9" for c in text)
    letters = upper + sum("a" <= c <= "z" for c in text)
    w, lines = text.split(), text.split("\n")
    return [
        sum(map(other, text)) / (n + 100),
        sum(other(a) and other(b) for a, b in zip(text, text[1:])) / (len(w) + 20),
        upper / (letters + 100),
        digits / (n + 100),
        sum(a == b for a, b in zip(w, w[1:])) / (len(w) + 20),
        max(Counter(w).values(), default=0) / (len(w) + 20),
        max(0.0, 0.5 - len(set(w)) / (len(w) + 1) * math.log2(len(w) + 2) / 10),
        text.count("|") / (len(w) + 20),
        (len(lines) - len(set(lines))) / (len(lines) + 10),
        min(20.0, len(text) / (len(w) + 1)) / 20,
    ]


def test_quality_against_plain_ranking(spark, corpus):
    """Features by loops; pairs drawn with the same numbers; weights where the convex loss is
    least; the threshold at the share of bad documents."""
    path, docs, labels = corpus
    x = {i: plain_features(t or "") for i, t, _ in docs}
    known = sorted((labels[i], x[i]) for i, *_ in docs if i in labels and fold(i, 5) != 0)
    marks = [q for i, q in labels.items() if fold(i, 5) != 0]
    bad = marks.count(0) / len(marks)
    f, good = np.array([v for _, v in known]), np.array([q == 1 for q, _ in known])
    mean, scale = f.mean(0), f.std(0) + 1e-6
    z = lambda v: np.clip((np.array(v) - mean) / scale, -6, 6)
    rng = np.random.default_rng(11)
    a, b = rng.choice(np.flatnonzero(good), quality.PAIRS), rng.choice(np.flatnonzero(~good), quality.PAIRS)
    d = z(f)[a] - z(f)[b]
    model = quality.learn(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet").where(quality.fold() != 0))
    w = np.array(model.weights)
    lost = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
    assert np.abs(d.T @ lost / quality.PAIRS - quality.DECAY * w).max() < 1e-7  # where the convex loss is least
    strength = z(f) @ w
    weight = np.where(good, (1 - bad) / good.sum(), bad / (~good).sum())
    below = weight[strength < model.threshold].sum()
    assert below >= bad * (1 - 1e-6) and below - bad <= weight.max() + 1e-6
    want = sorted((i, fold(i, 5) == 0, round(1 / (1 + math.exp(-max(-500, min(500, float(z(x[i]) @ w) - model.threshold + math.log(3 / 7))))), 6)) for i, *_ in docs)
    rows = quality.op6_quality(spark, path).collect()
    got = sorted((r.doc_id, r.held_out, round(r.score, 6)) for r in rows)
    assert [g[:2] for g in got] == [v[:2] for v in want]
    assert np.allclose([g[2] for g in got], [v[2] for v in want], atol=2e-6)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_quality_of_many_labels_is_fitted_on_all_of_them(spark, monkeypatch):
    """More rows than the driver fits: pairs of whole groups by loops, the threshold over all strengths."""
    r = random.Random(4)
    rows = [(i, 0 if i % 9 == 0 else 1, " ".join(r.choice(["word", "Other", "x", "12", "|", "--", "line\n"]) for _ in range(r.randint(1, 40))) + ("$" * r.randint(0, 9) if i % 9 == 0 else "")) for i in range(900)]
    docs, labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string"), spark.createDataFrame([(i, q) for i, q, _ in rows], "doc_id long, quality int")
    monkeypatch.setattr(quality, "GROUP", 1000)  # one group: every good row against every bad one
    model = quality.learn(docs, labels, sample=20)
    f, good = np.array([quality.features(t) for *_, t in rows]), np.array([q == 1 for _, q, _ in rows])
    mean, scale = f.mean(0), f.std(0) + 1e-6
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale)
    z, w = np.clip((f - mean) / scale, -6, 6), np.array(model.weights)
    d = (z[good][:, None, :] - z[~good][None, :, :]).reshape(-1, len(w))
    assert np.abs(d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - quality.DECAY * w).max() < 1e-6
    s = z @ w
    below, share = (s < model.threshold), (~good).mean()
    assert below.mean() >= share * (1 - 1e-6) and s[below].max() < model.threshold < s[~below].min()
    assert (s < s[below].max() - 1e-9).mean() < share
    monkeypatch.setattr(quality, "GROUP", 50)  # many groups, the rarer class in several
    assert np.corrcoef(s, z @ np.array(quality.learn(docs, labels, sample=20).weights))[0, 1] > 0.98
