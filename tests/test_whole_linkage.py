"""Costly features of all candidate pairs against plain versions."""

from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.functions import similarity as S
from quillon.functions import vocabulary as V
from quillon.operators import features, model
from quillon.plans import catalogue, duck, linkage

SF = "/root/testdata/sf0.001"


def sorted_tokens(x):
    return " ".join(sorted(x.split()))


def indel(a, b, empty=None):
    """By the plain table of common subsequences."""
    if empty is not None and not (a and b):
        return empty
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return 2 * row[-1] / (len(a) + len(b))


PLAIN = {
    "x2_nts": lambda a, b: indel(sorted_tokens(a["norm_name"]), sorted_tokens(b["norm_name"])),
    "x3_nlv": lambda a, b: indel(a["norm_name"], b["norm_name"]),
    "x4_indel_native": lambda a, b: indel(a["stripped_name"], b["stripped_name"]),
    "x13_slv": lambda a, b: indel(a["street"], b["street"], 0.0),
    "x15_alv": lambda a, b: indel(a["norm_address"], b["norm_address"], 0.0),
    "x18_phs": lambda a, b: indel(" ".join(sorted(a["phonetic"])), " ".join(sorted(b["phonetic"])), 0.0),
    "x19_cbs": lambda a, b: indel(a["compact_brand"], b["compact_brand"], 0.0),
    "x21_sequence_ratio": lambda a, b: SequenceMatcher(None, a["norm_name"], b["norm_name"]).ratio(),
    "x23_jaro_winkler": lambda a, b: S.jaro_winkler_value(a["norm_name"], b["norm_name"]),
}


@pytest.fixture(scope="module")
def plain():
    """The records and all candidate pairs of the smallest table, by SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
    sql = duck.cte(V.POSTING_CAPS)
    cols = ("entity_id", "norm_name", "stripped_name", "street", "norm_address", "phonetic", "compact_brand")
    rec = {r[0]: dict(zip(cols, r)) for r in con.execute(f"{sql} SELECT {', '.join(cols)} FROM rec").fetchall()}
    return rec, set(con.execute(f"{sql} SELECT s1_id, cid FROM cand").fetchall())


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_costly_features_of_all_pairs(spark, plain, name):
    rec, pairs = plain
    got = {(r.s1_id, r.cid): r.value for r in catalogue.queries()[name](spark, SF).collect()}
    assert set(got) == pairs
    some = sorted(got)[::17]
    assert [got[p] for p in some] == pytest.approx([PLAIN[name](rec[p[0]], rec[p[1]]) for p in some], abs=2e-6)


@pytest.mark.parametrize("seed", range(3))
def test_subsequences_of_whole_batches(seed):
    import random

    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcd éz日") for _ in range(r.randint(0, n)))
    a, b = ([word(n) for n in (5, 30, 63, 64, 65, 130, 200) for _ in range(20)] for _ in range(2))
    both = [2 * n / (len(x) + len(y)) if x or y else 1.0 for x, y, n in zip(a, b, S.lcs_lengths(a, b, chunk=16).tolist())]
    assert both == pytest.approx([indel(x, y) for x, y in zip(a, b)])


def test_native_subsequences_of_long_strings(spark):
    rows = [("ab" * 40, "ba" * 33), ("abc", "axbxc"), ("", ""), ("", "a"), ("x" * 62 + "y", "x" * 70)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", S.indel_ratio_native(F.col("a"), F.col("b")).alias("v")).collect()
    assert [r.v for r in got] == pytest.approx([indel(r.a, r.b) for r in got])


def test_the_classifier(spark, plain):
    """It is fitted on the training split alone, scores every candidate of the test split, and tells matches from others."""
    x = linkage.Linkage(spark, SF)
    fitted = linkage.train(x, trees=5, depth=3)
    which = {r.s1_id: r.split for r in x.split.collect()}
    assert {which[r.s1_id] for r in x.labelled.select("s1_id").distinct().collect()} == {"train"}
    rows = linkage.scores(x, fitted, "test").collect()
    assert {(r.s1_id, r.cid) for r in rows} == {p for p in plain[1] if which[p[0]] == "test"}
    assert all(0 <= r.p <= 1 for r in rows)
    truth = {tuple(r) for r in x.truth_pairs.collect()}
    yes, no = ([r.p for r in rows if ((r.s1_id, r.cid) in truth) == t] for t in (True, False))
    assert yes and sum(yes) / len(yes) > 0.5 > sum(no) / len(no)
    shares = model.importance(fitted, spark).collect()
    assert {r.feature for r in shares} == set(V.FEATURES) and sum(r.share for r in shares) == pytest.approx(1)
    assert linkage.train(x, trees=5, depth=3) is fitted


def test_weights_are_fitted_once(spark):
    """A record's features do not depend on the rows that are scored beside it."""
    x = linkage.Linkage(spark, SF)
    one = x.featured.orderBy("s1_id", "cid").first()
    alone = features.features(x.weighed_pairs(spark.createDataFrame([(one.s1_id, one.cid)], "s1_id string, cid string"))).first()
    assert one == alone


def test_models_are_saved_tuned_and_refitted(spark, tmp_path):
    x = linkage.Linkage(spark, SF)
    fitted = linkage.train(x, trees=5, depth=3)
    thresholds = linkage.tuned(x, fitted)
    assert set(thresholds) == {"US", "India", "France", "default"}
    model.save(fitted, thresholds, f"file://{tmp_path}/model")
    again, back = model.load(spark, f"file://{tmp_path}/model")
    assert back == thresholds
    rows = x.featured.limit(50)
    assert [r.p for r in model.score(again, rows).collect()] == [r.p for r in model.score(fitted, rows).collect()]
    hard = model.mine_hard(model.score(fitted, x.labelled))
    assert hard.where("label = 1 or p < 0.2").isEmpty()
    assert model.refit_on_hard(x.labelled, first=fitted, trees=2, depth=2) is not None
    with pytest.raises(ValueError):
        model.tune(x.scored, x.s1_ids, x.truth_pairs, [0.5], split="test")


def test_candidates_under_the_caps_of_the_reference(spark):
    """sf0.01 has keys with 101 to 300 postings."""
    big = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{big}/part.parquet'")
    want = set(con.execute(f"{duck.cte(V.POSTING_CAPS)} SELECT s1_id, cid FROM cand").fetchall())
    assert {(r.s1_id, r.cid) for r in catalogue.queries()["j2_candidates"](spark, big).collect()} == want
    x = linkage.Linkage(spark, big, {"P": 80, "AT": 150, "default": 100})
    fewer = {(r.s1_id, r.cid) for r in x.pairs.collect()}
    assert fewer < want
