"""Queries against their DuckDB twins, plans, resolution and metrics."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.operators import metrics, resolve, validate
from quillon.plans import catalogue, linkage
from quillon.sources import readers, sinks

SF = "/root/testdata/sf0.001"
SOME = "sc4_needed_or_background sc7_ground_truth_parse n4_normalize_name n11_skeleton n15_parse_addr f2_df_cap j2_candidates j4_scored_topk a6_blocking_recall x10_nsm x6_twc x7_tcc x23_jaro_winkler f8_probability_band u5_augmented m3_resolve_chunked j3_simple_blocking j10_address_overlap w1_tfidf_word f3_gate m3_resolve m4_resolve_margin m6_train_pairs a4_macro_prf a9_threshold_sweep a18_pair_prf u4_fp_fn_except m10_validate sk1_matching_rows".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("part", "customer", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", SOME)
def test_twins(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = con.execute(catalogue.oracle_sql()[name])
    at = [[d[0] for d in r.description].index(c) for c in cols]
    assert got == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)


def test_no_cross_product(spark):
    x = linkage.Linkage(spark, SF)
    plan = x.matches._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "WindowGroupLimit" in plan


def test_each_candidate_goes_to_one_record(spark):
    rows = spark.createDataFrame([("S1-1", "S2-1", 0.9, "US"), ("S1-2", "S2-1", 0.9, "US"), ("S1-2", "S2-2", 0.8, "FR"), ("S1-3", "S2-3", 0.1, "US")], "s1_id string, cid string, p double, country string")
    got = {(r.s1_id, r.cid) for r in resolve.resolve(rows, {"US": 0.5, "default": 0.7}).collect()}
    assert got == {("S1-1", "S2-1"), ("S1-2", "S2-2")}


def test_margin_counts_a_lost_best(spark):
    rows = spark.createDataFrame([("S1-1", "S2-1", 0.9), ("S1-1", "S2-2", 0.6), ("S1-1", "S2-3", 0.7), ("S1-2", "S2-1", 0.95)], "s1_id string, cid string, p double")
    assert {(r.s1_id, r.cid) for r in resolve.resolve_margin(rows).collect()} == {("S1-2", "S2-1"), ("S1-1", "S2-3")}


def test_f05_of_the_contract(spark):
    s1 = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "s1_id string")
    truth = spark.createDataFrame([("S1-1", "a"), ("S1-1", "b")], "s1_id string, cid string")
    pred = spark.createDataFrame([("S1-1", "a"), ("S1-1", "b"), ("S1-1", "c"), ("S1-3", "x")], "s1_id string, cid string")
    got = {r.s1_id: round(r.f05, 3) for r in metrics.per_record(s1, pred, truth).collect()}
    assert got == {"S1-1": 0.714, "S1-2": 1.0, "S1-3": 0.0}


def test_validator(spark):
    text = ["source1_entity_id,matched_entity_ids", "S1-1\tS2-1,S2-1", "S1-1\tS2-2", "S1-2\tS1-9", "S1-3 S2-1", "S1-4\tQ-1", "S1-9\t"]
    lines = spark.createDataFrame(list(enumerate(text)), "line long, value string")
    s1 = spark.createDataFrame([(f"S1-{i}",) for i in (1, 2, 4, 5)], "s1_id string")
    rules = {r.rule: r.n for r in validate.rules(validate.parse_lines(lines, validate.HEADERS["matching"]), s1).collect()}
    assert rules == {"comma_header": 1, "no_tab": 1, "duplicate_row": 1, "repeated_id": 1, "self_match": 1, "bad_prefix": 1, "missing_record": 1, "extra_record": 1}


def test_tsv_round_trip(spark, tmp_path):
    path = str(tmp_path / "r.tsv")
    with open(path, "w") as f:
        f.write('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA "B" C\tnan\tUS\nS1-2\tX\t\tIndia\nS1-3\tY\tZ\t\n')
    got = [tuple(r) for r in readers.records_tsv(spark, path).orderBy("entity_id").collect()]
    assert got == [("S1-1", 'A "B" C', "", "US"), ("S1-2", "X", "", "India")]
    out = str(tmp_path / "out")
    sinks.write_tsv(spark.createDataFrame([("S1-1", "S2-1,S2-2"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string"), out)
    assert {tuple(x or "" for x in r) for r in readers.truth_tsv(spark, out).collect()} == {("S1-1", "S2-1,S2-2"), ("S1-2", "")}


def test_stream_matches_as_a_batch_does(spark, tmp_path):
    from quillon.streaming import linkage_stream

    x = linkage.Linkage(spark, SF)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    x.ent.where("entity_id like 'S1-%'").write.parquet(source)
    q = linkage_stream.start(spark.readStream.schema(x.ent.schema).parquet(source), x.pool, target, str(tmp_path / "cp"))
    q.awaitTermination()
    got = spark.read.parquet(target).select("s1_id", "cid")
    want = linkage_stream.match_batch(x.ent.where("entity_id like 'S1-%'"), x.pool, 0.5).select("s1_id", "cid")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not got.isEmpty()


def test_entry_imports_without_the_corpus_package(tmp_path):
    """A copy of the repository without the corpus folders."""
    import os
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    there = tmp_path / "copy"
    shutil.copytree(top, there, ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); assert 'm1_gbt_score' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=there, check=True, env=os.environ | {"PYTHONPATH": str(there)})


def test_sinks(spark, tmp_path):
    import zipfile

    one = lambda f: spark.createDataFrame([(f, 3)], "f05 double, n int")
    best, book = f"file://{tmp_path}/best", f"file://{tmp_path}/ledger"
    assert [sinks.keep_best(one(f), best, "f05") for f in (0.5, 0.4, 0.7)] == [True, False, True]
    assert spark.read.json(best).first().f05 == 0.7
    for f in (0.5, 0.7):
        sinks.append_ledger(one(f), book)
    assert sorted(r.f05 for r in readers.ledger(spark, book).collect()) == [0.5, 0.7]
    assert sinks.report_json(one(0.5)).first().report == '{"f05":0.5,"n":3}'
    rows = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(20)], "source1_entity_id string, matched_entity_ids string")
    sinks.write_tsv(rows.repartition(3), f"file://{tmp_path}/tsv")
    sinks.package(spark, {"matching.tsv": f"file://{tmp_path}/tsv"}, str(tmp_path / "out.zip"))
    lines = zipfile.ZipFile(tmp_path / "out.zip").read("matching.tsv").decode().splitlines()
    assert lines[0] == "source1_entity_id\tmatched_entity_ids" and len(lines) == 21
    assert [p.rsplit("/", 1)[1] for p in readers.found(spark, f"file://{tmp_path}", "*.zip")] == ["out.zip"]
    assert {r.entity_id for r in readers.ids_of(spark, f"file://{tmp_path}/tsv").collect()} == {f"S1-{i}" for i in range(20)}


def test_readers(spark, tmp_path):
    quoted = tmp_path / "q.tsv"
    quoted.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"A\tB"\tnan\tUS\nS1-2\tX\t\t\n')
    assert [tuple(r) for r in readers.records_tsv(spark, str(quoted), quoted=True).orderBy("entity_id").collect()] == [("S1-1", "A\tB", "", "US"), ("S1-2", "X", "", "")]
    table = tmp_path / "r.csv"
    table.write_text("id,name,addr,city,phone,type,class\n7,\"'arnie\\\\'s '\",\"1 main st\",`la`,x,y,0\n")
    got = readers.restaurants_csv(spark, str(table), "S1").first()
    assert (got.entity_id, got.business_address, got.country) == ("S1-7", "1 main st, la", "US")
    person = spark.createDataFrame([("rec-5-org", "ann", " ", "3", None, "b st", "town", None, "2000")], "rec_id string, given_name string, surname string, street_number string, address_1 string, address_2 string, suburb string, state string, postcode string")
    assert tuple(readers.person_records(person, "S1").first()) == ("S1-5", "ann", "3 b st, town, 2000", "AU")
    many = tmp_path / "lines"
    spark.range(50).selectExpr("concat('v', id) value").repartition(4).write.text(str(many))
    got = readers.lines_of(spark, str(many)).collect()
    assert sorted(r.line for r in got) == list(range(50)) and len({r.value for r in got}) == 50


def test_synthetic_sources(spark):
    from quillon.sources import fixture

    rows, pairs = fixture.noisy_sources(fixture.synthetic(spark, 1200))
    n = {r.s: r.n for r in rows.selectExpr("split_part(entity_id, '-', 1) s").groupBy("s").agg(F.count("*").alias("n")).collect()}
    e = {r.n_matches: r.n for r in fixture.synthetic(spark, 1200).groupBy("n_matches").agg(F.count("*").alias("n")).collect()}
    assert n == {"S1": 1200, "S2": e[1] + e[2] + 350, "S3": e[2] + 350}
    assert pairs.count() == e[1] + 2 * e[2] and pairs.join(rows.selectExpr("entity_id cid"), "cid", "left_anti").isEmpty()
    again = fixture.noisy_sources(fixture.synthetic(spark, 1200).repartition(7))[0]
    assert rows.exceptAll(again).isEmpty()
    base = rows.where("country = 'France'").limit(200)
    made = fixture.country_variants(base.select("entity_id", F.col("business_name"), F.lit("5 Rue Haute, Lyon").alias("business_address"))).collect()
    assert {r.nth for r in made} == {1, 2, 3} and {r.business_address for r in made} == {"5 R. Haute, Lyon", "5 R. Haute, Lyon, France"}
    assert sum(r.business_name.endswith(tuple(fixture.FORMS)) for r in made) / len(made) > 0.4


def test_places_over_several_ranges(spark):
    from quillon.sources.staging import numbered

    rows = spark.range(1000).selectExpr("cast(id * 7919 % 1000 as string) k").repartition(5)
    got = {r.k: r.at for r in numbered(rows, "at", "k").collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(got) and sorted(got.values()) == list(range(1000))


def test_frequent_keys_are_spread(spark):
    from quillon.operators import blocking

    left = spark.createDataFrame([(i, k) for i in range(5) for k in "ab"], "x int, k string")
    right = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(100)], "y int, k string")
    want = left.join(right, ["k"]).select("x", "y", "k")
    got = blocking.spread(left, right, ["k"], hot=40, salts=4).select("x", "y", "k")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_measures_without_any_claim_or_prediction(spark):
    """As the twins divide: 0 / 0 is NaN."""
    none = spark.createDataFrame([], "s1_id string, cid string, p double")
    truth = spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, cid string")
    assert repr(tuple(metrics.multi_claims(none, 0.5).first())) == "(0, 0, nan)"
    assert repr(tuple(metrics.pair_level(none, truth).first())) == "(0, 0, 1, nan, 0.0, nan)"
    assert repr(tuple(metrics.pair_level(truth.withColumn("cid", F.lit("S2-2")), truth).first())) == "(0, 1, 1, 0.0, 0.0, nan)"
    assert tuple(metrics.pair_level(truth, truth).first()) == (1, 0, 0, 1.0, 1.0, 1.0)


def test_twins_divide_as_the_measures(spark):
    values = [(0, 0), (3, 0), (-3, 0), (1, 4), (None, 0), (0, None)]
    got = [r[0] for r in spark.createDataFrame(values, "n long, of long").select(metrics.ratio(F.col("n"), F.col("of"))).collect()]
    want = [duckdb.sql(f"SELECT {'NULL' if n is None else n}::BIGINT / {'NULL' if d is None else d}::BIGINT").fetchall()[0][0] for n, d in values]
    assert repr(got) == repr(want)


def _records_with_keys(seed):
    """Ids, some there twice, with keys; a few records have many, one key is in most, and copies of key sets abound."""
    import random

    r = random.Random(seed)
    rows = lambda tag, n: [(f"{tag}-{r.randrange(n)}", k) for _ in range(n) for k in r.choice([["AT:a"], ["AT:a", "AT:b"], ["AT:a", "N:1", None], [f"AT:{c}" for c in r.sample("abcdefghij", r.randint(0, 9))], [f"N:{r.randrange(40)}"]])]
    return rows("S1", 120), rows("S2", 200)


@pytest.mark.parametrize("limits", [{}, {"most": 3, "chunk": 2, "cell": 7}, {"most": 12, "chunk": 5, "cell": 50}])
def test_pairs_are_shown_once_at_their_first_key(spark, limits):
    from quillon.operators import blocking

    rows = _records_with_keys(5)
    sets = [{i: {k for j, k in side if j == i and k} for i, _ in side} for side in rows]
    one, two = (spark.createDataFrame(side, "id string, key string") for side in rows)
    shared = {(a, b): x & y for a, x in sets[0].items() for b, y in sets[1].items()}
    got = [tuple(r) for r in blocking.linked(one, two, **limits).collect()]
    assert sorted(got) == sorted(p for p, k in shared.items() if k)
    got = [tuple(r) for r in blocking.linked(one, two, blocking._number_or_two_tokens, blocking._pair_keys, blocking._overlapping, **limits).collect()]
    want = sorted(p for p, k in shared.items() if any(x[0] == "N" for x in k) or sum(x[0] == "A" for x in k) >= 2)
    assert sorted(got) == want and want


@pytest.mark.parametrize("name", ["j10_address_overlap", "j3_simple_blocking", "j5_rule_blocking"])
def test_no_pairs_are_shuffled(spark, name):
    """Uncapped pairs are neither brought together nor grouped."""
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("RepartitionByExpression") == 2


def _dealt(spark, pairs):
    """Rows that go into the two shuffles of a plan of pairs."""
    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    of = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows
    counts = [of(spark._jsparkSession, n).count() for n in nodes(pairs._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "RepartitionByExpression"]
    assert len(counts) == 2
    return sum(counts)


def test_a_frequent_token_is_cut_on_both_sides(spark):
    """3,000 by 3,000 records, each a class of its own, share one token: nine cells of three by three, so each row goes to three."""
    from quillon.operators import blocking

    side = lambda tag: spark.createDataFrame([(f"{tag}-{i}", "US", [f"{tag}{i}", "x"], [], "") for i in range(3000)], "entity_id string, country string, sig_tokens array<string>, acronyms array<string>, norm_name string")
    pairs = blocking.block_simple(side("S1"), side("S2"))
    assert _dealt(spark, pairs) == 2 * 3 * 3000
    assert pairs.count() == 3000 * 3000


def test_a_frequent_suburb_is_cut_on_both_sides(spark, monkeypatch):
    """As the token; and where cells grow, a row still meets no more than a small cell's pairs at a time."""
    from quillon.operators import blocking

    side = lambda tag, n: spark.createDataFrame([(f"{tag}-{i}", f"{tag}{i}", "", "", "x") for i in range(n)], "entity_id string, sx1 string, sx2 string, prefix3 string, suburb string")
    assert _dealt(spark, blocking.block_rules(side("S1", 3000), side("S2", 3000))) == 2 * 3 * 3000
    monkeypatch.setattr(blocking, "TASKS", 1)
    keys = lambda tag, n: spark.createDataFrame([(f"{tag}-{i}", k) for i in range(n) for k in (f"{tag}{i}", "x")], "id string, key string")
    pairs = blocking.linked(keys("S1", 1), keys("S2", 300), cell=640)
    assert _dealt(spark, pairs) == 30 + 300
    assert pairs.count() == 300


def test_rules_against_plain_loops(spark):
    """Soundex, prefix and suburb of every pair of records, by plain loops."""
    x = linkage.Linkage(spark, SF)
    one, two = (readers.text_variant(x.ent.where(f"entity_id {y} 'S1-%'")).collect() for y in ("like", "not like"))
    alike = lambda a, b: any(a[c] and a[c] == b[c] for c in ("sx1", "sx2", "prefix3", "suburb"))
    got = [tuple(r) for r in catalogue.queries()["j5_rule_blocking"](spark, SF).collect()]
    assert sorted(got) == sorted((a.entity_id, b.entity_id) for a in one for b in two if alike(a, b))


def test_simple_blocking_and_address_overlap_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW part AS SELECT * FROM '/root/testdata/sf0.01/part.parquet'")
    for name in ("j3_simple_blocking", "j10_address_overlap"):
        want = sorted(con.execute(f"SELECT s1_id, cid FROM ({catalogue.ORACLES[name]})").fetchall())
        assert sorted(tuple(r) for r in catalogue.queries()[name](spark, "/root/testdata/sf0.01").collect()) == want
