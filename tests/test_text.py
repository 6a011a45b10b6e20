"""Golden rows of the normalisers."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import similarity as S
from quillon.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(("given", "wanted"), [("de1hi", "delhi"), ("pear1", "pearl"), ("f00d", "f00d"), ("c0de", "code"), (None, "")])
def test_leetspeak(spark, given, wanted):
    assert one(spark, given, T.fix_leetspeak) == wanted


@pytest.mark.parametrize(("a", "b"), [("Siemens AG", "Siemens"), ("Carrefour SA", "Carrefour"), ("L'Oréal SAS", "L'Oreal"), ("Ferrari N.V.", "Ferrari NV")])
def test_legal_forms(spark, a, b):
    f = lambda c: T.strip_legal(T.normalise(c))
    g = lambda c: F.trim(F.regexp_replace(f(c), r"\bcorp\b", ""))
    assert one(spark, a, g) == one(spark, b, g)


def test_acronyms(spark):
    f = lambda c: T.acronyms(T.normalise(c))
    assert one(spark, "TCS", f) == one(spark, "Tata Consultancy Services Ltd", f) == ["tcs"]
    assert one(spark, "", f) == []


def test_dotted_initials_run_on(spark):
    assert one(spark, "r. de la paix 14", T.collapse_initials) == "rdelapaix 14"


def test_skeleton(spark):
    assert one(spark, "finance", T.skeleton) == "fnns"
    assert one(spark, "at", T.skeleton) == "at"


@pytest.mark.parametrize(
    ("address", "number", "street", "locality"),
    [
        ("Rue de la Paix 188, Bordeaux", "188", "rue de la paix", "bordeaux"),
        ("R. de la Paix 188", "188", "r. de la paix", ""),
        ("Plot No. 14, MG Road, SMALL", "14", "plot, mg road", "small"),
        ("12 bis rue Foch, Lyon", "12", "bis rue foch", "lyon"),
        ("14 Main St, X", "14", "main st", "x"),
        (None, "", "", ""),
        ("", "", "", ""),
    ],
)
def test_addresses(spark, address, number, street, locality):
    r = one(spark, address, T.parse_address)
    assert (r.number, r.street, r.locality) == (number, street, locality)


def test_address_keys(spark):
    assert one(spark, "Shop No 4, Plot: 007b, Road 12", T.unit_keys) == ["plot_7b", "road_12"]
    assert one(spark, "12, 0045 x 1234567", T.address_numbers) == ["0045", "12", "45"]
    assert one(spark, "B-12 and C4", T.house_codes) == ["b-12", "c4"]
    assert one(spark, "ab", T.char_grams) == []


def test_transliteration(spark):
    assert one(spark, "दिल्ली", T.transliterate) == "dillii".replace("ii", "i")
    assert one(spark, "Café 12", T.transliterate) == "Cafe 12"
    assert one(spark, "plain", T.transliterate) == "plain"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_subsequence_kernel_against_the_table():
    import random

    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abcd ") for _ in range(r.randint(0, 30))) for _ in range(2))
        assert S.lcs_lengths([a], [b]).tolist() == [lcs(a, b)]


def test_indel_native_is_the_kernel(spark):
    rows = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("a", ""), ("brand 7", "brnad 7")], "a string, b string")
    for r in rows.select(S.indel_ratio(F.col("a"), F.col("b")).alias("x"), S.indel_ratio_native(F.col("a"), F.col("b")).alias("y")).collect():
        assert r.x == pytest.approx(r.y)
