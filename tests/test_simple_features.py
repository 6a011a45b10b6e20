"""The small feature set against plain Python, on all candidate pairs and on odd records."""

import re
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillon.operators import simple
from quillon.plans import catalogue

SF = "/root/testdata/sf0.001"
SMALL = {"and", "the", "for", "ltd", "pvt", "inc", "corp", "llc"}


def plain_clean(text):
    text = "".join(c for c in unicodedata.normalize("NFD", (text or "").strip().lower()) if unicodedata.category(c) != "Mn")
    out, at = "", 0
    for m in re.finditer(r"\b[a-z]\.(?:\s*[a-z]\.?)+", text):
        out += text[at : m.start()] + m[0].replace(".", "").replace(" ", "")
        at = m.end()
    return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in out + text[at:]).split())


def plain_tokens(cleaned):
    return {w for w in cleaned.split() if len(w) > 2} - SMALL


def plain(name, address):
    n, a = plain_clean(name), plain_clean(address)
    number = re.search(r"\b\d{1,6}([a-zA-Z]|bis|ter)?\b", address or "")
    code = re.search(r"\b\d{5,6}\b", address or "")
    return {
        "clean_name": n,
        "clean_address": a,
        "name_tokens": plain_tokens(n),
        "address_tokens": plain_tokens(a),
        "initials": "".join(w[0] for w in n.split() if len(w) > 1)[:5],
        "number": number[0].lower() if number else "",
        "code": code[0] if code else "",
    }


ODD = [
    ("A.B.C. Traders Pvt Ltd", "12bis Rue de la Paix, 75002 Paris"),
    ("J. Smith and Co", "Plot 4a, 560 001"),
    ("Café  Crème\tS.A.R.L.", "no number here"),
    ("x. 9 y.z", "1234567 then 123456"),
    ("", None),
    (None, "  "),
    ("of a.b", "7TER road 5"),
    ("a_b & c-d", "9, 9"),
    ("U.S. Steel 5.a.b..c", "00123 12ter 3x"),
]


def test_simple_fields(spark):
    rows = spark.createDataFrame([(str(i), *r) for i, r in enumerate(ODD)], "entity_id string, business_name string, business_address string")
    got = {r.entity_id: r for r in simple.derive(rows).collect()}
    for i, r in enumerate(ODD):
        want = plain(*r)
        mine = {c: set(got[str(i)][c]) if c.endswith("tokens") else got[str(i)][c] for c in simple.COLUMNS}
        assert mine == want, r
    numbers = spark.createDataFrame([("12 345 6789 1234567 345",), (None,)], "t string").select(simple.long_numbers("t").alias("n")).collect()
    assert [r.n for r in numbers] == [["345", "6789"], []]


def test_eleven_features(spark):
    fields = {r.entity_id: plain(r.business_name, r.business_address) for r in catalogue.queries()["sc1_record_scan"](spark, SF).collect()}
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio() if x and y else 0.0
    share = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    sign = lambda x, y: 0.0 if not (x and y) else 1.0 if x == y else -1.0
    rows = catalogue.queries()["x22_eleven_features"](spark, SF).collect()
    assert len(rows) == catalogue.queries()["j2_candidates"](spark, SF).count() > 0
    for r in rows:
        a, b = fields[r.s1_id], fields[r.cid]
        n, m, i, j = a["clean_name"], b["clean_name"], a["initials"], b["initials"]
        want = [
            share(a["name_tokens"], b["name_tokens"]),
            ratio(n, m),
            float(len(i) >= 2 and (i in (m, j) or j == n)),
            share(a["address_tokens"], b["address_tokens"]),
            ratio(a["clean_address"], b["clean_address"]),
            sign(a["number"], b["number"]),
            float(not (a["number"] and b["number"])),
            sign(a["code"], b["code"]),
            float(not (a["code"] and b["code"])),
            float(not (a["clean_address"] and b["clean_address"])),
            abs(len(n) - len(m)) / max(len(n), len(m), 1),
        ]
        assert list(r)[2:] == pytest.approx(want, abs=1e-6), (r, a, b)


ADDRESSES = {
    "Rue de la Paix 188, Bordeaux": {"leading": ("", "", "rue de la paix 188", "bordeaux"), "keyword": ("188", "", "rue de la paix 188", "bordeaux"), "robust": ("188", "", "rue de la paix", "bordeaux")},
    "R. de la Paix 188": {"leading": ("", "", "r. de la paix 188", ""), "keyword": ("", "", "r. de la paix 188", ""), "robust": ("188", "", "r. de la paix", "")},
    "105 Main St, Springfield 12345": {s: ("105", "12345", "main st", "springfield") for s in ("leading", "keyword", "robust")},
    "14 BIS rue X, 75002 Paris": {s: ("14 bis", "75002", "rue x", "paris") for s in ("leading", "keyword", "robust")},
    "Plot No. 7a, Sector 9, Delhi, 110001": {"leading": ("", "110001", "plot no. 7a, sector 9", "delhi"), "keyword": ("7a", "110001", "plot, sector 9", "delhi"), "robust": ("7a", "110001", "plot, sector 9", "delhi")},
    " 560001 ": {s: ("", "560001", "", "") for s in ("leading", "keyword", "robust")},
    "Old Road 5, Plot 6, Town": {"leading": ("", "", "old road 5, plot 6", "town"), "keyword": ("6", "", "old road 5", "town"), "robust": ("6", "", "old road 5", "town")},
    "5, 6, 7": {s: ("5", "", "6", "7") for s in ("leading", "keyword", "robust")},
    "": {s: ("", "", "", "") for s in ("leading", "keyword", "robust")},
    None: {s: ("", "", "", "") for s in ("leading", "keyword", "robust")},
}


@pytest.mark.parametrize("style", ["leading", "keyword", "robust"])
def test_address_parsers(spark, style):
    rows = spark.createDataFrame([(a,) for a in ADDRESSES], "a string").select("a", simple.parse_address("a", style).alias("p")).collect()
    assert {r.a: tuple(r.p) for r in rows} == {a: want[style] for a, want in ADDRESSES.items()}


def test_simple_fields_of_nothing(spark):
    assert simple.derive(spark.createDataFrame([], "entity_id string, business_name string, business_address string")).where(F.lit(True)).count() == 0
