"""Normalisers and key extractors as Column functions.

Every set is a sorted array without duplicates.  Nulls are empty strings.  All but `transliterate` stay in the JVM.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def as_set(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fix_leetspeak(c) -> Column:
    """1 and 0 next to letters are l and o."""
    c = text(c)
    for digit, letter in (("1", "l"), ("0", "o")):
        c = F.regexp_replace(c, f"(?<=[a-zA-Z]){digit}(?=[a-zA-Z])|(?<=[a-zA-Z]){digit}\\b|\\b{digit}(?=[a-zA-Z])", letter)
    return c


def _plain_letters() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose into one letter and marks, and those letters."""
    pairs = [(chr(i), d[0]) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(d := "".join(x for x in unicodedata.normalize("NFD", chr(i)) if unicodedata.category(x) != "Mn")) == 1 and d != chr(i)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _plain_letters()


def strip_accents(c) -> Column:
    """Latin letters lose their marks, and marks of their own go."""
    return F.regexp_replace(F.translate(text(c), ACCENTED, PLAIN), r"\p{Mn}", "")


#: Offsets in the Unicode blocks of the Brahmic scripts, which share one layout.
_CONSONANTS = dict(zip(range(0x15, 0x3A), "k kh g gh ng ch chh j jh ny t th d dh n t th d dh n n p ph b bh m y r r l l zh v sh sh s h".split()))
_VOWELS = dict(zip(range(0x05, 0x15), "a a i i u u ri li e e e ai o o o au".split()))
_SIGNS = dict(zip(range(0x3E, 0x4D), "a i i u u ri ri e e e ai o o o au".split()))


def transliterate_text(s: str) -> str:
    """Brahmic scripts to Latin by the layout that their blocks share; other letters lose their marks; the rest stays."""
    out, inherent = [], False
    for ch in s:
        at = ord(ch) - 0x900
        if not 0 <= at < 0x480:
            out += ["a"] * (inherent and ch.isalpha()) + [ch]
            inherent = False
            continue
        at %= 0x80
        if at in _CONSONANTS:
            out += ["a"] * inherent + [_CONSONANTS[at]]
            inherent = True
            continue
        if at in _SIGNS or at == 0x4D:
            out.append(_SIGNS.get(at, ""))
        else:
            out += ["a"] * inherent + [_VOWELS.get(at) or ("n" if at in (1, 2) else "h" if at == 3 else str(at - 0x66) if 0x66 <= at <= 0x6F else "")]
        inherent = False
    return "".join(x for x in unicodedata.normalize("NFD", "".join(out)) if unicodedata.category(x) != "Mn")


def transliterate(c) -> Column:
    """ASCII form of a string.  Plain ASCII never reaches Python: the Arrow UDF sees null there and returns it."""
    @F.pandas_udf("string")
    def other(s: pd.Series) -> pd.Series:
        return s.map(transliterate_text, na_action="ignore")

    c = text(c)
    return F.coalesce(other(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def has_indic(c) -> Column:
    return text(c).rlike(r"[ऀ-ൿ]")


def collapse_initials(c: Column) -> Column:
    """`n.v. x` -> `nvx`: what follows a dotted initial is drawn together up to the next non-letter."""
    found = F.regexp_extract_all(c, F.lit(r"\b([a-z])\.(?:\s*([a-z])\.?)+"), F.lit(0))
    return F.aggregate(found, c, lambda s, m: F.replace(s, m, F.translate(m, ". ", "")))


def mapped(c: Column, table: dict[str, str]) -> Column:
    """Whole words replaced, one entry after the other."""
    for word, to in table.items():
        c = F.regexp_replace(c, rf"\b{word}\b", to)
    return c


def normalise(c, address: bool = False, leet: bool = True) -> Column:
    c = fix_leetspeak(c) if leet else text(c)
    c = collapse_initials(strip_accents(F.trim(F.lower(c))))
    c = F.regexp_replace(c, r"[^\w\s]", " ")
    return squeeze(mapped(c, V.ADDRESS_MAP if address else dict.fromkeys(V.LEGAL_FORMS, "corp")))


def sig_tokens(norm_name: Column) -> Column:
    return as_set(F.filter(words_of(norm_name), lambda t: (F.length(t) >= 3) & ~t.isin(V.STOPWORDS)))


def strip_legal(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(c), rf"\b({V.LEGAL_WORDS})\b", ""))


def acronyms(norm_name: Column) -> Column:
    own = F.filter(words_of(strip_legal(norm_name)), lambda t: ~t.isin(V.STOPWORDS) & t.rlike("^[a-z]+$"))
    initials = F.array_join(F.transform(own, lambda t: F.substring(t, 1, 1)), "")
    many = (F.size(own) >= 2) & F.length(initials).between(2, 6)
    one = (F.size(own) == 1) & F.length(F.get(own, F.lit(0))).between(2, 5)
    return F.when(many, F.array(initials)).when(one, own).otherwise(F.array().cast("array<string>"))


def skeleton(w: Column) -> Column:
    """Phonetic skeleton of a word."""
    w = F.regexp_replace(F.lower(w), "[^a-z0-9]", "")
    s = w
    for a, b in (("sh", "s"), ("ph", "f"), ("ch", "k")):
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.replace(F.regexp_replace(s, "c(?=[eiy])", "s"), F.lit("c"), F.lit("k"))
    for a, b in (("q", "k"), ("x", "ks"), ("z", "s"), ("v", "w"), ("b", "w")):
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(F.regexp_replace(s, "m(?=[tdks])", "n"), r"(.)\1+", "$1")
    s = F.concat(F.substring(s, 1, 1), F.regexp_replace(F.substring(s, 2, 1 << 30), "[aeiouy]", ""))
    return F.when(F.length(w) <= 2, w).otherwise(s)


def compact_brand(c: Column) -> Column:
    c = F.regexp_replace(F.lower(c), rf"\b({V.HONORIFICS})\b", " ")
    c = F.regexp_replace(F.regexp_replace(c, rf"\b({V.BRAND_ENDINGS})\b", " "), "[^a-z0-9]", "")
    c = F.regexp_replace(c, f"^({V.BRAND_PREFIX})", "")
    return F.when(F.length(c) >= 5, c).otherwise("")


def unit_keys(address) -> Column:
    a, pattern = F.lower(text(address)), F.lit(rf"\b({V.UNIT_WORDS})\s*[:#-]?\s*(\d+[a-z]?)")
    number = lambda v: F.regexp_replace(v, "^0+", "")
    return as_set(F.zip_with(F.regexp_extract_all(a, pattern, F.lit(1)), F.regexp_extract_all(a, pattern, F.lit(2)), lambda k, v: F.concat(k, F.lit("_"), number(v))))


def distinctive_tokens(norm_address: Column) -> Column:
    return as_set(F.filter(words_of(norm_address), lambda t: t.rlike("^[a-z]{6,}$") & ~t.isin(V.ADDRESS_STOPWORDS)))


def address_numbers(address) -> Column:
    found = F.filter(F.regexp_extract_all(text(address), F.lit(r"(\d+)")), lambda n: F.length(n).between(2, 6))
    bare = F.filter(F.transform(found, lambda n: F.regexp_replace(n, "^0+", "")), lambda n: F.length(n) >= 2)
    return as_set(F.concat(found, bare))


def house_codes(address) -> Column:
    return as_set(F.regexp_extract_all(F.lower(text(address)), F.lit(r"\b[a-zA-Z]-?\d{1,4}\b"), F.lit(0)))


def char_grams(c: Column, n: int = 3) -> Column:
    at = F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return as_set(F.transform(at, lambda i: F.substr(c, i, F.lit(n))))


def prefix_key(norm_name: Column) -> Column:
    return F.when(F.length(norm_name) >= 3, F.substring(norm_name, 1, 3)).otherwise("")


def let(value: Column, then) -> Column:
    """then(value), the value being worked out once however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), F.lit(0))


def _parts(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")


def _cut(c: Column, found: Column, pattern: str) -> Column:
    """c without its first match."""
    at = F.regexp_instr(c, F.lit(pattern))
    return F.concat(F.substr(c, F.lit(1), at - 1), F.substr(c, at + F.length(found), F.length(c) + 1))


WORDED = rf"(?i)\b(?:{V.NUMBER_WORDS})\s*[:#-]?\s*(\d+[0-9a-zA-Z\-/]*)"
LEADING = rf"(?i)^(\d+\s*(?:{V.NUMBER_TAIL})?)\b(?!\s*(?:{V.STREET_WORDS})\b)"
DIGITS = r"^(\d+)\b"
TRAILING = rf"(?i)\b(\d+\s*(?:{V.NUMBER_TAIL})?)\s*$"


def _number_and_rest(rest: Column) -> Column:
    """struct(number, left): the house number by the first rule that finds one, and the address without it."""

    def after(pattern: str, edges: bool = True) -> Column:
        left = _cut(rest, F.regexp_extract(rest, pattern, 0), pattern)
        return F.struct(F.trim(F.lower(F.regexp_extract(rest, pattern, 1))).alias("number"), (F.regexp_replace(left, "^[, ]+|[, ]+$", "") if edges else left).alias("left"))

    def at_end(parts: Column) -> Column:
        first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
        left = F.array_join(F.concat(F.array(F.trim(_cut(first, F.regexp_extract(first, TRAILING, 0), TRAILING))), F.slice(parts, 2, 1 << 30)), ", ")
        return F.when(first.rlike(TRAILING), F.struct(F.trim(F.lower(F.regexp_extract(first, TRAILING, 1))).alias("number"), left.alias("left"))).otherwise(F.struct(F.lit("").alias("number"), rest.alias("left")))

    return F.when(rest.rlike(WORDED), after(WORDED, edges=False)).when(rest.rlike(LEADING), after(LEADING)).when(rest.rlike(DIGITS), after(DIGITS)).otherwise(let(_parts(rest), at_end))


def parse_address(address) -> Column:
    """struct(number, postcode, street, locality, loc_tokens)."""
    a = F.trim(text(address))
    postcode = F.regexp_extract(a, r"\b\d{5,6}\b", 0)

    def fields(n: Column, p: Column) -> Column:
        several = F.size(p) > 1
        locality = F.when(several, F.lower(F.element_at(p, -1))).otherwise("")
        street = F.lower(F.when(several, F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), ", ")).otherwise(F.coalesce(F.get(p, F.lit(0)), F.lit(""))))
        tokens = as_set(F.filter(words_of(F.regexp_replace(locality, r"[^\w\s]", " ")), lambda t: (F.length(t) >= 3) & ~t.isin(V.STOPWORDS)))
        return F.struct(n["number"].alias("number"), postcode.alias("postcode"), street.alias("street"), locality.alias("locality"), tokens.alias("loc_tokens"))

    rest = F.trim(F.regexp_replace(a, r"\b\d{5,6}\b", ""))
    return let(let(rest, _number_and_rest), lambda n: let(_parts(n["left"]), lambda p: fields(n, p)))
