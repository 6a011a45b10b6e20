"""Pairwise similarity as Column functions; the longest-common-subsequence kernel is an Arrow UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def code_points(strings: list[str], fill: int, width: int = 1) -> np.ndarray:
    """Strings as rows of code points, padded with fill to a multiple of width."""
    n = np.fromiter(map(len, strings), np.int64, len(strings))
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.int32)
    out = np.full((len(strings), max(1, -(-int(n.max(initial=0)) // width)) * width), fill, np.int32)
    out[np.repeat(np.arange(len(strings)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def lcs_lengths(a: list[str], b: list[str], chunk: int = 2048) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs, many pairs at a time: bit-parallel rows, each word of a row for
    64 characters of the shorter string.  Pairs of about the same length go together."""
    pairs = [(x, y) if len(x) >= len(y) else (y, x) for x, y in zip(a, b)]
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]) // 64, len(pairs[i][0])))
    out = np.zeros(len(pairs), np.int64)
    for at in range(0, len(order), chunk):
        own = order[at : at + chunk]
        long, short = code_points([pairs[i][0] for i in own], -1), code_points([pairs[i][1] for i in own], -2, 64)
        row = np.full((len(own), short.shape[1] // 64), ~np.uint64(0))
        with np.errstate(over="ignore"):
            for ch in long.T:
                hit = np.packbits(short == ch[:, None], axis=1, bitorder="little").view(np.uint64) & row
                total = row + hit
                for w in range(1, row.shape[1]):  # what a word carries over to the next
                    carry = total[:, w - 1] < row[:, w - 1] if w == 1 else (total[:, w - 1] < row[:, w - 1]) | carry & (total[:, w - 1] == row[:, w - 1])
                    total[:, w] += carry
                row = total | row & ~hit
        out[own] = short.shape[1] - np.bitwise_count(row).sum(1)
    return out


def indel_ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """2 * LCS / (len a + len b); 1 for two empty strings.  empty: the value where either is empty, if that is to differ."""
    @F.pandas_udf("long")
    def lcs(x: pd.Series, y: pd.Series) -> pd.Series:
        some = (x.notna() & y.notna()).to_numpy()
        out = pd.array(np.zeros(len(x), np.int64), "Int64")
        out[some] = lcs_lengths(x[some].tolist(), y[some].tolist())
        out[~some] = pd.NA
        return pd.Series(out)

    # Equal and empty strings need no kernel.
    odd = (a != b) & (a != "") & (b != "")
    ratio = 2.0 * lcs(F.when(odd, a), F.when(odd, b)) / (F.length(a) + F.length(b))
    ratio = F.when(odd, ratio).when(a == b, 1.0).otherwise(0.0)
    return ratio if empty is None else F.when((a == "") | (b == ""), empty).otherwise(ratio)


def indel_ratio_native(a: Column, b: Column) -> Column:
    """The same without Python: rows as the bits of a number where the shorter string has at most 62 characters, else as
    arrays, each the running maximum of matches one further."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    swap = F.length(a) < F.length(b)
    long, short = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    other, n, zero = chars(short), F.length(short), F.lit(0).cast("long")
    bit = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), j)
    every = bit(n) - 1

    def bits(row: Column, ch: Column) -> Column:
        places = F.transform(other, lambda y, j: F.when(y == ch, bit(j)).otherwise(zero))
        hit = row.bitwiseAND(F.aggregate(places, zero, lambda s, x: s.bitwiseOR(x)))
        return (row + hit).bitwiseOR(row - hit).bitwiseAND(every)

    def row(prev: Column, ch: Column) -> Column:
        cand = F.transform(other, lambda y, j: F.when(y == ch, F.coalesce(F.get(prev, j - 1), F.lit(0)) + 1).otherwise(F.get(prev, j)))
        return F.transform(cand, lambda _, j: F.array_max(F.slice(cand, F.lit(1), j + 1)))

    few = n - F.bit_count(F.aggregate(chars(long), every, bits))
    many = F.coalesce(F.array_max(F.aggregate(chars(long), F.transform(other, lambda _: F.lit(0)), row)), F.lit(0))
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 1.0).when(n <= 62, 2.0 * few / both).otherwise(2.0 * many / both)


def dot(terms_1: Column, weights_1: Column, terms_2: Column, weights_2: Column) -> Column:
    """Sum of the products of the weights of shared terms; terms of a side are distinct numbers."""
    @F.pandas_udf("double")
    def product(t1: pd.Series, w1: pd.Series, t2: pd.Series, w2: pd.Series) -> pd.Series:
        n = len(t1)
        if not n:
            return pd.Series([], dtype="float64")
        flat = lambda *cs: np.concatenate([np.concatenate(c.to_list()) if n else [] for c in cs])
        pair = np.concatenate([np.repeat(np.arange(n), t.map(len).to_numpy()) for t in (t1, t2)])
        term, weight = flat(t1, t2), flat(w1, w2)
        order = np.lexsort((term, pair))
        pair, term, weight = pair[order], term[order], weight[order]
        same = np.flatnonzero((pair[1:] == pair[:-1]) & (term[1:] == term[:-1]))
        return pd.Series(np.bincount(pair[same], weights=weight[same] * weight[same + 1], minlength=n))

    return product(terms_1, weights_1, terms_2, weights_2)


def token_sort(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda w: w != "")), " ")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratio of matching blocks (Ratcliff and Obershelp); 1 for two empty strings."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)])

    return ratio(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def jaro_winkler_value(a: str, b: str, weight: float = 0.1) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                left.append(ch)
                break
    m = len(left)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(left, (ch for ch, u in zip(b, used) if u))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + same * weight * (1 - jaro) if jaro > 0.7 else jaro


def jaro_winkler(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def value(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaro_winkler_value(p, q) for p, q in zip(x, y)])

    return value(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
