"""Pairwise features of candidate pairs, cheap ones first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions.vocabulary import FEATURES
from . import tfidf


def pair_up(pairs: DataFrame, rec: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """pairs (s1_id, cid) with the derived records of both sides as structs a and b."""
    side = lambda d, key, name: d.select(F.col("entity_id").alias(key), F.struct(*[c for c in d.columns if c != "entity_id"]).alias(name))
    return pairs.join(side(rec, "s1_id", "a"), "s1_id").join(side(rec if pool is None else pool, "cid", "b"), "cid")


def _both(c: str) -> tuple[Column, Column]:
    return F.col(f"a.{c}"), F.col(f"b.{c}")


def agree(x: Column, y: Column) -> Column:
    """1 for equal, -1 for different, 0 where either is empty."""
    return F.when((x != "") & (y != ""), F.when(x == y, 1.0).otherwise(-1.0)).otherwise(0.0)


def cheap() -> dict[str, Column]:
    """Features from sets, equality and lengths."""
    num, pc, (n1, n2), (a1, a2) = _both("parsed.number"), _both("parsed.postcode"), _both("norm_name"), _both("norm_address")
    (s1, s2), (u1, u2) = _both("stripped_name"), _both("unit_keys")
    near = F.when(F.substring(pc[0], 1, 3) == F.substring(pc[1], 1, 3), 0.5).otherwise(-1.0)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "ntj": S.jaccard(*_both("sig_tokens")),
        "nc3": S.jaccard(*_both("c3_name")),
        "lex": flag((s1 == s2) & (s1 != "")),
        "acr": flag(F.arrays_overlap(*_both("acronyms"))),
        "nsm": agree(*num),
        "mnm": flag((num[0] == "") | (num[1] == "")),
        "pcm": F.when((pc[0] != "") & (pc[1] != ""), F.when(pc[0] == pc[1], 1.0).otherwise(near)).otherwise(0.0),
        "mpc": flag((pc[0] == "") | (pc[1] == "")),
        "ljc": S.jaccard(*_both("parsed.loc_tokens")),
        "ac3": S.jaccard(*_both("c3_addr")),
        "mad": flag((a1 == "") | (a2 == "")),
        "nld": F.abs(F.length(n1) - F.length(n2)) / F.greatest(F.length(n1), F.length(n2), F.lit(1)),
        "ukm": F.when((F.size(u1) > 0) & (F.size(u2) > 0), F.when(F.arrays_overlap(u1, u2), 1.0).otherwise(-1.0)).otherwise(0.0),
    }


def costly() -> dict[str, Column]:
    """Features that run the subsequence kernel."""
    n, st, na, ph, cb = _both("norm_name"), _both("parsed.street"), _both("norm_address"), _both("phonetic"), _both("compact_brand")
    joined = [F.array_join(x, " ") for x in ph]
    return {
        "nts": S.indel_ratio(S.token_sort(n[0]), S.token_sort(n[1])),
        "nlv": S.indel_ratio(*n),
        "slv": S.indel_ratio(*st, empty=0.0),
        "alv": S.indel_ratio(*na, empty=0.0),
        "phs": S.indel_ratio(S.token_sort(joined[0]), S.token_sort(joined[1]), empty=0.0),
        "cbs": S.indel_ratio(*cb, empty=0.0),
    }


def gate() -> Column:
    """Largest cheap sign that a pair may match; pairs below 0.3 needn't be scored."""
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    cb, pc = _both("compact_brand"), _both("parsed.postcode")
    code = F.when((pc[0] == "") | (pc[1] == ""), 0.0).when(pc[0] == pc[1], 1.0).when(F.substring(pc[0], 1, 3) == F.substring(pc[1], 1, 3), 0.5).otherwise(0.0)
    c = cheap()
    overlap = [flag(F.arrays_overlap(*_both(k))) for k in ("house_codes", "unit_keys", "acronyms", "addr_tokens")]
    return F.greatest(c["ac3"], c["nc3"], c["ntj"], flag((cb[0] == cb[1]) & (cb[0] != "")), code, *overlap)


#: Terms of a name, options of the fit, options of the vectors.
SPACES = {"word": (tfidf.word_terms, {"min_df": 2, "max_df": 0.95}, {}), "char": (tfidf.char_terms, {}, {"sublinear": True})}


def names_of(rec: DataFrame) -> DataFrame:
    return rec.select(F.col("stripped_name").alias("name")).distinct()


def fit_idf(rec: DataFrame, space: str) -> DataFrame:
    """Term weights of a space, from the names of these records."""
    terms, opts, _ = SPACES[space]
    return tfidf.fit(names_of(rec), terms(F.col("name")), **opts)


def weigh(rec: DataFrame, idf: dict[str, DataFrame]) -> DataFrame:
    """Records with their names' vectors under weights that were fitted before."""
    for space, (terms, _, opts) in SPACES.items():
        vecs = tfidf.packed(tfidf.vectors(names_of(rec), terms(F.col("name")), idf[space], **opts), space)
        rec = rec.join(vecs.withColumnRenamed("name", "_name"), F.col("stripped_name") == F.col("_name"), "left").drop("_name")
        rec = rec.withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in ((f"{space}_terms", "array<long>"), (f"{space}_weights", "array<double>"))})
    return rec


def cosines() -> dict[str, Column]:
    """Of the packed vectors of both names."""
    return {f: S.dot(*(F.col(f"{side}.{space}_{part}") for side in "ab" for part in ("terms", "weights"))) for f, space in (("twc", "word"), ("tcc", "char"))}


def features(paired: DataFrame, gate_at: float | None = None) -> DataFrame:
    """s1_id, cid and the model's 21 columns, of pairs of weighed records.  gate_at: pairs whose gate is below it are left out
    before the kernels run.  Narrow: every pair is looked at where it is."""
    if gate_at is not None:
        paired = paired.where(gate() >= gate_at)
    made = cheap() | costly() | cosines()
    return paired.select("s1_id", "cid", *[F.coalesce(made[f].cast("double"), F.lit(0.0)).alias(f) for f in FEATURES])


def linear_score(paired: DataFrame) -> DataFrame:
    """s1_id, cid, p: a fixed mixture of cheap features, for use without a model."""
    c = cheap()
    p = 0.4 * c["ntj"] + 0.3 * c["nc3"] + 0.15 * c["ac3"] + 0.15 * F.greatest(c["nsm"], F.lit(0.0))
    return paired.select("s1_id", "cid", F.round(p, 6).alias("p"))
