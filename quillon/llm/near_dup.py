"""Near-duplicate documents by an exact Jaccard join of word-shingle sets on parity sketches.

Bands.  Band g holds the sizes from 4^g on, below 4^(g+1).  Group g joins the sets of band g (its own) with each other and
with its visitors, sets of the band below that are large enough to be similar to one of them.  Two similar sets so meet
in a group that one of them owns.  In group g a set is sketched by XOR: hashes of shingles are dealt into blocks and XORed
together, and an element more or less changes one block, so at most D blocks of a similar pair differ: D = (a + b) / 7.

Pigeonhole.  A set shows only its first D + 1 non-empty blocks in one fixed order, with the largest D that it can have with
any set of the group (a third of its size; it shows nothing where that is 0).  Two similar sets agree on all but D of their
non-empty blocks, so one that both show is equal (a set with D blocks or fewer shows all it has; should two such sets meet,
they share a block of their own).  The order puts blocks last whose shingles are all frequent: passages
that many documents share are then shown only by documents made of little else.  Which shingles count as frequent touches
the cost alone, never the result.

Shown blocks travel as packed arrays, dealt by hash, in one pass; only those that two different sets show leave their
bucket, as groups of sets.  Widespread ones may be shown by any number of sets; they are dealt by block and set, and their
groups go through aggregations and joins of written tables, which adaptive execution can split.

Verification.  First each group's leader is compared with its members: parity sketches rule pairs out whose Hamming
distance is above 1/7 of their sizes, and whole sets, made again from the documents concerned, decide the rest.  Links make
components.  Components that groups hold together make families (a family of more than FAMILY sets stays in its groups).
A family's sets travel once, with their sketches, and are compared in tiles; a tile gives a forest, at most one row a set, of pairs that sketches do not rule out.  Trees that hold several components are
compared in the same way with whole sets, and these tiles give a forest of links.  A pair inside a component is never
looked at, so a large family of near copies never becomes all its pairs.  Equal sets are one set from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, arrow_rows, forget, fresh, give_back, lean, read, written
from .shingles import fold, mix, parity, portions, set_id, shingle_sets

#: Share of the documents from which a shingle is widespread; times that one must be seen in a stretch, and in all, to be
#: frequent; frequent shingles that are sent to executors.
SPREAD, LOCAL, OFTEN, MOST_OFTEN = 1 / 2000, 3, 8, 1 << 20
#: Sets of a family that is compared as one, sets and bytes of a tile's side, bytes of tiles that one call looks at.
FAMILY, TILE, TILE_BYTES, BUNDLE_BYTES = 1 << 15, 4096, 24 << 20, 8 << 20
BROADCAST_IDS = 500_000
#: Edges that a task turns into stars at a time.
EDGES = 1 << 18


def band(n: int) -> int:
    return (n.bit_length() - 1) // 2


def homes(n: int) -> list[int]:
    """The groups of a set: its own, and the next where it is large enough to be similar to a set there."""
    own = band(n)
    return [own, own + 1] if 4 * n // 3 >= 4 ** (own + 1) else [own]


def difference(n: int, g: int) -> int:
    """Largest symmetric difference of a set of n shingles to a similar one in group g: (a + b) / 7 for similarity 3/4."""
    return (n + min(4 * n // 3, 4 ** (g + 1) - 1)) // 7


def blocks(g: int) -> int:
    return max(2 * 4 ** (g + 1), 4096)


def shown(hashes: np.ndarray, often: np.ndarray, wide: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """(keys, are they widespread, is the set a visitor) for the groups of the set.
    often: sorted hashes of frequent shingles, and which of them are widespread."""
    out = []
    rank = np.zeros(len(hashes), np.int8)  # 0 rare, 1 frequent, 2 widespread
    if len(often):
        at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
        rank = np.where(often[at] == hashes, 1 + wide[at], 0).astype(np.int8)
    for g in homes(len(hashes)):
        most = difference(len(hashes), g) + 1
        if most == 1:  # only equal sets are similar
            continue
        salt = mix(np.array([g + 1], np.uint64))
        place = mix(hashes + salt) % np.uint64(blocks(g))
        order = np.argsort(place, kind="stable")
        place, h = place[order], hashes[order]
        start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        xor = np.bitwise_xor.reduceat(h, start)
        least = np.minimum.reduceat(rank[order], start)
        full = xor != 0
        key = mix(mix(xor ^ place[start]) + salt)[full]
        least = least[full]
        if len(key) > most:
            first = np.lexsort((key, least))[:most]
            key, least = key[first], least[first]
        elif len(key) < most:  # too few blocks for the guarantee: such sets of a group all share one more key
            key, least = np.append(key, mix(salt)), np.append(least, 0)
        out.append((key, least == 2, g > band(len(hashes))))
    return out


def texts_of(batch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def sketch_of(hashes: np.ndarray) -> bytes:
    """Parity sketch of one to two bits an element, 256 at least: of sets with similarity below 0.65 nearly all lie too far
    apart."""
    return parity(hashes, max(256, 1 << (len(hashes) - 1).bit_length())).tobytes() if len(hashes) else b""


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash (of the text), n_shingles, set_id, sketch of each row; and rows without them whose `often` holds shingles (and how many sets of a
    stretch of the task have them) that are frequent there."""

    def often(sets: dict[int, np.ndarray]) -> bytes:
        if not sets:
            return b""
        h, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
        keep = n >= LOCAL
        return np.stack([h[keep], n[keep].astype(np.uint64)]).tobytes()

    def row(ids, own, n, sid, sketch, freq):
        return pa.RecordBatch.from_arrays([ids, own, pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(sketch, pa.binary()), pa.array(freq, pa.binary())], names=["doc_id", "row_hash", "n_shingles", "set_id", "sketch", "often"])

    def end(held):
        none = pa.nulls(1, pa.int64())
        return row(none, none, [None], [None], [None], [often(held)])

    def task(batches):
        held: dict[int, np.ndarray] = {}
        size = 0
        for b in batches:
            n, sid, sketch = [], [], []
            for some in portions(texts_of(b)):
                for s in shingle_sets(some):
                    n.append(len(s))
                    sid.append(i := set_id(s))
                    sketch.append(sketch_of(s))
                    if len(s) and i not in held:
                        held[i] = s
                        size += len(s)
                if size > 3_000_000:
                    yield end(held)
                    held, size = {}, 0
            yield row(b.column("doc_id"), b.column("row_hash"), n, sid, sketch, [None] * len(n))
        yield end(held)

    rows = docs.select(F.col("doc_id").cast("long"), text_hash().alias("row_hash"), "text")
    return rows.mapInArrow(lean(task), "doc_id long, row_hash long, n_shingles long, set_id long, sketch binary, often binary")


def text_hash():
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def frequent(described: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of frequent shingles, as far as stretches of tasks saw them, at most MOST_OFTEN (the most frequent);
    and which of them at least SPREAD of the documents have."""

    def task(batches):
        for b in batches:
            for raw in b.column("often").to_pylist():
                h, n = np.frombuffer(raw, np.uint64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.view(np.int64))], names=["h", "n"])

    rows = described.where("often is not null and length(often) > 0").select("often").mapInArrow(task, "h long, n long")
    rows = rows.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(MOST_OFTEN).toArrow()
    h, n = rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order] >= max(OFTEN, n_docs * SPREAD)


def show(docs: DataFrame, often: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """Shown blocks, packed: bucket, wide (are they widespread), keys (48 bits each), owners (places in ids; top bit:
    visitor), ids.  Widespread blocks are dealt by block and set, others by block."""
    known = docs.sparkSession.sparkContext.broadcast(often)  # at most MOST_OFTEN hashes

    def pack(keys, owners, wide, ids):
        keys, owners, wide = np.concatenate(keys), np.concatenate(owners), np.concatenate(wide)
        ids, rows = np.array(ids, np.int64), []
        bucket = (np.where(wide, mix(keys ^ ids[owners & np.uint16(0x7FFF)].view(np.uint64)), keys) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(2 * bucket + wide, kind="stable")
        bucket, wide, keys, owners = bucket[order], wide[order], keys[order], owners[order]
        at = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (wide[1:] != wide[:-1])]))
        for a, b in zip(at, [*at[1:], len(keys)]):
            used, local = np.unique(owners[a:b] & np.uint16(0x7FFF), return_inverse=True)
            local = local.astype(np.uint16) | (owners[a:b] & np.uint16(0x8000))
            low, high = keys[a:b].astype(np.uint32), (keys[a:b] >> np.uint64(32)).astype(np.uint16)
            rows.append((int(bucket[a]), bool(wide[a]), low.tobytes() + high.tobytes(), local.tobytes(), ids[used].tobytes()))
        types = (pa.int32(), pa.bool_(), *[pa.binary()] * 3)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["bucket", "wide", "keys", "owners", "ids"])

    def task(batches):
        seen: set[int] = set()
        keys, owners, wide, ids, held = [], [], [], [], 0
        for b in batches:
            for some in portions(texts_of(b)):
                for s in shingle_sets(some):
                    i = set_id(s)
                    if not len(s) or i in seen:
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(i)
                    for k, w, visitor in shown(s, *known.value):
                        keys.append(k)
                        owners.append(np.full(len(k), len(ids) | (0x8000 if visitor else 0), np.uint16))
                        wide.append(w)
                        held += len(k)
                    ids.append(i)
                    if held > 1_000_000 or len(ids) == 0x7FFF:
                        yield pack(keys, owners, wide, ids)
                        keys, owners, wide, ids, held = [], [], [], [], 0
        if held:
            yield pack(keys, owners, wide, ids)

    return docs.select("text").mapInArrow(lean(task), "bucket int, wide boolean, keys binary, owners binary, ids binary")


def unpack(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """keys, set ids, visitor"""
    owner = np.frombuffer(r["owners"], np.uint16)
    at = owner & np.uint16(0x7FFF)
    n = len(owner)
    key = np.frombuffer(r["keys"], np.uint32, n).astype(np.uint64) | np.frombuffer(r["keys"], np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32)
    return key, np.frombuffer(r["ids"], np.int64)[at], owner >= np.uint16(0x8000)


GROUP = "grp long, leader long, member long, visitor boolean, many boolean"


def meet(shown_blocks: DataFrame) -> DataFrame:
    """Groups of different sets that show a block: grp, leader, member, many (are there more than two?), a row for each member
    but the leader (the group's own set with the smallest id).  Groups with the same members are one a bucket, but for
    widespread blocks."""

    def gathered(rows, twice):
        """key, set id, visitor, sorted and distinct; twice: only keys that are there more than once."""
        key, sid, visitor = (np.concatenate(x) for x in zip(*map(unpack, rows)))
        if twice:
            order = np.argsort(key, kind="stable")
            key = key[order]
            again = np.zeros(len(key), bool)
            again[1:] = key[1:] == key[:-1]
            again[:-1] |= again[1:]
            order, key = order[again], key[again]
            sid, visitor = sid[order], visitor[order]
        order = np.lexsort((sid, visitor, key))
        key, sid, visitor = key[order], sid[order], visitor[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
        return key[new], sid[new], visitor[new]

    def bucket(t: pa.Table) -> pa.Table:
        give_back()  # what the bucket before has left
        rows = t.select(["wide", "keys", "owners", "ids"]).to_pylist()
        out = []
        if some := [r for r in rows if r["wide"]]:
            key, sid, visitor = gathered(some, False)
            out.append(pa.table({"grp": key.view(np.int64), "leader": pa.nulls(len(key), pa.int64()), "member": sid, "visitor": visitor, "many": np.ones(len(key), bool)}))
        if some := [r for r in rows if not r["wide"]]:
            key, sid, visitor = gathered(some, True)
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            count = np.diff(np.append(start, len(key)))
            with np.errstate(over="ignore"):
                same = np.add.reduceat(mix(sid.view(np.uint64)), start) if len(start) else np.zeros(0, np.uint64)
            good = np.flatnonzero((count > 1) & ~visitor[start])
            good = np.isin(np.arange(len(start)), good[np.unique(same[good], return_index=True)[1]])
            leads = np.repeat(start, count)
            at = np.repeat(good, count)
            at[start] = False
            out.append(pa.table({"grp": np.repeat(same, count)[at].view(np.int64), "leader": sid[leads][at], "member": sid[at], "visitor": visitor[at], "many": np.repeat(count > 2, count)[at]}))
        return pa.concat_tables(out)

    made = written(shown_blocks.groupBy("bucket").applyInArrow(bucket, GROUP), "near-met")
    wide = made.where("leader is null")
    lead = wide.groupBy("grp").agg(F.min(F.struct("visitor", "member")).alias("l"), F.count("*").alias("k")).where("k > 1 and not l.visitor")
    lead = written(lead.select(F.col("grp").alias("g"), F.col("l.member").alias("first"), (F.col("k") > 2).alias("more")), "near-leads")
    wide = wide.join(lead, F.col("grp") == F.col("g")).where("member <> first").select("grp", F.col("first").alias("leader"), "member", F.col("more").alias("many"))
    return made.where("leader is not null").select("grp", "leader", "member", "many").union(wide)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_id, hashes of the documents whose ids are wanted (doc_id); more than once where rows share an id."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    wanted = written(wanted, "near-wanted")
    few = wanted.count() <= BROADCAST_IDS
    texts = texts.join(F.broadcast(wanted) if few else wanted, texts.doc_id.eqNullSafe(wanted.doc_id), "left_semi")

    def task(batches):
        seen: set[int] = set()
        for b in batches:
            for some in portions(texts_of(b)):
                sets = {i: s for s in shingle_sets(some) if len(s) and (i := set_id(s)) not in seen}
                seen.update(sets)
                yield pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), pa.array([s.tobytes() for s in sets.values()], pa.binary())], names=["set_id", "hashes"])

    return texts.mapInArrow(lean(task), "set_id long, hashes binary")


def plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """a, b of the pairs (a, b) whose sizes and sketches do not rule similarity out."""
    side = lambda k: sketches.select(F.col("set_id").alias(f"{k}_id"), F.col("n").alias(f"{k}_n"), F.col("sketch").alias(f"{k}_s"))
    both = pairs.join(side("l"), F.col("a") == F.col("l_id")).join(side("r"), F.col("b") == F.col("r_id")).where("4 * least(l_n, r_n) >= 3 * greatest(l_n, r_n)")

    def task(batches):
        for b in batches:
            keep = []
            for n, x, y in zip((b.column("l_n").to_numpy() + b.column("r_n").to_numpy()).tolist(), b.column("l_s").to_pylist(), b.column("r_s").to_pylist()):
                words = min(len(x), len(y)) // 8
                far = np.bitwise_count(fold(np.frombuffer(x, np.uint64), words) ^ fold(np.frombuffer(y, np.uint64), words)).sum()
                keep.append(bool(7 * int(far) <= n))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "l_n", "r_n", "l_s", "r_s").mapInArrow(task, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    m = np.concatenate([x, y])
    m.sort(kind="stable")
    shared = int((m[1:] == m[:-1]).sum())
    return 100 * shared >= 75 * (len(m) - shared)


def verify(pairs: DataFrame, docs: DataFrame, reps: DataFrame, sketches: DataFrame) -> DataFrame:
    """a, b of the pairs (a, b) whose sets are similar: the documents that stand for them (reps: set_id, rep) are read once
    more and whole sets intersected."""
    ids = written(pairs.select(F.col("a").alias("i")).union(pairs.select("b")).distinct(), "near-ids")
    longest = sketches.join(ids, F.col("set_id") == F.col("i"), "left_semi").agg(F.max("n")).first()[0]
    if longest is None:
        return pairs
    sets = whole_sets(docs, reps, ids)
    one = sets.select(F.col("set_id").alias("i"), F.col("hashes").alias("left"))
    two = sets.select(F.col("set_id").alias("j"), F.col("hashes").alias("right"))
    both = pairs.join(one, F.col("a") == F.col("i")).select("a", "b", "left").join(two, F.col("b") == F.col("j")).select("a", "b", "left", "right")

    def task(batches):
        for b in batches:
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column("left"), b.column("right"))]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with arrow_rows(docs.sparkSession, 16 * longest):
        links = written(both.mapInArrow(task, "a long, b long"), "near-links")
    forget(sets, ids)
    return links


def whole_sets(docs: DataFrame, reps: DataFrame, ids: DataFrame) -> DataFrame:
    """set_id, hashes of the sets whose ids are given (i)."""
    return written(sets_of(docs, reps.join(ids, F.col("set_id") == F.col("i")).select(F.col("rep").alias("doc_id")).distinct()), "near-sets")


def contract(batches):
    """Edges (u, v) to stars (u, v: the smallest node of the component that the task saw); a stretch of EDGES at a time."""

    def stars(held):
        u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in "uv")
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        above = list(range(len(nodes)))  # a node's parent is never greater than the node

        def top(i):
            while above[i] != i:
                above[i] = i = above[above[i]]
            return i

        for x, y in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
            x, y = top(x), top(y)
            above[max(x, y)] = min(x, y)
        roots = np.array([top(i) for i in range(len(nodes))])
        own = roots != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[roots[own]])], names=["u", "v"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n > EDGES:
            yield stars(held)
            held, n = [], 0
    if n:
        yield stars(held)


def components(links: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) of every node with a link.  Each task turns about EDGES edges into stars
    first, without a shuffle: one task's stars are the components; those of several meet in alternating stars, in rounds in
    the logarithm of the longest chain.  Tables are written between the steps."""
    given = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "stars")
    tasks = given.count() // EDGES + 1
    edges, before = written(given.coalesce(tasks).mapInArrow(contract, "u long, v long"), "stars"), None
    forget(given)
    while tasks > 1:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
        large = written(both.join(low, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        low = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("w"))
        after = written(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), "stars")
        now = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        forget(edges, large)
        edges = after
        if now == before:
            break
        before = now
    roots = written(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", F.col("v").alias("w")).distinct()), "roots")
    forget(edges)
    return roots


def forest(s, n, root, part, sketches: list[np.ndarray], hashes: list[np.ndarray] | None) -> list[tuple[int, int]]:
    """Pairs of a tile whose parts of a family differ (or all, in a tile of one part) and that join components: of sets that
    sketches do not rule out, or, where hashes are given, of similar sets.  At most one pair a set.  In order of size, sets
    that can be similar stand side by side, and sketches are at most twice as wide as that of the smallest."""
    order = np.lexsort((s, n))
    s, n, part = s[order], n[order], part[order]
    label = np.unique(root[order], return_inverse=True)[1]
    cross, found = bool((part != part[0]).any()), []
    upto = np.searchsorted(n, 4 * n // 3, side="right")
    width = np.array([len(sketches[i]) for i in order])
    first = {int(w): int(np.searchsorted(width, w)) for w in np.unique(width)}
    last = {w: int(np.searchsorted(width, w, side="right")) for w in first}
    own = {w: np.stack([sketches[i] for i in order[first[w] : last[w]]]) for w in first}
    twice = {w: fold_rows(own[2 * w]) for w in first if 2 * w in own}
    for i in range(len(s) - 1):
        ok = label[i + 1 : upto[i]] != label[i]
        if cross:
            ok &= part[i + 1 : upto[i]] != part[i]
        at = np.flatnonzero(ok) + i + 1
        if not len(at):
            continue
        w = int(width[i])
        mine, k = own[w][i - first[w]], int(np.searchsorted(at, last[w]))
        far = [np.bitwise_count(own[w][at[:k] - first[w]] ^ mine).sum(1)]
        if k < len(at):
            far.append(np.bitwise_count(twice[w][at[k:] - last[w]] ^ mine).sum(1))
        for j in at[7 * np.concatenate(far).astype(np.int64) <= n[i] + n[at]].tolist():
            if label[j] != label[i] and (hashes is None or similar(hashes[order[i]], hashes[order[j]])):
                found.append((int(s[i]), int(s[j])))
                label[label == label[j]] = label[i]
    return found


def fold_rows(sketches: np.ndarray) -> np.ndarray:
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


def tiled(sets: DataFrame, size) -> DataFrame:
    """unit, s, n, root (size: bytes that a set takes) dealt into tiles (unit, i, j) whose sides are parts of a unit, and tiles
    into bundles.  Units of one component are left out, and sets of a unit's main component meet the others only."""
    roots = sets.withColumn("bytes", size).groupBy("unit", "root").agg(F.count("*").alias("k"), F.sum("bytes").alias("b"))
    sides = lambda k, b: F.ceil(F.greatest(k / TILE, b / TILE_BYTES)).cast("int")
    units = roots.groupBy("unit").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.max(F.struct("k", "root", "b")).alias("m"), F.sum("k").alias("k"), F.sum("b").alias("b"), F.count("*").alias("roots")).where("roots > 1")
    one, rest_k, rest_b = sides(F.col("k"), F.col("b")) <= 1, F.col("k") - F.col("m.k"), F.col("b") - F.col("m.b")
    units = units.select(F.col("unit").alias("_unit"), "main", "k", "b", F.when(one, F.col("b")).otherwise(rest_b).alias("rest"), F.when(one, 1).otherwise(sides(rest_k, rest_b)).alias("minor"), F.when(one, 0).otherwise(sides(F.col("m.k"), F.col("m.b"))).alias("major"))
    units = written(units, "near-units")
    held = units.agg(F.coalesce(F.sum(F.col("rest") * (F.col("minor") + F.col("major")) + (F.col("b") - F.col("rest")) * F.col("minor")), F.lit(0))).first()[0]
    deal = lambda k: F.pmod(F.xxhash64(F.lit(1), "s"), k).cast("int")
    rows = sets.join(units, F.col("unit") == F.col("_unit")).drop("_unit", "k", "b", "rest")
    main = (F.col("major") > 0) & (F.col("root") == F.col("main"))
    rows = rows.withColumn("part", F.when(main, F.col("minor") + deal(F.greatest("major", F.lit(1)))).otherwise(deal(F.col("minor"))))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.when(main, F.col("minor")).otherwise(F.col("minor") + F.col("major")) - 1)))
    rows = rows.withColumn("i", F.least("part", "with")).withColumn("j", F.greatest("part", "with")).drop("with", "main", "minor", "major")
    return written(rows.withColumn("bundle", F.pmod(F.xxhash64("unit", "i", "j"), F.lit(int(held) // BUNDLE_BYTES + 1))), "near-tiles")


def joined(tiles: DataFrame, payload: DataFrame) -> DataFrame:
    """a, b: the forests of the tiles.  payload: set_id with its sketch, or with its hashes."""
    whole = "hashes" in payload.columns

    def bundle(t: pa.Table) -> pa.Table:
        give_back()
        unit, i, j, s, n, root, part = (t[c].to_numpy() for c in ("unit", "i", "j", "s", "n", "root", "part"))
        hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["payload"]]
        order, found = np.lexsort((j, i, unit)), []
        new = np.ones(len(order), bool)
        for c in (unit[order], i[order], j[order]):
            new[1:] &= c[1:] == c[:-1]
        starts = np.flatnonzero(~new | (np.arange(len(order)) == 0))
        for a, b in zip(starts, [*starts[1:], len(order)]):
            at = order[a:b]
            if len(at) > 1:
                own = [hashes[x] for x in at]
                sketches = [np.frombuffer(sketch_of(h), np.uint64) for h in own] if whole else own
                found += forest(s[at], n[at], root[at], part[at], sketches, own if whole else None)
        return pa.table({c: pa.array([f[k] for f in found], pa.int64()) for k, c in enumerate("ab")})

    rows = tiles.join(payload.toDF("_s", "payload"), F.col("s") == F.col("_s")).select("bundle", "unit", "i", "j", "part", "s", "n", "root", "payload")
    return written(rows.groupBy("bundle").applyInArrow(bundle, "a long, b long"), "near-forest")


def rest(groups: DataFrame, pairs: DataFrame, roots: DataFrame, sketches: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame | None:
    """a, b: links that join the components that groups lie in; None where no group lies in several.  Two sets of a group are
    in one family, since their components are both joined to the leader's; groups of two have been looked at."""
    root_of = lambda d, c, name: d.join(roots.toDF("_n", "_r"), F.col(c) == F.col("_n"), "left").withColumn(name, F.coalesce("_r", c)).drop("_n", "_r")
    apart = root_of(root_of(pairs.where("many").select("a", "b"), "a", "x"), "b", "y").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    apart = written(apart, "near-apart")
    if apart.isEmpty():
        return None
    family = components(apart)
    members = root_of(sketches.select(F.col("set_id").alias("s"), "n"), "s", "root").join(family.toDF("_node", "family"), F.col("root") == F.col("_node")).drop("_node")
    members = written(members, "near-members")
    sizes = members.groupBy("family").agg(F.count("*").alias("size")).where(F.col("size") > FAMILY)
    large = written(sizes.select(F.col("family").alias("f")), "near-large")
    units = members.join(large, F.col("family") == F.col("f"), "left_anti").select(F.col("family").alias("unit"), "s", "n", "root")
    if not large.isEmpty():
        each = groups.select("grp", F.col("member").alias("g")).union(groups.select("grp", "leader")).distinct()
        some = members.join(large, F.col("family") == F.col("f"), "left_semi").join(each, F.col("s") == F.col("g"))
        units = units.union(some.select(F.col("grp").alias("unit"), "s", "n", "root"))
    trees = joined(tiled(written(units, "near-units"), F.col("n") / 4 + 100), sketches.select("set_id", "sketch"))
    if trees.isEmpty():
        return None
    inside = members.where("s <> root").select(F.col("s").alias("a"), F.col("root").alias("b"))
    tree = components(trees.union(inside))
    # Sets of trees that hold several components, with whole sets.
    sets = members.select("s", "n", "root").join(tree.toDF("_node", "unit"), F.col("s") == F.col("_node")).drop("_node")
    several = sets.groupBy(F.col("unit").alias("u")).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("u")
    sets = written(sets.join(several, F.col("unit") == F.col("u"), "left_semi"), "near-trees")
    hashes = sets_of(docs, reps.join(sets, F.col("set_id") == F.col("s"), "left_semi").select(F.col("rep").alias("doc_id")).distinct())
    return joined(tiled(sets, 8 * F.col("n") + 100), hashes)


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row_hash, n_shingles, set_id), and sets with copies or links: of (their id), component_id, and first,
    the row of the component that comes first (id null, id, row hash)."""
    with arrow_rows(docs.sparkSession, ROW):
        return _linked(docs)


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    described = written(describe(docs), "near-described")
    rows = described.where("n_shingles is not null")
    n_docs, n_all = rows.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    often = frequent(described, n_docs)
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_all // 1_500_000)
    groups = meet(show(docs, often, buckets))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_hash").alias("hash"))
    reps = written(rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.min(place).alias("place"), F.count("*").alias("copies")), "near-reps")
    pairs = groups.groupBy(F.least("leader", "member").alias("a"), F.greatest("leader", "member").alias("b")).agg(F.max("many").alias("many"))
    pairs = written(pairs, "near-stars")
    ids = written(pairs.select(F.col("a").alias("i")).union(pairs.select("b")).distinct(), "near-ids")
    sketches = rows.join(ids, F.col("set_id") == F.col("i"), "left_semi").groupBy("set_id").agg(F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"))
    sketches = written(sketches, "near-sketches")
    links = verify(written(plausible(pairs, sketches).distinct(), "near-pairs"), docs, reps, sketches)
    roots = components(links)
    more = rest(groups, pairs, roots, sketches, docs, reps)
    if more is not None and not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    named = reps.join(roots, F.col("set_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "set_id"))
    # Only sets with copies or links need a name; a component's name is the smallest of its sets' names.
    named = written(named.where("copies > 1 or node is not null"), "near-named")
    least = written(named.groupBy(F.col("root").alias("r")).agg(F.min("rep").alias("component_id"), F.min("place").alias("first")), "near-names")
    return rows.select("doc_id", "row_hash", "n_shingles", "set_id"), written(named.join(least, F.col("root") == F.col("r")).select(F.col("set_id").alias("of"), "component_id", "first"), "near-named")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id (smallest doc_id of the component), one row a row.

    Null and empty texts, and texts without words, have no shingles and are alone; a row with a null doc_id counts in its
    component but never names it unless all its rows have null ids.  Repeated rows are equal sets.  An empty table gives an
    empty result.  A long text is hashed in parts; its set, 8 bytes a shingle, is held whole.  Columns but doc_id and text
    are not looked at.
    """
    rows, named = linked(docs)
    of = (F.col("set_id") == F.col("of")) & (F.col("n_shingles") > 0)
    return rows.join(named, of, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id (null last), then the smallest hash of its text;
    of rows alike in both one.  Rows without words are nobody's copies and stay.  All columns stay, whatever their names."""
    rows, named = linked(docs)
    rows = rows.where("n_shingles > 0")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_hash").alias("hash"))
    later = F.coalesce(F.max(place != F.col("first")), F.lit(False)).alias("gone")
    marked = rows.join(named, F.col("set_id") == F.col("of"), "left").groupBy("doc_id", "row_hash").agg(later, F.count("*").alias("times"))
    mine, of, its = (fresh(docs.columns, c) for c in ("_hash", "_of", "_its"))
    marked = written(marked.where("gone or times > 1").select(F.col("doc_id").alias(of), F.col("row_hash").alias(its), "gone"), "near-gone")
    same = F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(mine) == F.col(its))
    gone, again = (marked.where(c).drop("gone") for c in ("gone", "not gone"))
    left = docs.withColumn(mine, text_hash()).join(gone, same, "left_anti")
    if not again.isEmpty():
        left = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", mine]))
    return left.drop(mine)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
