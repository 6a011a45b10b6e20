"""Byte-level BPE encoding in linear time by longest matches and backtracking, and decoding.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary's byte strings finds, in one
pass, the longest token that starts at every place.  The encoder walks from left to right, takes the longest token that
is compatible with the one before it, falls back to the next shorter prefix token where none is, and backtracks where a
place turns out to be a dead end; places found dead are never tried again.  Two adjacent tokens are compatible when
merging their joined bytes would give back just these two, which follows from the merges that made them; the answers are
memoised.  A sequence all of whose neighbours are compatible is the one that the merges give.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, read, text_of, tokenizer_file
from .pieces import PieceCache, kept

#: Characters of text that leave a task together.
BATCH = 4 << 20


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in raw.splitlines() if line)}


def merged(ranks: dict[bytes, int], piece: bytes, below: int | None = None) -> list[bytes]:
    """The plain way: join the pair of lowest rank until no pair is a token (of a rank below the limit)."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best >= (1 << 60 if below is None else below):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class BytePairEncoder:
    def __init__(self, ranks: dict[bytes, int], memo: int = 500_000):
        import ahocorasick

        self.ranks, self.memo_size = ranks, memo
        size = max(ranks.values(), default=-1) + 1
        self.bytes_of: list[bytes] = [b""] * size
        self.left, self.right, self.shorter = list(range(size)), list(range(size)), [-1] * size
        self.automaton, reached = ahocorasick.Automaton(), set()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.bytes_of[rank] = token
            if len(token) > 1:
                two = merged(ranks, token, rank)
                if len(two) != 2:
                    continue  # no merges lead to this token: only a whole piece can be it
                self.left[rank], self.right[rank] = ranks[two[0]], ranks[two[1]]
            reached.add(token)
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        for token in reached:
            self.shorter[ranks[token]] = next((ranks[p] for n in range(len(token) - 1, 0, -1) if (p := token[:n]) in reached), -1)
        self.length = [len(t) for t in self.bytes_of]
        self.pair = {(self.left[r], self.right[r]): r for t, r in ranks.items() if len(t) > 1 and t in reached}
        self.fits: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= self.memo_size:
                self.fits.clear()
            known = self.fits[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        """Undo the later merge on either side of the seam, again and again; a pair across the seam that would have been
        merged before the merge just undone shows that the two tokens do not stand side by side."""
        limit = 1 << 60
        while True:
            if self.pair.get((a, b), 1 << 60) < limit:
                return False
            # The merge of higher rank came last; of equal ranks the left one came first.
            if a > b:
                limit, inner = a, self.right[a]
                if inner != a:
                    a = inner
                    continue
                limit, inner = b + 1, self.left[b]
                if inner == b:
                    return True
                b = inner
            else:
                limit, inner = b + 1, self.left[b]
                if inner != b:
                    b = inner
                    continue
                limit, inner = a, self.right[a]
                if inner == a:
                    return True
                a = inner

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if not piece:
            return []
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest: list[tuple[int, int]] = [(0, -1)] * n
        for end, found in self.automaton.iter(piece.decode("latin-1")):
            start = end - found[0] + 1
            if found > longest[start]:
                longest[start] = found
        dead, out, at, token = bytearray(n + 1), [], 0, longest[0][1]
        while token >= 0:
            here = at
            while True:
                end = here + self.length[token]
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    at = end
                    token = longest[at][1] if at < n else -1
                    break
                token = self.shorter[token]
                if token < 0:  # nothing fits behind the last token: it was wrong
                    if not out:
                        break
                    dead[here] = 1
                    token = out.pop()
                    at = here - self.length[token]
                    token = self.shorter[token]
                    while token < 0 and out:
                        dead[at] = 1
                        token = out.pop()
                        at -= self.length[token]
                        token = self.shorter[token]
                    break
        if at != n:
            raise ValueError(f"the vocabulary has no tokens for all bytes of {piece[:40]!r}")
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def tokenizer(raw: bytes, pattern: str):
    """Text -> 4-byte ids as bytes, by pieces; the encoder; the ids as decimal strings."""
    from array import array

    import regex

    e, matches = BytePairEncoder(parse_ranks(raw)), regex.compile(pattern).findall

    def encode(parts):
        return [array("I", [i for m in matches(p) for i in e.encode(m.encode("utf-8"))]).tobytes() for p in parts]

    return PieceCache(encode), e, [str(i) for i in range(len(e.bytes_of))]


def encode_docs(docs: DataFrame, vocabulary: str, pattern: str, ids: bool = False) -> DataFrame:
    """Every row with n_tokens, ids_sha256 and decoded_sha256 (of the bytes that the ids decode to), and with the ids
    themselves (array<int>) on demand.

    Null and empty texts give no ids, whose digests are those of the empty string.  Repeated rows are encoded alike.  Own
    columns replace clashing ones; all others stay.  Narrow: no shuffle.  Rows leave in batches of about BATCH bytes of
    text, or one longer text; a worker keeps one encoder and its bounded caches from task to task.  A vocabulary that lacks
    a byte of a text fails.
    """
    own = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids
    docs = docs.drop(*own)
    spark = docs.sparkSession
    raw = spark.sparkContext.broadcast(open(vocabulary, "rb").read())  # a vocabulary, of fixed size
    keep = docs.columns
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["n_tokens long, ids_sha256 string, decoded_sha256 string"] + ["ids array<int>"] * ids)

    def task(batches):
        cached, e, names = kept(("bpe", pattern, zlib.crc32(raw.value)), lambda: tokenizer(raw.value, pattern))
        for b in batches:
            start, n, sha, back, every, held = 0, [], [], [], [], 0
            for row, text in enumerate(b.column("text")):
                text = text.as_py() or ""
                payload = cached(text)
                got = memoryview(payload).cast("I").tolist()
                n.append(len(got))
                sha.append(hashlib.sha256(",".join(map(names.__getitem__, got)).encode()).hexdigest())
                back.append(hashlib.sha256(e.decode(got)).hexdigest())
                held += len(text)
                if ids:
                    every.append(payload)
                if held >= BATCH or row == b.num_rows - 1:
                    columns = [b.column(c).slice(start, len(n)) for c in keep] + [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                    if ids:
                        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(every), np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, names=[*keep, *own])
                    start, n, sha, back, every, held = row + 1, [], [], [], [], 0
                    columns = None
                    give_back()

    return docs.mapInArrow(task, out)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    rows = encode_docs(docs.select("doc_id", text_of(docs).alias("text")), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.drop("text")
