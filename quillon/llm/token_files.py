"""Token-id output: raw id payloads with a minimal perfect hash index for constant-time access by document key.

A shard is two files.  `<name>.ids` is nothing but ids, little-endian, 2 bytes each where the vocabulary allows, else 4.
`<name>.idx` is an Arrow file: the minimal perfect hash (bit arrays of a cascade: keys that share a position at one level
go on to the next) and, in slot order, offset, length and a 64-bit fingerprint of the key, so a key that was never stored
is told apart.  Shards are ranges of doc_id in ascending order, so the shard files laid end to end are the corpus.

Plan: one range shuffle of (doc_id, text); each task sorts its range, encodes it and streams its files into the shared
folder under a name of its own attempt.  The manifest, one row a shard, is written by Spark, and names the attempt that
counted, so lost executors and repeated tasks leave the result whole.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, scratch, text_of, tokenizer_file, written
from .pieces import FINE, PieceCache, kept

END = 0
#: Pieces that a worker remembers: about 200 MB.
KEEP = 1_000_000
#: Parts that the library is given end to end.
JOIN = 1000
M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A one-to-one scrambling of 64-bit words."""
    with np.errstate(over="ignore"):
        x = x + GOLD * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * M1
        x = (x ^ (x >> np.uint64(27))) * M2
        return x ^ (x >> np.uint64(31))


def keys_of(ids: list[int | None]) -> np.ndarray:
    """One word a document.  The k-th row of an id that is there more than once, and null ids, get keys of their own."""
    raw = np.array([0 if i is None else i for i in ids], dtype=np.int64).view(np.uint64)
    none = np.array([i is None for i in ids], dtype=bool)
    seen: dict = {}
    nth = np.zeros(len(ids), np.uint64)
    if len(set(ids)) < len(ids):
        for k, i in enumerate(ids):
            nth[k] = seen.get(i, 0)
            seen[i] = int(nth[k]) + 1
    with np.errstate(over="ignore"):
        return mix64(raw) + nth * np.uint64(0xD6E8FEB86659FD93) + none.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)


class PerfectHash:
    """n distinct keys to 0..n-1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0, *(int(b.sum()) for b in levels)])
        self.rank = [np.cumsum(b, dtype=np.int64) - 1 for b in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(keys):
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
            bits = np.bincount(at := cls.at(keys, len(levels), max(64, 2 * len(keys))), minlength=max(64, 2 * len(keys))) == 1
            levels.append(bits)
            keys = keys[~bits[at]]
        return cls(levels)

    @staticmethod
    def at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys, level + 1) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Slots; -1 where no level has the key."""
        slot, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self.at(keys[open_], level, len(bits))
            hit = bits[at]
            slot[open_[hit]] = self.before[level] + self.rank[level][at[hit]]
            open_ = open_[~hit]
        return slot


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class ShardWriter:
    def __init__(self, folder: str, name: str, wide: bool):
        self.fs, top = filesystem(folder)
        self.fs.create_dir(top, recursive=True)
        self.path, self.kind = f"{top}/{name}", np.dtype("<u4" if wide else "<u2")
        self.out, self.ids, self.lengths = self.fs.open_output_stream(f"{self.path}.ids"), [], []

    def add(self, doc_id: int | None, payload: bytes) -> None:
        self.out.write(payload)
        self.ids.append(doc_id)
        self.lengths.append(len(payload) // self.kind.itemsize)

    def close(self) -> tuple[int, int]:
        self.out.close()
        keys = keys_of(self.ids)
        perfect = PerfectHash.build(keys)
        slot = perfect(keys)
        lengths = np.array(self.lengths, np.int64)
        columns = {"doc_id": pa.array(self.ids, pa.int64())}  # in the order of the payload
        for name, values in (("offset", np.cumsum(lengths) - lengths), ("length", lengths), ("fingerprint", mix64(keys, 99).view(np.int64))):
            by_slot = np.empty(len(keys), np.int64)
            by_slot[slot] = values
            columns[name] = pa.array(by_slot)
        bits = pa.array([np.packbits(b).tobytes() for b in perfect.levels], pa.binary())
        meta = {"bits": bits.to_pylist(), "sizes": [len(b) for b in perfect.levels]}
        table = pa.table(columns).replace_schema_metadata({"kind": self.kind.str, "sizes": ",".join(map(str, meta["sizes"])), "levels": b"".join(meta["bits"]).hex()})
        with self.fs.open_output_stream(f"{self.path}.idx") as f, pa.ipc.new_file(f, table.schema) as w:
            w.write_table(table)
        return len(keys), int(lengths.sum())


class Shard:
    """Reads a shard.  rows(ids) -> offsets and lengths by the index; get(doc_id) -> ids or None."""

    def __init__(self, folder: str, name: str):
        self.fs, top = filesystem(folder)
        with self.fs.open_input_file(f"{top}/{name}.idx") as f:
            table = pa.ipc.open_file(f).read_all()
        meta = table.schema.metadata
        self.kind, packed, levels, at = np.dtype(meta[b"kind"].decode()), bytes.fromhex(meta[b"levels"].decode()), [], 0
        for size in [int(x) for x in meta[b"sizes"].decode().split(",") if x]:
            n = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(packed, np.uint8, n, at), count=size).astype(bool))
            at += n
        self.perfect, self.doc_ids = PerfectHash(levels), table["doc_id"].to_pylist()
        self.offset, self.length, self.mark = (table[c].to_numpy() for c in ("offset", "length", "fingerprint"))
        self.data = self.fs.open_input_file(f"{top}/{name}.ids")

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and length of each key; -1 where the fingerprint says that the key was never stored."""
        slot = self.perfect(keys)
        if not len(self.mark):
            return slot, slot
        known = (slot >= 0) & (self.mark[slot] == mix64(keys, 99).view(np.int64))
        return np.where(known, self.offset[slot], -1), np.where(known, self.length[slot], -1)

    def payload(self, offset: int, length: int) -> np.ndarray:
        w = self.kind.itemsize
        return np.frombuffer(self.data.read_at(length * w, offset * w), self.kind)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        offset, length = self.rows(keys_of([doc_id]))
        return None if offset[0] < 0 else self.payload(int(offset[0]), int(length[0]))


def byte_level(spec: str) -> bool:
    """Whether a tokenizer cuts texts by the byte-level pattern and nothing else, so that pieces.FINE holds."""
    t = json.loads(spec)
    pre = t.get("pre_tokenizer") or {}
    return not t.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


def library_encoder(spec: str, wide: bool):
    """Parts -> id bytes with the tokenizers library; special tokens' strings are ordinary text.

    Where texts are cut at spaces (byte_level), parts that begin with a space and no more white space are given to the
    library end to end, JOIN at a time; the bytes that ids stand for tell where each part ends.
    """
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    t.encode_special_tokens = True
    kind = "I" if wide else "H"
    alone = lambda parts: [array(kind, e.ids).tobytes() for e in t.encode_batch_fast(parts, add_special_tokens=False)]
    if not byte_level(spec):
        return alone
    vocab = t.get_vocab(with_added_tokens=False)  # a character a byte
    size = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
    size[list(vocab.values())] = [len(x) for x in vocab]

    def joined(parts):
        raw = "".join(parts)
        ids = np.array(t.encode_batch_fast([raw], add_special_tokens=False)[0].ids, np.int64)
        ends, upto = np.cumsum(list(map(len, parts) if raw.isascii() else (len(p.encode()) for p in parts))), np.cumsum(size[ids])
        at = np.searchsorted(upto, ends)
        if len(ids) == 0 or at[-1] != len(ids) - 1 or (upto[at] != ends).any():
            return alone(parts)
        data, cuts = ids.astype(np.dtype(kind)).tobytes(), ((at + 1) * array(kind).itemsize).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]

    def encode(parts):
        spaced = [p[0:1] == " " and len(p) > 1 and not p[1].isspace() for p in parts]
        those = [p for p, s in zip(parts, spaced) if s]
        got = iter([g for i in range(0, len(those), JOIN) for g in joined(those[i : i + JOIN])])
        rest = iter(alone([p for p, s in zip(parts, spaced) if not s]))
        return [next(got if s else rest) for s in spaced]

    return encode


MANIFEST = "shard int, name string, n_docs long, n_ids long"


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end: int = END, wide: bool = False) -> DataFrame:
    """Encodes docs (doc_id, text) into shard files under folder; returns the manifest with each shard's first id's place.

    wide: 4 bytes an id, needed from 65,536 ids on.  Null texts are empty, null ids come last, rows that share an id are
    all written.  An empty table gives no shard.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(open(tokenizer, encoding="utf-8").read())  # a vocabulary, of fixed size

    def task(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        writer, shard, cache, stop = None, TaskContext.get().partitionId(), None, array("I" if wide else "H", [end]).tobytes()
        name = f"part-{shard:05d}-{uuid.uuid4().hex[:12]}"
        for b in batches:
            if cache is None:
                cache = kept(("ids", wide, zlib.crc32(spec.value.encode())), lambda: PieceCache(library_encoder(spec.value, wide), KEEP, fine=FINE if byte_level(spec.value) else None))
                writer = ShardWriter(folder, name, wide)
            for doc_id, payload in zip(b.column(0).to_pylist(), cache.each(b.column(1).to_pylist())):
                writer.add(doc_id, payload + stop)
        if writer:
            n, ids = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [name], "n_docs": [n], "n_ids": [ids]})

    order = F.col("doc_id").asc_nulls_last()
    dealt = docs.select(F.col("doc_id").cast("long"), text_of(docs).alias("text")).repartitionByRange(order).sortWithinPartitions(order)
    manifest = written(dealt.mapInArrow(task, MANIFEST), "ids-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return written(manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "ids-manifest")


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """Each document of the shard files: doc_id, start, n_tokens, ids_crc32, found through the index."""

    def task(batches):
        for b in batches:
            for shard in b.to_pylist():
                s = Shard(folder, shard["name"])
                offset, length = s.rows(keys_of(s.doc_ids))
                crc = [zlib.crc32(s.payload(o, n).astype("<u4").tobytes()) for o, n in zip(offset.tolist(), length.tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(s.doc_ids, pa.int64()), "start": pa.array(offset + shard["first"]), "n_tokens": pa.array(length), "ids_crc32": pa.array(crc, pa.int64())})

    # A count of its own, so that adaptive execution does not put these few but heavy rows into one task.
    return manifest.repartition(max(1, manifest.count()), "name").mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    return read_ids(write_ids(read(spark, sf_dir, "documents"), folder, tokenizer_file("byte_bpe_50k.json")), folder)
