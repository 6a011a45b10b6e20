"""Cutting a text where every byte-level pre-tokenizer of the ` ?letters| ?digits| ?other|spaces` family cuts too.

Such a pattern never lets a match run over a space that stands next to a character that is not white space on at least
one side: the space starts a new match.  So a text may be cut before those spaces and each part encoded on its own,
which lets a worker keep the ids of parts that it has seen.  Where white space stands on both sides the space stays
inside a longer part.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space between white space and white space or the end: cutting at every space would be wrong there.
RUN = re.compile(r"\s (?:\s|\Z)")
CUT = re.compile(r"(?<!\s)(?= )|(?= \S)")


#: Finer cuts inside a part, for the byte-level pattern alone (`'s|..| ?\\p{L}+| ?\\p{N}+| ?other+|\\s+(?!\\S)|\\s+`): between a Latin
#: letter or digit and ASCII punctuation but the apostrophe, before a line end, and after a single one before a letter.
#: The characters are named one by one, so that no two Unicode versions can differ on them.
FINE = re.compile(r"(?<=[0-9A-Za-zÀ-ÖØ-öø-ÿ])(?=[!-&(-/:-@\[-`{-~])|(?<=[!-~À-ÖØ-öø-ÿ])(?=\n)|(?<=[!-~À-ÖØ-öø-ÿ]\n)(?=[A-Za-zÀ-ÖØ-öø-ÿ])")

#: FINE as replacements one after the other, which put MARK where it cuts (texts that hold MARK go another way).
MARK = "\x01"
MARKED = [
    (r"([0-9A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~])", rf"\1{MARK}\2"),
    (r"([!-~À-ÖØ-öø-ÿ])\n", f"\\1{MARK}\n"),
    (rf"{MARK}\n([A-Za-zÀ-ÖØ-öø-ÿ])", f"{MARK}\n{MARK}\\1"),
]

#: Characters of text that are looked at together.
STRETCH = 8 << 20

#: Caches of this worker process, which outlive a task: (kind, digest of the vocabulary) -> cache.
KEPT: dict = {}


def kept(key: tuple, make: Callable):
    """What make() gave this worker for the key before, else a new one.  A worker keeps one at a time."""
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = make()
    return KEPT[key]


class Recent(dict):
    """At most 2 * half entries: where one generation is full the one before it goes, and what is used comes along."""

    def __init__(self, half: int):
        self.half, self.before = half, {}

    def __missing__(self, key):
        got = self.before.get(key)
        if got is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self) >= self.half:
            self.before = dict(self)
            self.clear()
        self[key] = value


class PieceCache:
    """Text -> payload bytes, by parts.  encode(list of parts) -> list of bytes; keep: parts remembered at most; fine: where
    a part that is not remembered may be cut again."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], keep: int = 400_000, longest: int = 40, fine: re.Pattern | None = None):
        self.encode, self.longest, self.fine, self.seen = encode, longest, fine, Recent(keep // 2)

    def remember(self, parts: list[str], ids: list[bytes]) -> None:
        for p, g in zip(parts, ids):
            if len(p) <= self.longest:
                self.seen.put(p, g)

    def encoded(self, parts: list[str]) -> list[bytes]:
        """Of distinct parts.  With fine cuts, pieces of a part are encoded once and remembered as well."""
        if self.fine is None:
            return self.encode(parts)
        cut = [[p] if p[1:].isalpha() else self.fine.split(p) for p in parts]
        got = {x: self.seen[x] if len(c) > 1 else None for c in cut for x in c}
        new = [x for x, g in got.items() if g is None]
        got.update(zip(new, self.encode(new)))
        self.remember(*zip(*((x, got[x]) for x in dict.fromkeys(x for c in cut if len(c) > 1 for x in c))) if any(len(c) > 1 for c in cut) else ([], []))
        return [got[c[0]] if len(c) == 1 else b"".join([got[x] for x in c]) for c in cut]

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if RUN.search(text):
            return b"".join(self.encode([p for p in CUT.split(text) if p]))
        head, *rest = text.split(" ")
        return b"".join([*(self.encode([head]) if head else ()), *self.found([" " + p for p in rest])])

    def found(self, parts: list[str]) -> list[bytes]:
        """Of parts, remembered or not."""
        got = list(map(self.seen.__getitem__, parts))
        if None in got:
            new = list(dict.fromkeys(p for p, g in zip(parts, got) if g is None))
            found = dict(zip(new, self.encoded(new)))
            got = [found[p] if g is None else g for p, g in zip(parts, got)]
            self.remember(found.keys(), found.values())
        return got

    def each(self, texts: list[str]) -> Iterator[bytes]:
        """Of each text what a call gives.  Stretches of about STRETCH characters are split and their words numbered in Arrow, so
        that a word is looked up once a stretch, and put together there as well."""
        some, held = [], 0
        for t in texts:
            some.append(t)
            held += len(t)
            if held >= STRETCH:
                yield from self.stretch(some)
                some, held = [], 0
        yield from self.stretch(some)

    def stretch(self, texts: list[str]) -> Iterator[bytes]:
        odd = [RUN.search(t) is not None or MARK in t for t in texts]
        heads, rests = [], []
        for t, o in zip(texts, odd):
            head, space, rest = ("", "", "") if o else t.partition(" ")
            heads.append(head)
            rests.append(rest if space else None)
        first = dict.fromkeys(h for h in heads if h)
        first = dict(zip(first, self.encode(list(first)))) if first else {}
        lists = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        words = lists.values.dictionary_encode()
        ids = self.together(words.dictionary).take(words.indices)
        place, data = ids.buffers()[1:]
        data = memoryview(data or b"")
        place = np.frombuffer(place, np.int64)[lists.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(texts) + 1)
        for t, o, head, a, b in zip(texts, odd, heads, place, place[1:]):
            yield self(t) if o else first.get(head, b"") + data[a:b]

    def together(self, words: pa.Array) -> pa.Array:
        """Of distinct words, each after a space.  Where fine cuts hold they are made in Arrow, and pieces are looked up, not words."""
        text = lambda x: pa.scalar(x, pa.large_string())
        words = pc.binary_join_element_wise(text(" "), words, text(""))
        if self.fine is None:
            return pa.array(self.found(words.to_pylist()), pa.large_binary())
        for pattern, put in MARKED:
            words = pc.replace_substring_regex(words, pattern, put)
        lists = pc.split_pattern(words, MARK)
        pieces = lists.values.dictionary_encode()
        parts = pieces.dictionary.to_pylist()
        got = list(map(self.seen.__getitem__, parts))
        if None in got:
            new = [p for p, g in zip(parts, got) if g is None]
            found = self.encode(new)
            self.remember(new, found)
            found = iter(found)
            got = [next(found) if g is None else g for g in got]
        ids = pa.array(got, pa.large_binary()).take(pieces.indices)
        if not len(ids):
            return pa.array([], pa.large_binary())
        place = np.frombuffer(ids.buffers()[1], np.int64)[lists.offsets.to_numpy()]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(place), ids.buffers()[2]])
