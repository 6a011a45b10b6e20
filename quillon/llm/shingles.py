"""Word-shingle sets of texts as 64-bit hashes, whole batches at a time."""

from __future__ import annotations

import re

import numpy as np

#: Words of a shingle, and bytes that are looked at together.
WORDS, LONGEST = 5, 1 << 21
CUT = re.compile(rb"[ \t\n\x0b\x0c\r]")
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15 | 1
BACK = pow(BASE, -1, 1 << 64)
STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = {}


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64; a worker keeps those up to LONGEST."""
    if len(_powers.get(base, ())) >= n:
        return _powers[base][:n]
    steps = np.full(max(n, LONGEST), base, np.uint64)
    steps[0] = 1
    with np.errstate(over="ignore"):
        steps = np.cumprod(steps)
    if n <= LONGEST:
        _powers[base] = steps
    return steps[:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-case bytes that end in white space, and where the words start."""
    space = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)))])
        return mix((total[end] - total[start]) * powers(BACK, len(data))[start] + (end - start).astype(np.uint64) * STEP), start


def long_words(text: bytes) -> np.ndarray:
    """word_hashes of a text of any length, cut at white space into parts of about LONGEST bytes."""
    out, at = [], 0
    while at < len(text):
        end = at + LONGEST
        if end < len(text):
            found = CUT.search(text, end)
            end = found.end() if found else len(text)
        out.append(word_hashes(np.frombuffer(text[at:end].lower() + b"\n", np.uint8))[0])
        at = end
    return np.concatenate(out)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `words` words (A-Z lower-cased; words stand between white
    space); with fewer words one hash of the whole sequence; without words nothing.  Equal hashes of different runs are
    as likely as any two 64-bit numbers being equal.  A text above LONGEST bytes stands alone and takes about 40 bytes a
    word beside itself."""
    if len(texts) == 1 and len(texts[0]) > LONGEST:
        word, first = long_words(texts[0]), [0]
        first.append(len(word))
    else:
        word, start = word_hashes(np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8))
        first = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)])).tolist()
    with np.errstate(over="ignore"):
        m = max(0, len(word) - words + 1)
        gram = np.zeros(m, np.uint64)
        for i in range(words):
            gram *= STEP
            gram += word[i : i + m]
        gram = mix(gram)
    out = []
    for a, b in zip(first, first[1:]):
        if b - a >= words:
            out.append(np.unique(gram[a : b - words + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    h = h * STEP + w
            out.append(mix(np.array([h], np.uint64) ^ STEP))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def portions(texts: list[bytes], size: int = 1 << 20):
    """Runs of texts of about `size` bytes, so that the arrays stay small; a text above LONGEST is one alone."""
    some, held = [], 0
    for t in texts:
        if some and len(t) > LONGEST:
            yield some
            some, held = [], 0
        some.append(t)
        held += len(t)
        if held >= size:
            yield some
            some, held = [], 0
    if some:
        yield some


def set_id(hashes: np.ndarray) -> int:
    """One signed 64-bit number for a set."""
    if not len(hashes):
        return 0
    with np.errstate(over="ignore"):
        a = np.array([hashes.sum(), np.bitwise_xor.reduce(hashes)], np.uint64)
        return int(mix(mix(a[:1]) + a[1:] * STEP + np.uint64(len(hashes))).view(np.int64)[0])


def parity(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Parity sketch: each element flips one of `bits` bits (a power of two); 64-bit words.  The Hamming distance of two
    sketches is at most the size of the sets' symmetric difference."""
    at = (mix(hashes ^ STEP) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.uint64)


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """The narrower sketch of the same set: halves of a power-of-two width are added by parity."""
    while len(sketch) > words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch
