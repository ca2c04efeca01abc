"""Word hashes of whole batches of texts, in numpy."""

from __future__ import annotations

import numpy as np

# ASCII separators become blanks, A-Z are lower-cased, all bytes beyond ASCII belong to words
WORDS = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
#: the same, but only ASCII white space separates
TOKENS = bytes((c + 32 if 0x41 <= c <= 0x5A else 0x20 if c in b"\t\n\x0b\x0c\r " else c) for c in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str | None], table: bytes = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text's words begin (one entry more than texts)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([b"", *raw, b""]).translate(table), dtype=np.uint8)
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw)))  # index of the blank after each text
    word = data != 0x20
    starts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    bounds = np.concatenate([[0], np.searchsorted(starts, ends)]).astype(np.int64)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), bounds
    stops = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    lengths = stops - starts
    power = np.cumprod(np.full(int(lengths.max()), BASE, dtype=np.uint64))
    letters = np.flatnonzero(word)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    values = (data[letters].astype(np.uint64) + np.uint64(1)) * power[place]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64)), bounds


def slices(texts: list[str | None], chars: int = 2_000_000):
    """Index ranges of about so many characters; a longer text stands alone."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > chars:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)
